"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A text's set is its distinct word shingles (64-bit hashes). Sets of equal content are one class, a node of the graph.
A band holds the sizes from one power of two to the next. A set's tiles, in the band of the larger set of a pair, are
pairs of elements that are neighbours in the set's hash order (both ends of the order count as elements). Sets with i
elements in common and d in only one of them share i + 1 - d such pairs at least, so that of a set's pairs, ordered by
a hash, one of the first few is shared by any set that links to it: a bounded prefix of the pairs is enough, and no
link is lost. Which tiles are shared at all is found from packed, sorted hash lists.

Each set is first held against the smallest member of its tiles that it meets most often; sets that are then still
apart are compared tile by tile: bit counts of two bitmaps bound the overlap from above, and only pairs that can still
link go on to the exact intersection. Pairs already connected are not compared again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisift.llm.common import _LOWER, discard, give_back, hash_runs, hash_words, lean, materialise, mix, pack, pack_sorted, parts_for, small, text_blocks, text_bytes, unpack, unpack_sorted, word_spans

KEY_BITS = 48
PART_BYTES, HELD_KEYS, LEAST_PARTS = 6 << 20, 1_000_000, 64
#: Members compared at a time within a tile; pairs tried for each component in the rounds before the one that takes all.
BLOCK, TRIES = 512, (4, 256)
#: Smallest tiles of a set that its places in tiles carry, so that most pairs are listed in the first tile they share only.
FIRST_TILES = 6
#: Pairs listed for each place in a tile, in the first round and then (no block has more members).
FEW, ALL = 1, BLOCK
#: 64-bit words of a bitmap: two to four bits for each shingle, within these.
LEAST_WORDS, MOST_WORDS = 4, 4096
#: Sets compared with one hub in one group of the exact check.
HUB_SHARE = 256
#: Links up to which components are found in one task, which holds some 50 bytes for each; more are spread over the cluster.
LINKS_AT_ONCE = 500_000
#: Rows (of a few longs) up to which a table is broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and the edges between texts.

    A text with fewer than k words has its whole sequence as one shingle, one without words none."""
    low = _LOWER[data]
    s, e, counts = word_spans(low, offsets)
    g = hash_words(low, s, e)
    edge = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(counts)), counts)
    h = hash_runs(g, k)
    at = np.arange(len(h))
    ok = at + k <= edge[text[: len(h)] + 1]
    h, text = h[ok], text[: len(h)][ok]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([hash_runs(g[edge[i] : edge[i + 1]], int(counts[i]))[0] + np.uint64(counts[i]) for i in short], np.uint64)
        h, text = np.concatenate([h, mix(extra)]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def needed_overlap(x, y, percent: int):
    """Smallest intersection of sets of sizes x and y that links them: 100 * i >= percent * (x + y - i)."""
    return -(-percent * (x + y) // (100 + percent))


def band_of(n: int) -> int:
    return n.bit_length() - 1


def prefixes(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, pairs of neighbours needed) of a set of n: in its own band, and in the next if a larger set there can link.

    Of a set's n + 1 pairs at most 2n + m - 3i are not shared with a linked set of m elements, i of them common."""
    out = [(band_of(n), 2 * n * (100 - percent) // 100 + 1)]
    least = 2 << band_of(n)
    if 100 * n >= percent * least:
        out.append((band_of(n) + 1, 2 * n + least + (-3 * percent * (n + least) // (100 + percent)) + 1))
    return out


def tile_keys(h: np.ndarray, percent: int, salt: int = 0) -> np.ndarray:
    """Keys of the tiles of a sorted set that is not empty."""
    ends = np.concatenate([np.zeros(1, np.uint64), h, np.full(1, ~np.uint64(0))])
    g = mix(mix(ends[:-1] + np.uint64(salt)) * np.uint64(3) + ends[1:])
    out = []
    for band, k in prefixes(len(h), percent):
        k = min(k, len(g))
        first = g[g <= np.partition(g, k - 1)[k - 1]]
        out.append(mix(first + np.uint64(band)) >> np.uint64(64 - KEY_BITS))
    return np.unique(np.concatenate(out))


def bitmap_words(n: int) -> int:
    """Words of the bitmap of a set of n: a power of two, so that one can be folded to another's width."""
    return min(MOST_WORDS, max(LEAST_WORDS, 1 << max(0, -(-n // 32) - 1).bit_length()))


def bitmap(h: np.ndarray) -> np.ndarray:
    """A bit is the parity of the elements hashed to it, so that common elements cancel out between two bitmaps: bits that
    differ stand for elements of only one set, and few of those meet, however full the bitmaps are."""
    words = bitmap_words(len(h))
    bits = np.bincount(((h >> np.uint64(7)) % np.uint64(words * 64)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(x: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at a smaller width."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits that two bitmaps differ in, the wider one folded to the width of the other."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum())


def _digests(h: np.ndarray, edge: np.ndarray, salt: int) -> list[bytes]:
    """16 bytes for each set: 8 name its node, 8 more tell if two sets were given one name."""
    key = salt.to_bytes(4, "little")
    return [hashlib.blake2b(h[x:y].tobytes(), digest_size=16, key=key).digest() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


_ROW = "range int, doc_id long, th long, n long, node long, check long, bits binary, keys binary, counts binary, owners binary"
_ROW_TYPES = [pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * 4]
_ROW_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _rows(columns: list) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _ROW_TYPES, strict=True)], names=_ROW_NAMES)


def _tiles(k: int, percent: int, parts: int, salt: int):
    """Rows of range -1: a document each, its bitmap with the first copy of a set; others: the tile keys of one hash
    range with the nodes that own them."""

    def flush(keys, owners):
        key, own = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key)
        key, own = key[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        u, at = key[first], np.append(first, len(key))
        edge = np.searchsorted(((u >> np.uint64(KEY_BITS - 24)) * np.uint64(parts)) >> np.uint64(24), np.arange(parts + 1))
        n = np.diff(at).astype(np.uint32)
        full = [(i, x, y) for i, x, y in zip(range(parts), edge[:-1], edge[1:], strict=True) if y > x]
        return _rows([[i for i, _, _ in full], *[None] * 6, [pack_sorted(u[x:y]) for _, x, y in full], [pack(n[x:y]) for _, x, y in full], [own[at[x] : at[y]].tobytes() for _, x, y in full]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, seen, held = [], [], set(), 0
        for batch in batches:
            for first, data, offsets in text_blocks(batch.column(2)):
                h, edge = shingle_sets(data, offsets, k)
                sizes = np.diff(edge)
                names = _digests(h, edge, salt)
                both = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                bits: list[bytes | None] = []
                for i, n in enumerate(sizes.tolist()):
                    bits.append(None)
                    if n and names[i] not in seen:  # a copy within the task adds nothing
                        seen.add(names[i])
                        one = h[edge[i] : edge[i + 1]]
                        t = tile_keys(one, percent, salt)
                        bits[-1] = bitmap(one).tobytes()
                        keys.append(t)
                        owners.append(np.full(len(t), both[i, 0], np.int64))
                        held += len(t)
                m = len(sizes)
                yield _rows([np.full(m, -1), batch.column(0).slice(first, m), batch.column(1).slice(first, m), sizes, both[:, 0], both[:, 1], bits, None, None, None])
                if held >= HELD_KEYS:
                    yield flush(keys, owners)
                    keys, owners, seen, held = [], [], set(), 0
        if held:
            yield flush(keys, owners)

    return lean(run)


_SHARED = "key long, doc long, star long, n long"


def _shared(group: pa.Table) -> pa.Table:
    """Of the tiles of one range with two owners or more: how often each owner meets a tile's smallest owner as `star`;
    and, of tiles with three or more, all owners (key, doc), tiles with the very same owners being one."""
    rows = group.to_pydict()
    keys = [unpack_sorted(x) for x in rows["keys"]]
    key = np.concatenate([np.repeat(k, unpack(n).astype(np.int64)) for k, n in zip(keys, rows["counts"], strict=True)])
    own = np.frombuffer(b"".join(rows["owners"]), np.int64)
    del rows, keys
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[new], own[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    n = np.diff(np.append(first, len(key)))
    keep = np.repeat(n > 1, n)
    key, own, first, n = key[keep], own[keep], first[n > 1], n[n > 1]
    at = np.cumsum(n) - n
    pair = np.stack([own, np.repeat(own[at], n)], axis=1)[np.repeat(own[at], n) != own] if len(n) else np.zeros((0, 2), np.int64)
    order = np.lexsort((pair[:, 0], pair[:, 1]))
    pair = pair[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]).any(axis=1)
    met = np.diff(np.append(np.flatnonzero(new), len(pair)))
    pair = pair[new]
    if len(n):  # tiles with the same members: two sums over them, and their number
        u = own.view(np.uint64)
        _, one = np.unique(np.stack([np.add.reduceat(mix(u), at), np.add.reduceat(mix(u ^ np.uint64(77)), at), n.astype(np.uint64)], axis=1), axis=0, return_index=True)
        chosen = np.zeros(len(n), bool)
        chosen[one] = True
        keep = np.repeat(chosen & (n > 2), n)
        key, own = key[keep], own[keep]
    made = pa.table({"key": pa.concat_arrays([pa.nulls(len(pair), pa.int64()), pa.array(key.view(np.int64))]), "doc": np.concatenate([pair[:, 0], own]), "star": pa.concat_arrays([pa.array(pair[:, 1]), pa.nulls(len(own), pa.int64())]), "n": pa.concat_arrays([pa.array(met.astype(np.int64)), pa.nulls(len(own), pa.int64())])})
    del key, own, pair, order, new, keep
    give_back()
    return made


def _check(k: int, percent: int):
    """Rows (a, salt, side, doc, text) in order: a hub's text (side 0), then texts held against it (side 1). The pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, side, doc = (batch.column(i).to_numpy() for i in (0, 2, 3))
            found: list[tuple[int, int]] = []
            for first, data, offsets in text_blocks(batch.column(4)):
                h, edge = shingle_sets(data, offsets, k)
                for i, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True), first):
                    if side[i] == 0:
                        hub, of = a[i], h[x:y].copy()
                    elif hub == a[i]:
                        both = np.concatenate([of, h[x:y]])
                        both.sort(kind="stable")
                        common = int((both[1:] == both[:-1]).sum())
                        if 100 * common >= percent * (len(both) - common):
                            found.append((a[i], doc[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return lean(run)


def _bounded(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """a, b, bound: the distinct pairs whose bitmaps allow a link. Marks move once each, and not beside each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            apart = np.array([bits_apart(np.frombuffer(v.as_py(), "<u8"), np.frombuffer(w.as_py(), "<u8")) for v, w in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            bound = np.minimum((na + nb - apart) // 2, np.minimum(na, nb))
            ok = bound >= needed_overlap(na, nb, percent)
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (a, b, bound)], names=["a", "b", "bound"])

    left = marks.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = marks.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    sized = pairs.select("a", "b").join(left.select("a", "na"), "a").join(right.select("b", "nb"), "b")
    sized = sized.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")
    return sized.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(lean(run), "a long, b long, bound long")


class Texts:
    """Where the text of a node stands: (doc_id, hash of the text) of one row of its class."""

    def __init__(self, docs: DataFrame, firsts: DataFrame, repeated: bool, shingle: int, percent: int):
        self.docs, self.firsts, self.repeated, self.shingle, self.percent = docs, firsts, repeated, shingle, percent

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets link, by exact intersection of sorted arrays. A hub (a) with many partners is dealt
        out over several groups; each text moves once for each group that it is in."""
        pairs = materialise(pairs.select("a", "b"), "pairs")
        hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_SHARE).alias("shares"))
        right = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).alias("salt"), F.lit(1).alias("side"), F.col("b").alias("doc"))
        left = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a").alias("doc"))
        want = materialise(left.unionByName(right).join(self.firsts.select(F.col("node").alias("doc"), "d", F.col("th").alias("t")), "doc"), "wanted")
        rows = self.docs.join(small(want, want.count(), BROADCAST_IDS), [self.docs["__d"] == want["d"], self.docs["th"] == want["t"]]).select("a", "salt", "side", "doc", "text")
        if self.repeated:  # rows equal in id and text: one is enough
            rows = rows.dropDuplicates(["a", "salt", "side", "doc"])
        rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
        found = materialise(rows.mapInArrow(_check(self.shingle, self.percent), "a long, b long"), "found")
        discard(pairs, want)
        return found


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, comp of a bounded number of links, all in one task: labels spread along links, with short cuts, till they stand."""
    links = [np.stack([x.column(i).to_numpy() for i in (0, 1)]) for x in batches]
    ids, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *links], axis=1), return_inverse=True)
    x, y = at.reshape(2, -1)
    label, was = np.arange(len(ids)), None
    while was is None or (label != was).any():
        was = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["doc", "comp"])


def components(links: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """doc, comp: for every document with a link (a, b) the smallest one it can reach; none for no links. Null ends are not
    allowed; repeated links and links to oneself add nothing. Up to `at_once` links, counted first, one task does; beyond,
    labels spread with short cuts, each round a written table, so that nothing depends on executors of earlier rounds."""
    if links.count() <= at_once:
        return materialise(links.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(lean(_union), "doc long, comp long"), "labels")
    both = materialise(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("doc"), F.least("x", "m").alias("comp"))
    labels = materialise(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("doc", "y"), "y").groupBy("x").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["doc"] == near["x"]).select("doc", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("doc").alias("comp"), F.col("comp").alias("further"))
        step = step.join(up, "comp", "left").select("doc", "was", F.least("comp", "further").alias("comp"))
        step = materialise(step, "labels")
        discard(labels)
        labels = step.select("doc", "comp")
        if step.filter("comp <> was").isEmpty():
            discard(both)
            return labels


def _compare(percent: int, most: int):
    """Within one pair of blocks of a tile: for each member the pairs with members of other components whose bitmaps allow a
    link, at most `most` of the highest bound; more: it had others. Pairs seen to share a tile of a smaller key are left to
    that one: a pair is always listed in the smallest tile it shares, and elsewhere only if that is not among those carried."""

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        doc, comp, n = (group.column(c).to_numpy() for c in ("doc", "comp", "n"))
        bits = [np.frombuffer(x, "<u8") for x in group.column("bits").to_pylist()]
        words = min(map(len, bits))
        bits = np.stack([fold(x, words) for x in bits])
        key = group.column("key")[0].as_py()
        tiles = np.array([x + [-1] * (FIRST_TILES - len(x)) for x in group.column("tiles").to_pylist()], np.int64)
        i, j = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        out = []
        for x in i:
            m = j[comp[j] != comp[x]]
            for before in tiles[x][(tiles[x] >= 0) & (tiles[x] < key)]:
                m = m[(tiles[m] != before).all(axis=1)]
            m = m[needed_overlap(n[x], n[m], percent) <= np.minimum(n[x], n[m])]
            if not len(m):
                continue
            apart = np.bitwise_count(bits[x] ^ bits[m]).sum(axis=1).astype(np.int64)
            bound = (n[x] + n[m] - apart) // 2  # each bit that differs stands for an element that only one set has
            ok = bound >= needed_overlap(n[x], n[m], percent)
            m, bound = m[ok], bound[ok]
            more = len(m) > most
            if more:
                top = np.argpartition(-bound, most - 1)[:most]
                m, bound = m[top], bound[top]
            out.append(np.stack([np.minimum(doc[x], doc[m]), np.maximum(doc[x], doc[m]), bound, np.full(len(m), more)], axis=1))
        cols = np.concatenate([np.zeros((0, 4), np.int64), *out])
        return pa.table({c: cols[:, k] for k, c in enumerate(("a", "b", "bound", "more"))})

    return run


def _apart(members: DataFrame, comp: DataFrame, marks: DataFrame, percent: int, most: int) -> DataFrame:
    """a, b, bound, more: pairs that share a tile, lie in different components and may link, for each place in a tile the
    best `most`; more (0 or 1) is 1 where others were left out."""
    m = members.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    m = materialise(m.select("key", "doc", "comp"), "apart")
    open_ = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(5))).alias("y")).filter("lo <> hi")
    #: Tiles with the very same members are one.
    open_ = materialise(open_.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / BLOCK).alias("blocks")), "tiles")
    n = m.join(small(open_, open_.count(), BROADCAST_IDS), "key")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("key"))
    tiles = n.select("doc", "key", rank.alias("r")).filter(F.col("r") <= FIRST_TILES).groupBy("doc").agg(F.collect_list("key").alias("tiles"))
    n = n.join(tiles, "doc").join(marks.select(F.col("node").alias("doc"), "n", "bits"), "doc").withColumn("at", F.pmod(F.xxhash64("doc", "key"), F.col("blocks")))
    pair = lambda i, side: F.struct(F.least("at", i).alias("i"), F.greatest("at", i).alias("j"), side.alias("side"))
    side = lambda i: F.when(i == F.col("at"), 2).otherwise(F.when(F.col("at") < i, 0).otherwise(1))
    n = n.withColumn("to", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: pair(i, side(i)))))
    n = n.select("key", "to.i", "to.j", "to.side", "doc", "comp", "n", "bits", "tiles")
    made = n.groupBy("key", "i", "j").applyInArrow(_compare(percent, most), "a long, b long, bound long, more long")
    made = materialise(made.groupBy("a", "b").agg(F.max("bound").alias("bound"), F.max("more").alias("more")), "may")
    discard(m, open_)
    return made


def _id(c: Column) -> Column:
    """A document id for joins: a null one has the smallest number."""
    return F.coalesce(c, F.lit(-(1 << 63)))


def _read(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__d": _id(F.col("doc_id").cast("long")), "th": F.xxhash64(F.col("text").cast("string"))})


def classes(docs: DataFrame, shingle: int, percent: int, *, part_bytes: int = PART_BYTES, least_parts: int = LEAST_PARTS) -> DataFrame:
    """doc_id, th (a hash of the text), n, comp, component_id for each row of docs, written: comp names the component.

    Every row is a node of its own; rows whose sets are equal link, whatever their ids. component_id is the smallest
    doc_id in the component that is not null, and null if there is none. Null and empty texts, and those without words,
    have no shingles (n = 0), no comp, and their own doc_id as component_id. An empty table gives no rows; columns besides
    doc_id and text are ignored. percent: 50 to 100, else ValueError."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100: below, a bounded prefix of tiles would lose links")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts_for(text_bytes(docs), part_bytes, least_parts)
    salt = 0
    while True:
        tiles = materialise(docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(_tiles(shingle, percent, parts, salt), _ROW), "tiles")
        info = tiles.filter("range = -1").select("doc_id", "th", "n", "node", "check")
        #: Of each node the row that stands for it, its smallest id, and whether two sets were given the node's name.
        firsts = info.filter("n > 0").groupBy("node").agg(F.min(F.struct(_id(F.col("doc_id")).alias("d"), "th")).alias("at"), F.min("doc_id").alias("least"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        firsts = materialise(firsts.select("node", "at.d", "at.th", "least", "lo", "hi"), "nodes")
        if firsts.filter("lo <> hi").isEmpty():
            break
        salt += 1  # so rare that all is named anew
        discard(tiles, firsts)
    repeated = not info.filter("n > 0").groupBy("doc_id", "th").count().filter("count > 1").isEmpty()
    texts = Texts(_read(docs), firsts, repeated, shingle, percent)
    shared = materialise(tiles.filter("range >= 0").select("range", "keys", "counts", "owners").groupBy("range").applyInArrow(_shared, _SHARED), "shared")
    stars = materialise(shared.filter("key IS NULL").groupBy("doc", "star").agg(F.sum("n").alias("n")), "stars")
    members = shared.filter("key IS NOT NULL").select("key", "doc")
    ids = stars.select("doc").union(stars.select("star")).distinct()
    marks = tiles.filter("range = -1 AND bits IS NOT NULL").select("node", "n", "bits")
    marks = materialise(marks.join(ids, marks["node"] == ids["doc"], "left_semi").dropDuplicates(["node"]), "marks")
    best = stars.groupBy("doc").agg(F.max(F.struct("n", (-F.col("star")).alias("s"))).alias("m")).select((-F.col("m.s")).alias("a"), F.col("doc").alias("b"))
    best = materialise(best, "best")
    links = texts.verify(_bounded(best, marks, percent))
    comp, tried = components(links), best

    def join_up(pairs: DataFrame) -> None:
        """Check pairs until none is left between two components: the best few of each component, more, then all."""
        nonlocal links, comp, tried
        rounds = iter(TRIES)
        pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "open")
        while not pairs.isEmpty():
            of = lambda c, to: comp.select(F.col("doc").alias(c), F.col("comp").alias(to))
            now = pairs.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
            now = materialise(now.filter("ca <> cb"), "now")
            discard(pairs)
            if tries := next(rounds, None):
                sides = now.select(F.col("ca").alias("c"), "a", "b", "bound").unionByName(now.select(F.col("cb").alias("c"), "a", "b", "bound"))
                rank = F.row_number().over(Window.partitionBy("c").orderBy(F.col("bound").desc(), "a", "b"))
                picked = materialise(sides.withColumn("r", rank).filter(F.col("r") <= tries).select("a", "b").distinct(), "picked")
            else:
                picked = now.select("a", "b")
            found = texts.verify(picked)
            if not found.isEmpty():
                links = links.unionByName(found)
                comp = components(links)
            tried = tried.unionByName(picked)
            if not tries:
                return
            pairs = materialise(now.join(picked, ["a", "b"], "left_anti").select("a", "b", "bound"), "open")
            discard(now)

    #: First what the tiles' smallest members leave open, which is all of tiles of two; then the tiles of three and more.
    of = lambda c, to: comp.select(F.col("doc").alias(c), F.col("comp").alias(to))
    met = stars.select(F.col("star").alias("a"), F.col("doc").alias("b")).join(tried, ["a", "b"], "left_anti")
    met = met.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    join_up(_bounded(met, marks, percent))
    most, more = FEW, True
    while more:  # ends when no member of a tile had more pairs than were listed
        may = _apart(members, comp, marks, percent, most)
        more, most = not may.filter("more = 1").isEmpty(), ALL
        join_up(may.select("a", "b", "bound"))
        discard(may)
    discard(shared, stars, marks)
    nodes = firsts.select("node", "least").join(comp, firsts["node"] == comp["doc"], "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    nodes = materialise(nodes, "graph")
    ids = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    nodes = materialise(nodes.select("node", "comp").join(ids, "comp"), "classes")
    full = info.filter("n > 0").join(nodes, "node").select("doc_id", "th", "n", "comp", "component_id")
    out = materialise(full.unionByName(info.filter("n = 0").select("doc_id", "th", "n", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))), "found")
    discard(tiles, firsts, nodes)
    return out


def find_classes(docs: DataFrame, shingle: int, percent: int, *, part_bytes: int = PART_BYTES, least_parts: int = LEAST_PARTS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the smallest doc_id it can reach by links of `percent` or more.

    Odd rows: see classes()."""
    found = classes(docs, shingle, percent, part_bytes=part_bytes, least_parts=least_parts)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """One row of each component, the one with the smallest doc_id (null ids last, then the smallest hash of the text);
    rows without shingles all stay. All columns stay as they were; of rows equal in id and text any one stays."""
    found = classes(docs, shingle, percent).filter("n > 0").select(_id(F.col("doc_id")).alias("__d"), F.col("th").alias("__t"), "comp", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th")).alias("rank"))
    best = materialise(found.groupBy("comp").agg(F.min("rank").alias("best"), F.count("*").alias("size")).filter("size > 1"), "best")
    placed = materialise(found.join(best, "comp").select("__d", "__t", (F.col("rank") > F.col("best")).alias("gone")), "placed")
    gone = materialise(placed.filter("gone").select("__d", "__t").distinct(), "gone")
    twice = materialise(placed.filter("NOT gone").groupBy("__d", "__t").count().filter("count > 1").select("__d", "__t"), "twice")
    at = lambda side: [left["__d"] == side["__d"], left["th"] == side["__t"]]
    left = _read(docs)
    left = left.join(small(gone, gone.count(), BROADCAST_IDS), at(gone), "left_anti")
    if n := twice.count():
        few = small(twice, n, BROADCAST_IDS)
        left = left.join(few, at(twice), "left_anti").unionByName(left.join(few, at(twice), "left_semi").dropDuplicates(["__d", "th"]))
    return left.select(*docs.columns)
