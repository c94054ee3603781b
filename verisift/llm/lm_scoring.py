"""Language-model scoring of whole documents.

The model is a small causal self-attention network over subword ids, written and trained in numpy. Its output is a
two-step softmax (a group of ids, then an id of the group) over the HEAD most common ids; the rest share one outcome
and are told apart by their corpus frequency. Corpus-wide counts of neighbouring ids enter the logits as a fixed prior,
and the attention layer learns what they leave open.

All training documents take part: each part of the corpus counts its words and neighbouring ids, and trains the network
further from a common start on all its windows; counts are summed and weights averaged over parts. Texts are
taken apart once: each part is packed as word numbers and subword ids, which all later steps read. For scoring, a text is cut into overlapping windows; each token is scored once, in the window that gives it most context.
The score of a word is a mixture of the network and, for words known from training, their share of all tokens.

Beside it stands a unigram base score over words, whose counts are exchanged as packed word lists: each part asks for
the corpus counts of the words that it holds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import materialise, pack, parts_for, text_bytes, unpack
from verisift.llm.langid import fold
from verisift.llm.piece_codec import Numbered, PieceCodec
from verisift.llm.substring_dedup import _NULL_ID, _part_of

GROUPS, PER_GROUP, DIM = 24, 24, 16
HEAD = GROUPS * PER_GROUP  # ids with outcomes of their own; 0 is the end of a text
TAIL, START, STATES = HEAD, HEAD + 1, HEAD + 2
WINDOW, STRIDE, BATCH, SMALL = 32, 28, 1024, 64
#: Training steps whose rows are put in order at once.
AHEAD = 64
#: Share of the word counts in the mixture that scores a known word.
COUNTED = 0.35
#: Documents for the common start, at most (about: drawn by a hash of the id).
START_TEXTS, START_STEPS = 600, 400
TRAIN_BATCH = 32
PART_BYTES, LEAST_PARTS, FAN_IN = 6 << 20, 64, 16
_codecs: dict[int, PieceCodec] = {}


def _codec(blob: bytes) -> PieceCodec:
    key = zlib.crc32(blob)
    if key not in _codecs:
        _codecs[key] = PieceCodec(blob)
    return _codecs[key]


def _subwords(codec: PieceCodec, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, each as if after a space, one after the other, and the edges between words."""
    if len(codec.known) > 400_000:
        codec.known, codec.flat, codec.edge = Numbered(), np.zeros(0, np.int32), np.zeros(1, np.int64)
    names = ["▁" + w.decode() for w in words]
    at = np.fromiter(map(codec.known.__getitem__, names), np.int64, len(names))
    if new := codec.known.new:
        made = codec.bare.encode(new, num_threads=1)
        codec.edge = np.concatenate([codec.edge, codec.edge[-1] + np.cumsum(list(map(len, made)))])
        codec.flat = np.concatenate([codec.flat, np.fromiter(chain.from_iterable(made), np.int32)])
        new.clear()
    size = codec.edge[at + 1] - codec.edge[at]
    edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return codec.flat[np.repeat(codec.edge[at] - edge[:-1], size) + np.arange(edge[-1])], edge


def _split(blocks: list[pa.Array]) -> tuple[list[np.ndarray], list[np.ndarray], pa.Array]:
    """Blocks of texts as numbers: how many words each text has, the number of each word, and the words that are numbered."""
    counts, words = [], []
    for texts in blocks:
        made = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        full = pc.binary_length(made.values).to_numpy() > 0  # white space at the ends of a text leaves empty words
        upto = np.concatenate([[0], np.cumsum(full)])
        counts.append(np.diff(upto[made.offsets.to_numpy()]))
        words.append(made.values.filter(pa.array(full)))
    coded = pa.chunked_array(words, pa.string()).dictionary_encode().combine_chunks()
    at = coded.indices.to_numpy()
    edge = np.cumsum([0, *map(len, words)])
    return counts, [at[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], coded.dictionary


def _in_turn(flat: np.ndarray, edge: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words numbered `at`, one after the other, and how many each word has."""
    each = np.diff(edge)[at]
    return flat.take(np.repeat(edge[at] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))), each


class Texts:
    """Some texts as word numbers and as symbol streams with an end after each text."""

    def __init__(self, texts: list[str | None], codec: PieceCodec, symbol: np.ndarray):
        (counts,), (at,), words = _split([pa.array(texts, pa.string())])
        self._lay(counts, *_in_turn(*_subwords(codec, words.cast(pa.binary()).to_pylist()), at), symbol)

    @classmethod
    def laid(cls, counts: np.ndarray, ids: np.ndarray, each: np.ndarray, symbol: np.ndarray) -> Texts:
        """From the number of words of each text, the ids of all words and how many each word has."""
        made = cls.__new__(cls)
        made._lay(counts, ids, each, symbol)
        return made

    def _lay(self, counts: np.ndarray, ids: np.ndarray, each: np.ndarray, symbol: np.ndarray) -> None:
        self.counts, self.each = counts, each
        upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        word = np.concatenate([[0], np.cumsum(counts)])
        text = np.arange(len(counts) + 1)
        self.edge = upto[word] + text  # one more for each end
        self.begin = upto[:-1] + np.repeat(text[:-1], counts)  # a word's first place in the stream; it has `each` places
        ends = self.edge[1:] - 1
        inner = np.ones(int(self.edge[-1]), bool)
        inner[ends] = False
        self.ids = np.full(len(inner), -1, np.int32)
        self.ids[inner] = ids
        self.y = symbol.take(self.ids)
        self.y[ends] = 0
        self.x = np.empty_like(self.y)
        self.x[1:] = self.y[:-1]
        self.x[self.edge[:-1]] = START

    def windows(self, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place of each window, one past the last place of its text, and the first place it scores."""
        docs = np.arange(len(self.counts)) if which is None else which
        n = self.edge[docs + 1] - self.edge[docs]
        k = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
        number = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        first = np.repeat(self.edge[docs], k) + number * STRIDE
        return first, np.repeat(self.edge[docs + 1], k), first + np.where(number > 0, WINDOW - STRIDE, 0)

    def at_windows(self, first: np.ndarray, stop: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of windows, those that they score, and the context and symbol of each place."""
        place = first[:, None] + np.arange(WINDOW)
        on = place < stop[:, None]
        np.minimum(place, stop[:, None] - 1, out=place)
        on &= place >= begin[:, None]
        return place, on, self.x.take(place), self.y.take(place)

    def neighbours(self, which: np.ndarray) -> np.ndarray:
        """Counts of (context symbol, symbol) in the texts marked in `which`."""
        on = np.repeat(which, np.diff(self.edge))
        return np.bincount(self.x[on].astype(np.int64) * (HEAD + 1) + self.y[on], minlength=STATES * (HEAD + 1))


class Prior:
    """Log-probabilities from smoothed counts of neighbours: of a group, and of an id within its group."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(STATES, HEAD + 1).astype(float)
        uni = c.sum(axis=0) + 0.1
        groups = lambda a: np.concatenate([a[..., :HEAD].reshape(*a.shape[:-1], GROUPS, PER_GROUP).sum(axis=-1), a[..., HEAD:]], axis=-1)
        pg, cg = groups(uni) / uni.sum(), groups(c)
        self.group = np.log((cg + 5 * pg) / (cg.sum(axis=1, keepdims=True) + 5)).astype(np.float32)
        u = uni[:HEAD].reshape(GROUPS, PER_GROUP)
        within = c[:, :HEAD].reshape(STATES, GROUPS, PER_GROUP)
        p = np.log((within + 3 * u / u.sum(axis=1, keepdims=True)) / (within.sum(axis=2, keepdims=True) + 3))
        self.pairs = np.ascontiguousarray(p.transpose(1, 0, 2), np.float32).reshape(-1, PER_GROUP)  # of a group and a context


#: Sums of short rows are products with ones.
ONES = np.ones(WINDOW, np.float32)
NAMES = ("E", "P", "Q", "K", "V", "O", "G", "W")
SCALE = np.float32(DIM**-0.5)
GROUP_OF = np.minimum(np.arange(HEAD + 1) // PER_GROUP, GROUPS)
#: Where the parameters of a symbol stand in E.
CELLS = np.arange(STATES * DIM).reshape(STATES, DIM)


def _exp(a: np.ndarray, most: float) -> np.ndarray:
    """exp in place, of `most` at most."""
    if a.size and a.max() > most:
        np.minimum(a, np.float32(most), out=a)
    return np.exp(a, out=a)


class Rows:
    """The scored places (`on`) of windows, batch by batch (`size` windows each) and within a batch in order of their groups.

    All that doesn't depend on weights is worked out here, for many batches at once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, on: np.ndarray, size: int):
        each = size * WINDOW
        self.x, self.batches = x, -(-len(x) // size)
        at = np.flatnonzero(on)
        group = GROUP_OF[y.ravel()[at]]
        key = at // each * (GROUPS + 1) + group
        self.order = np.argsort(key.astype(np.uint16) if self.batches * (GROUPS + 1) < 1 << 16 else key, kind="stable")
        at, group, key = at[self.order], group[self.order], key[self.order]
        edge = np.searchsorted(key, np.arange(self.batches * (GROUPS + 1) + 1))
        batch = at // each
        row = np.arange(len(at)) - edge[batch * (GROUPS + 1)]
        self.edge, self.at = edge.tolist(), at - batch * each
        self.row = np.full(x.size, -1)  # of each place, in its batch
        self.row[at] = row
        self.context, ys = x.ravel()[at], y.ravel()[at]
        self.pair = group * STATES + self.context
        self.group_at = row * (GROUPS + 1) + group
        self.within_at = row * PER_GROUP + ys - group * PER_GROUP


class Network:
    """One causal attention layer with a two-step softmax; parameters by name in p."""

    SHAPES = {"E": (STATES, DIM), "P": (WINDOW, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "O": (DIM, DIM), "G": (DIM, GROUPS + 1), "W": (GROUPS, DIM, PER_GROUP)}

    def __init__(self, p: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(7)
        self.p = p or {k: (rng.normal(size=s) * {"E": 0.5, "P": 0.3, "G": 0.01, "W": 0.01}.get(k, DIM**-0.5)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in NAMES])

    @classmethod
    def named(cls, a: np.ndarray) -> dict[str, np.ndarray]:
        """Views of the parameters in one array, by name."""
        edge = np.cumsum([0, *[int(np.prod(cls.SHAPES[k])) for k in NAMES]])
        return {k: a[x:y].reshape(cls.SHAPES[k]) for k, x, y in zip(NAMES, edge[:-1], edge[1:], strict=True)}

    @classmethod
    def from_flat(cls, a: np.ndarray) -> Network:
        return cls(cls.named(np.array(a, np.float32)))

    def _qkv(self) -> np.ndarray:
        """Queries (scaled), keys, and values as they reach the output, as one product."""
        p = self.p
        return np.concatenate([p["Q"] * SCALE, p["K"], p["V"] @ p["O"]], axis=1)

    def _attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray):
        """Weights before they are divided by their sums, one by the sums, and what was attended to."""
        s = q @ k.transpose(0, 2, 1)
        _exp(s, 60)
        s *= self.mask
        r = (1 / (s @ ONES))[..., None]
        o = s @ v
        o *= r
        return s, r, o

    def _seen(self, x: np.ndarray) -> np.ndarray:
        """Hidden rows of windows, in small batches that stay in the cache."""
        p, qkv = self.p, self._qkv()
        known = np.concatenate([p["E"], p["E"] @ qkv], axis=1)
        place = np.concatenate([p["P"], p["P"] @ qkv], axis=1)
        out = np.empty((*x.shape, DIM), np.float32)
        for at in range(0, len(x), SMALL):
            a = known.take(x[at : at + SMALL], axis=0)
            a += place
            _, _, o = self._attend(a[..., DIM : 2 * DIM], a[..., 2 * DIM : 3 * DIM], a[..., 3 * DIM :])
            np.add(a[..., :DIM], o, out=out[at : at + SMALL])
        return out

    def _step(self, prior: Prior, rows: Rows, batch: int, size: int, grads: dict | None, want: bool) -> np.ndarray | None:
        """One batch of rows: natural log-probabilities of its scored symbols (if `want`), and the gradients of their mean."""
        p, x = self.p, rows.x[batch * size : (batch + 1) * size]
        edge = rows.edge[batch * (GROUPS + 1) : (batch + 1) * (GROUPS + 1) + 1]
        a, b, n, m = edge[0], edge[-1], edge[-1] - edge[0], edge[-2] - edge[0]  # the first m rows have ids of the head
        if grads is None:
            h = self._seen(x)
        else:
            e = p["E"].take(x, axis=0)
            e += p["P"]
            qkv = self._qkv()
            made = np.dot(e.reshape(-1, DIM), qkv).reshape(len(x), WINDOW, 3 * DIM)
            q, k, v = made[..., :DIM], made[..., DIM : 2 * DIM], made[..., 2 * DIM :]
            s, r, o = self._attend(q, k, v)
            h = e + o
        hs = h.reshape(-1, DIM).take(rows.at[a:b], axis=0)
        z = hs @ p["G"]
        z += prior.group.take(rows.context[a:b], axis=0)
        _exp(z, 30)
        total = z @ ONES[: GROUPS + 1]
        of = rows.group_at[a:b]
        out = np.log(z.take(of)) - np.log(total) if want else None
        if grads is not None:
            z *= (np.float32(-1 / max(n, 1)) / total)[:, None]
            np.add.at(z.reshape(-1), of, np.float32(1 / max(n, 1)))
            np.dot(hs.T, z, out=grads["G"])
            dh = np.empty((n + 1, DIM), np.float32)
            dh[n] = 0  # for places that are not scored
            np.dot(z, p["G"].T, out=dh[:n])
        #: Only the products are worked out group by group, all else for all rows at once.
        z = np.empty((m, PER_GROUP), np.float32)
        parts = [(g, w, slice(i - a, j - a)) for g, w, i, j in zip(range(GROUPS), p["W"], edge, edge[1:], strict=False) if j > i]
        parts = [(g, w, at, hs[at], z[at]) for g, w, at in parts]
        for _, w, _, known, rest in parts:
            np.dot(known, w, out=rest)
        z += prior.pairs.take(rows.pair[a : a + m], axis=0)
        _exp(z, 30)
        total = z @ ONES[:PER_GROUP]
        of = rows.within_at[a : a + m]
        if want:
            out[:m] += np.log(z.take(of)) - np.log(total)
        if grads is None:
            return out
        z *= (np.float32(-1 / max(n, 1)) / total)[:, None]
        np.add.at(z.reshape(-1), of, np.float32(1 / max(n, 1)))
        back = np.empty((m, DIM), np.float32)
        for g, w, at, known, rest in parts:
            np.dot(known.T, rest, out=grads["W"][g])
            np.dot(rest, w.T, out=back[at])
        dh[:m] += back
        place = batch * size * WINDOW
        d = dh.take(rows.row[place : place + x.size], axis=0).reshape(h.shape)
        dn = d * r
        ds = dn @ v.transpose(0, 2, 1)
        ds -= ((dn * o) @ ONES[:DIM])[..., None]
        ds *= s
        g = np.empty((len(x), WINDOW, 3 * DIM), np.float32)
        np.matmul(ds, k, out=g[..., :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=g[..., DIM : 2 * DIM])
        np.matmul(s.transpose(0, 2, 1), dn, out=g[..., 2 * DIM :])
        g = g.reshape(-1, 3 * DIM)
        both = np.dot(g.T, e.reshape(-1, DIM)).T
        np.multiply(both[:, :DIM], SCALE, out=grads["Q"])
        grads["K"][:] = both[:, DIM : 2 * DIM]
        dv = both[:, 2 * DIM :]
        np.dot(dv, p["O"].T, out=grads["V"])
        np.dot(p["V"].T, dv, out=grads["O"])
        d = d.reshape(-1, DIM)
        d += np.dot(g, qkv.T)
        np.dot(np.ones(len(x), np.float32), d.reshape(len(x), -1), out=grads["P"].reshape(-1))
        np.add.at(grads["E"].reshape(-1), CELLS.take(x, axis=0).reshape(-1), d.reshape(-1))
        return out

    def logs(self, prior: Prior, x: np.ndarray, y: np.ndarray, on: np.ndarray, grads: dict | None = None):
        """Natural log-probability of each scored symbol (rows of `on`); with grads (zeros), also sets gradients of their mean."""
        rows = Rows(x, y, on, len(x))
        out = np.empty(len(rows.order), np.float32)
        if len(x):
            out[rows.order] = self._step(prior, rows, 0, len(x), grads, True)
        return out

    def train(self, prior: Prior, texts: Texts, first: np.ndarray, stop: np.ndarray, begin: np.ndarray, rate: float) -> None:
        """One pass over the given windows by Adam steps of TRAIN_BATCH windows, rising likelihood."""
        weights = self.flat().astype(np.float32)
        self.p = self.named(weights)
        m, v, step = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(weights)
        flat = np.zeros_like(weights)
        grads, t = self.named(flat), 0
        for at in range(0, len(first), AHEAD * TRAIN_BATCH):
            w = slice(at, at + AHEAD * TRAIN_BATCH)
            _, on, x, y = texts.at_windows(first[w], stop[w], begin[w])
            rows = Rows(x, y, on, TRAIN_BATCH)
            for batch in range(rows.batches):
                t += 1
                flat[:] = 0
                self._step(prior, rows, batch, TRAIN_BATCH, grads, False)
                #: Adam, with the constants of its two running means left to the last factors.
                m *= np.float32(0.9)
                m += flat
                v *= np.float32(0.99)
                flat *= flat
                v += flat
                np.sqrt(v, out=step)
                root = (0.01 / (1 - 0.99**t)) ** 0.5
                step += np.float32(1e-8 / root)
                np.divide(m, step, out=step)
                step *= np.float32(rate * 0.1 / (1 - 0.9**t) / root)
                weights += step

    def score(self, prior: Prior, texts: Texts) -> np.ndarray:
        """Natural log-probability of each place of the stream, tail ids counting as one outcome."""
        out = np.zeros(len(texts.y))
        first, stop, begin = texts.windows()
        for at in range(0, len(first), BATCH):
            w = slice(at, at + BATCH)
            place, on, x, y = texts.at_windows(first[w], stop[w], begin[w])
            rows = Rows(x, y, on, len(x))
            out[place.ravel()[rows.at]] = self._step(prior, rows, 0, len(x), None, True)
        return out


def _blocks(n_bytes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes."""
    out, a, total = [], 0, 0
    for i, n in enumerate(n_bytes.tolist()):
        if total and total + n > limit:
            out.append((a, i))
            a, total = i, 0
        total += n
    return [*out, (a, len(n_bytes))] if len(n_bytes) else []


def _id_counts(train: DataFrame, blob: bytes) -> np.ndarray:
    """How often each subword id stands in all given texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(blob)
        n, words = np.zeros(codec.bare.vocab_size(), np.int64), Counter()

        def spend() -> None:
            flat, edge = _subwords(codec, list(words))
            n[:] += np.bincount(flat, weights=np.repeat(np.fromiter(words.values(), float, len(words)), np.diff(edge)), minlength=len(n)).astype(np.int64)
            words.clear()

        for batch in batches:
            for text in batch.column(0):
                words.update((text.as_py() or "").encode().lower().split())
                if len(words) > 200_000:
                    spend()
        if words:
            spend()
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["id", "n"])

    out = np.zeros(_codec(blob).bare.vocab_size(), np.int64)
    for r in train.select("text").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _start(train: DataFrame, blob: bytes, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each subword id, by counts over all texts (made here if not given), and the weights of the common start, from a bounded sample."""
    n = train.count()
    drawn = train.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) <= F.lit(min(1.0, START_TEXTS / max(n, 1)) * 1_000_003))
    texts = [r["text"] for r in drawn.orderBy("doc_id", "text").select("text").collect()]
    codec = _codec(blob)
    size = codec.bare.vocab_size()
    symbol = np.full(size + 1, TAIL, np.int32)
    symbol[np.argsort(-(_id_counts(train, blob) if counts is None else counts), kind="stable")[: HEAD - 1]] = np.arange(1, HEAD)
    seen = Texts(texts, codec, symbol)
    net, prior = Network(), Prior(seen.neighbours(np.ones(len(texts), bool)))
    first, stop, begin = seen.windows()
    order = np.random.default_rng(3).permutation(len(first))[: START_STEPS * TRAIN_BATCH]
    net.train(prior, seen, first[order], stop[order], begin[order], 0.005)
    return symbol, net.flat()


_GATHER = "kind int, range int, part int, words binary, counts binary, n long"
_PACKED = f"{_GATHER}, doc_ids binary, marks binary, lengths binary, ids binary, each binary, at binary"


def _table(rows: list[tuple], fields: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    made = [x.split() for x in fields.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), made, strict=True)], names=[n for n, _ in made])


def _add_up(group: pa.Table) -> pa.Table:
    """Rows of one kind as one: 1: packed counts, 2: arrays of floats."""
    rows = group.to_pydict()
    kind, n = rows["kind"][0], sum(rows["n"])
    if kind == 1:
        a, b = (pack(sum(unpack(x) for x in rows[c])) for c in ("words", "counts"))
    else:
        a, b = sum(np.frombuffer(x, float) for x in rows["words"]).tobytes(), b""
    return _table([(kind, 0, min(rows["part"]) // FAN_IN, a, b, n)], _GATHER)


def _summed(sums: DataFrame, left: int) -> list:
    """Sums of the rows of all parts: at most FAN_IN rows of each kind."""
    while left > FAN_IN:
        sums, left = materialise(sums.withColumn("to", F.floor(F.col("part") / FAN_IN)).groupBy("kind", "to").applyInArrow(_add_up, _GATHER), "sums"), -(-left // FAN_IN)
    return sums.collect()


def score_documents(docs: DataFrame, model_path: str, *, part_bytes: int = PART_BYTES, least_parts: int = LEAST_PARTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and net_score (the network alone) for each row.

    Learns from rows whose crc32(doc_id as text) % 10 is not 0 (a null id counts as the empty text). Texts are scored
    lower-cased (A-Z), as words joined by single spaces, followed by an end. A null text counts as empty: one token, its
    end. Repeated ids are rows of their own; an empty table gives no rows; further columns are ignored. Without any
    training text all known counts are 0 and the network stays as it started."""
    blob = open(model_path, "rb").read()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), 10) == 0).alias("held_out"))
    parts = parts_for(text_bytes(docs), part_bytes, least_parts)
    size = _codec(blob).bare.vocab_size()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.ascontiguousarray(batch.column(0).fill_null(_NULL_ID).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(_part_of(ids, parts), pa.int32()), *batch.columns], names=["part", "doc_id", "text", "held_out"])

    split = docs.mapInArrow(deal, "part int, doc_id long, text string, held_out boolean")

    def read(key: tuple, group: pa.Table) -> pa.Table:
        """One part as numbers: its words by range with their counts, counts of ids, and its texts block by block. Nothing reads the texts again."""
        part, codec, group = key[0].as_py(), _codec(blob), group.combine_chunks()
        cuts = _blocks(pc.fill_null(pc.binary_length(group.column("text")), 0).to_numpy(), 1 << 20)
        column = lambda name: [group.column(name).slice(a, b - a).combine_chunks() for a, b in cuts]
        lengths, at, vocabulary = _split(column("text"))
        made = codec.bare.encode(pc.binary_join_element_wise("▁", vocabulary, "").to_pylist(), num_threads=1)
        edge = np.cumsum([0, *map(len, made)])
        flat = np.fromiter(chain.from_iterable(made), np.int32, int(edge[-1]))
        words, ends = vocabulary.cast(pa.binary()).to_pylist(), 0
        r = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
        order = np.argsort(r, kind="stable")
        bound, number = np.searchsorted(r[order], np.arange(parts + 1)).tolist(), np.empty(len(words), np.int32)
        number[order] = np.arange(len(words), dtype=np.int32)
        n, n_ids, out = np.zeros(len(words), np.int64), np.zeros(size, np.int64), []
        for i, (doc_ids, held_out, m, w) in enumerate(zip(column("doc_id"), column("held_out"), lengths, at, strict=True)):
            ids, each = _in_turn(flat, edge, w)
            train = ~held_out.to_numpy(zero_copy_only=False).astype(bool)
            ends += int(train.sum())
            n += np.bincount(w[np.repeat(train, m)], minlength=len(n))
            marks = train.astype(np.uint8) + 2 * doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            packed = (doc_ids.fill_null(0).to_numpy(), marks, m, ids.astype(np.min_scalar_type(size)), each.astype(np.int32), number[w])
            out.append((3, 0, part, None, None, i, *map(pack, packed)))
        n_ids += np.bincount(flat, weights=np.repeat(n, np.diff(edge)), minlength=size).astype(np.int64)
        n = n[order]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bound, pa.int32()), vocabulary.take(pa.array(order))), "\n").cast(pa.binary()).to_pylist()
        blank = (None,) * 6
        out += [(0, i, part, zlib.compress(joined[i], 1), pack(n[a:b]), 0, *blank) for i, (a, b) in enumerate(zip(bound[:-1], bound[1:], strict=True)) if b > a]
        out.append((1, 0, part, pack(n_ids), pack(n_ids[:0]), ends, *blank))
        return _table(out, _PACKED)

    packed = materialise(split.groupBy("part").applyInArrow(read, _PACKED), "parts")

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        total: dict[bytes, int] = {}
        lists = [zlib.decompress(w).split(b"\n") for w in rows["words"]]
        for words, c in zip(lists, rows["counts"], strict=True):
            for w, n in zip(words, unpack(c).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        sent = [pack(np.fromiter(map(total.__getitem__, words), np.int64, len(words))) for words in lists]
        tokens, kinds_ = sum(total.values()), sum(n > 0 for n in total.values())
        m = len(sent)
        return pa.table({"part": pa.array([*rows["part"], -1], pa.int32()), "range": pa.array([*rows["range"], rows["range"][0]], pa.int32()), "counts": pa.array([*sent, b""], pa.binary()), "tokens": pa.array([0] * m + [tokens], pa.int64()), "kinds": pa.array([0] * m + [kinds_], pa.int64())})

    answers = materialise(packed.filter("kind = 0").select("part", "range", "words", "counts").groupBy("range").applyInArrow(answer, "part int, range int, counts binary, tokens long, kinds long"), "answers")
    last = _summed(packed.filter("kind = 1").select("kind", "range", "part", "words", "counts", "n"), parts)
    ends = sum(r["n"] for r in last)
    symbol, weights = _start(docs.filter("NOT held_out AND text IS NOT NULL"), blob, sum([unpack(bytes(r["words"])) for r in last], np.zeros(size, np.int64)))
    texts = packed.filter("kind = 3")

    def learn(key: tuple, group: pa.Table) -> pa.Table:
        """Counts of neighbours and of tail ids in one part, and its weights after training."""
        near, tail, chosen = np.zeros(STATES * (HEAD + 1), np.int64), np.zeros(len(symbol), np.int64), []
        for row in group.sort_by("n").to_pylist():
            t = Texts.laid(*(unpack(row[c]) for c in ("lengths", "ids", "each")), symbol)
            train = unpack(row["marks"]) % 2 > 0
            near += t.neighbours(train)
            on = np.repeat(train, np.diff(t.edge)) & (t.y == TAIL)
            tail += np.bincount(t.ids[on], minlength=len(symbol))
            chosen.append((t, t.windows(np.flatnonzero(train))))
        net, prior, used = Network.from_flat(weights), Prior(near), 0
        for t, (first, stop, begin) in chosen:
            net.train(prior, t, first, stop, begin, 0.001)
            used += len(first)
        part = key[0].as_py()
        return _table([(1, 0, part, pack(near), pack(tail), 0), (2, 0, part, (net.flat().astype(float) * used).tobytes(), b"", used)], _GATHER)

    last = _summed(materialise(texts.select("part", "n", "marks", "lengths", "ids", "each").groupBy("part").applyInArrow(learn, _GATHER), "learned"), parts)
    near, tail = (sum([unpack(bytes(r[c])) for r in last if r["kind"] == 1], np.zeros(1, np.int64)) for c in ("words", "counts"))
    near, tail = np.broadcast_to(near, STATES * (HEAD + 1)), np.broadcast_to(tail, len(symbol))
    used = sum(r["n"] for r in last if r["kind"] == 2)
    final = sum(np.frombuffer(bytes(r["words"]), float) for r in last if r["kind"] == 2) / used if used else weights
    totals = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    n_train, n_kinds = totals["tokens"] + ends, totals["kinds"] + (ends > 0)
    near, tail, final = near.astype(np.int64), tail.astype(np.int64), np.asarray(final, np.float32)

    def finish(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
        net, prior = Network.from_flat(final), Prior(near)
        log_tail = np.log((tail + 0.1) / (tail.sum() + 0.1 * (symbol[:-1] == TAIL).sum()))
        count = np.concatenate([np.zeros(0, np.int64), *(unpack(c) for c in told.sort_by("range").column("counts").to_pylist()), [ends]])
        #: A known word may come from the counts or from the network; an unknown one from the network alone. The last is the end.
        with np.errstate(divide="ignore"):
            counted = np.log(count / max(n_train, 1)) + np.log(COUNTED)
        log_base = np.log10((count + 0.1) / (n_train + 0.1 * (n_kinds + 1)))
        out = []
        for row in group.sort_by("n").to_pylist():
            doc_ids, marks, lengths, ids, each, at = (unpack(row[c]) for c in ("doc_ids", "marks", "lengths", "ids", "each", "at"))
            t, m = Texts.laid(lengths, ids, each, symbol), len(lengths)
            text = np.repeat(np.arange(m), lengths)
            base = np.bincount(text, weights=log_base[at], minlength=m) + log_base[-1]
            n_known = np.bincount(text, weights=(count > 0)[at], minlength=m).astype(np.int64) + (ends > 0)
            logs = net.score(prior, t)
            rare = np.flatnonzero(t.y == TAIL)
            logs[rare] += log_tail[t.ids[rare]]
            upto = np.concatenate([[0], np.cumsum(logs)])
            net_word, net_end = upto[t.begin + t.each] - upto[t.begin], logs[t.edge[1:] - 1]
            mixed = np.logaddexp(net_word + np.log(1 - COUNTED), counted[at])
            score = (np.bincount(text, weights=mixed, minlength=m) + np.logaddexp(net_end + np.log(1 - COUNTED), counted[-1])) / np.log(10)
            net_score = np.add.reduceat(logs, t.edge[:-1]) / np.log(10)
            out.append(pa.table({"doc_id": pa.array(doc_ids, pa.int64(), mask=marks >= 2), "held_out": pa.array(marks % 2 == 0), "n_tokens": pa.array(lengths + 1), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array(np.full(m, n_train, np.int64)), "base_score": pa.array(base), "score": pa.array(score), "net_score": pa.array(net_score)}))
        empty = pa.table({n: pa.array([], k) for n, k in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("net_score", pa.float64()))})
        return pa.concat_tables(out) if out else empty

    told = answers.filter("part >= 0").select("part", "range", "counts")
    return texts.select("part", "n", "doc_ids", "marks", "lengths", "ids", "each", "at").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, net_score double")
