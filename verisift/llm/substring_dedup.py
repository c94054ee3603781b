"""Exact substring deduplication: passages that occur more than once anywhere are removed.

1. Anchors: every text is cut into non-overlapping blocks of ANCHOR words, so that any window of `window` words holds a
   whole block. Each block's hash is looked up among the hashes of all rolling runs of ANCHOR words.
2. Extension: around blocks that were met, all windows are hashed (96 bits) and counted over the whole corpus; windows
   that follow one another join into maximal repeats. Words covered by a repeated window are removed.

What travels are sorted, packed hash lists for each (part of the corpus, hash range), and answers of one bit a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.llm.common import give_back, hash_runs, hash_words, lean, materialise, pack, pack_sorted, parts_for, text_blocks, text_bytes, unpack, unpack_sorted, word_spans

WINDOW = 35
#: Bits of a rolling run's hash that travel. Runs that only share these bits cost work in step 2, not correctness.
PROBE_BITS = 40
#: Text bytes for each part of the corpus and each hash range, about; rolling runs held before they are sent on.
PART_BYTES, HELD_RUNS, LEAST_PARTS = 6 << 20, 1_000_000, 64
_NULL_ID = -(1 << 63)


def _runs_in_texts(g: np.ndarray, counts: np.ndarray, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within one text; for each its text and its first word's place in that text."""
    h = hash_runs(g, k, second)
    edge = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(g)) - edge[text]
    n = len(h)
    ok = at[:n] + k <= counts[text[:n]]
    return h[ok], text[:n][ok], at[:n][ok]


def _ranges(h: np.ndarray, parts: int) -> np.ndarray:
    """Range number of PROBE_BITS-bit hashes: order-preserving."""
    return ((h >> np.uint64(PROBE_BITS - 24)) * np.uint64(parts)) >> np.uint64(24)


_ANCHOR_SCHEMA = "range int, probes binary, repeated binary, blocks binary, doc_ids binary, places binary"


def _send_anchors(block: int, parts: int):
    """Packed rolling-run hashes and block hashes of a task's texts, for each hash range."""
    names = [x.split()[0] for x in _ANCHOR_SCHEMA.split(", ")]

    def flush(probes, blocks, docs, places):
        p, n = np.unique(np.concatenate(probes), return_counts=True)
        b, d, w = (np.concatenate(x) for x in (blocks, docs, places))
        order = np.argsort(b, kind="stable")
        b, d, w = b[order], d[order], w[order]
        pe = np.searchsorted(_ranges(p, parts), np.arange(parts + 1))
        be = np.searchsorted(_ranges(b, parts), np.arange(parts + 1))
        rows = [(i, pack_sorted(p[x:y]), np.packbits(n[x:y] > 1).tobytes(), pack_sorted(b[u:v]), pack(d[u:v]), pack(w[u:v])) for i, x, y, u, v in zip(range(parts), pe[:-1], pe[1:], be[:-1], be[1:], strict=True) if y > x]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = ([], [], [], []), 0
        for batch in batches:
            ids = batch.column(0).fill_null(_NULL_ID).to_numpy()
            for first, data, offsets in text_blocks(batch.column(1)):
                s, e, counts = word_spans(data, offsets)
                h, text, at = _runs_in_texts(hash_words(data, s, e), counts, block)
                if not len(h):
                    continue
                h >>= np.uint64(64 - PROBE_BITS)
                is_block = at % block == 0
                for x, y in zip(held, (h, h[is_block], ids[first + text[is_block]], at[is_block].astype(np.int32)), strict=True):
                    x.append(y)
                n += len(h)
                if n >= HELD_RUNS:
                    yield flush(*held)
                    held, n = ([], [], [], []), 0
        if n:
            yield flush(*held)

    return lean(run)


def _answer_anchors(parts: int):
    """Blocks of one hash range whose hash occurs at least twice among all runs, by part of the corpus."""

    def run(group: pa.Table) -> pa.Table:
        give_back()
        rows = group.to_pydict()
        probes = [unpack_sorted(x) for x in rows["probes"]]
        often = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(rows["repeated"], probes, strict=True)]
        p, w = np.concatenate(probes), np.concatenate(often)
        order = np.argsort(p, kind="stable")
        p, w = p[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, int)
        total = np.add.reduceat(w.astype(np.int64) + 1, first) if len(p) else np.zeros(0, int)
        met = p[first][total > 1]
        out = ([], [])
        for b, d, at in zip(rows["blocks"], rows["doc_ids"], rows["places"], strict=True):
            b = unpack_sorted(b)
            #: Both are sorted: a look-up costs by the blocks of the row, not by all that was met in the range.
            hit = met[np.minimum(np.searchsorted(met, b), len(met) - 1)] == b if len(met) else np.zeros(len(b), bool)
            if hit.any():
                out[0].append(unpack(d)[hit])
                out[1].append(unpack(at)[hit])
        ids = np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64)
        at = np.concatenate(out[1]) if out[1] else np.zeros(0, np.int32)
        part = _part_of(ids, parts)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        made = [(i, pack(ids[order[x:y]]), pack(at[order[x:y]])) for i, x, y in zip(range(parts), edge[:-1], edge[1:], strict=True) if y > x]
        cols = list(zip(*made, strict=True)) or [[], [], []]
        return pa.table({"part": pa.array(cols[0], pa.int32()), "doc_ids": pa.array(cols[1], pa.binary()), "places": pa.array(cols[2], pa.binary())})

    return run


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts


def _with_part(docs: DataFrame, parts: int) -> DataFrame:
    """docs with the part of the corpus of each row, as _part_of() has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.ascontiguousarray(batch.column(0).fill_null(_NULL_ID).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(_part_of(ids, parts), pa.int32()), *batch.columns], names=["__part", *batch.schema.names])

    return docs.mapInArrow(lean(run), T.StructType([T.StructField("__part", T.IntegerType()), *docs.schema.fields]))


def _part_windows(texts: pa.Table, hits: pa.Table, window: int, block: int):
    """Candidate windows of one part: yields (first row, ids, data, spans, counts, text, at, h1, h2) for each block of texts."""
    places: dict[int, list[np.ndarray]] = {}
    marked = {}
    for d, w in zip(hits.column("doc_ids").to_pylist(), hits.column("places").to_pylist(), strict=True):
        d, w = unpack(d), unpack(w)
        order = np.argsort(d, kind="stable")
        d, w = d[order], w[order]
        cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else []
        for i, x in zip(d[cut] if len(d) else [], np.split(w, cut[1:]) if len(d) else [], strict=True):
            places.setdefault(int(i), []).append(x)
    marked = {i: np.unique(np.concatenate(x)) for i, x in places.items()}
    if texts.num_rows == 0:
        return
    ids = texts.column("doc_id").combine_chunks().fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
    for first, data, offsets in text_blocks(texts.column("text")):
        s, e, counts = word_spans(data, offsets)
        edge = np.concatenate([[0], np.cumsum(counts)])
        delta = np.zeros(len(s) + 1, np.int32)
        for t in range(len(counts)):
            b = marked.get(int(ids[first + t]))
            if b is None or counts[t] < window:
                continue
            lo = np.maximum(b - (window - block), 0)
            hi = np.minimum(b, counts[t] - window)
            ok = hi >= lo
            np.add.at(delta, edge[t] + lo[ok], 1)
            np.add.at(delta, edge[t] + hi[ok] + 1, -1)
        want = np.cumsum(delta)[:-1] > 0
        h1 = h2 = np.zeros(0, np.uint64)
        at = np.flatnonzero(want)
        if len(at):
            g = hash_words(data, s, e)
            h1, h2 = hash_runs(g, window)[at], hash_runs(g, window, True)[at]
        yield first, ids, data, s, e, counts, at, h1, h2


_WINDOW_SCHEMA = "range int, part int, h1 binary, h2 binary, repeated binary"


def _distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 96-bit keys in order, whether each occurs more than once, and for each input its key's number."""
    h2 = (h2 >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return a[new], b[new], np.bincount(number, minlength=int(new.sum())) > 1, number


def remove_repeats(docs: DataFrame, window: int = WINDOW, *, carry: list[str] | None = None, whole: bool = False, part_bytes: int = PART_BYTES, least_parts: int = LEAST_PARTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for each row, then the columns in `carry`.
    whole: a text that loses nothing is kept as it is, white space and null included.

    Each word covered by a window of `window` consecutive words whose words also start anywhere else, in the same text
    or another, is removed; windows are judged on the input. Null texts have no words and give ''; rows with equal or
    null ids are texts of their own; empty tables give no rows; columns besides doc_id and text are ignored."""
    carry = carry or []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    block = (window + 1) // 2
    parts = parts_for(text_bytes(docs), part_bytes, least_parts)
    sent = docs.select("doc_id", "text").mapInArrow(_send_anchors(block, parts), _ANCHOR_SCHEMA)
    hits = materialise(sent.groupBy("range").applyInArrow(_answer_anchors(parts), "part int, doc_ids binary, places binary"), "anchors")
    split = _with_part(docs, parts)

    def send(key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        give_back()
        got = [(h1, h2) for *_, h1, h2 in _part_windows(texts, marks, window, block)]
        h1, h2, again, _ = _distinct(np.concatenate([np.zeros(0, np.uint64), *[x[0] for x in got]]), np.concatenate([np.zeros(0, np.uint64), *[x[1] for x in got]]))
        edge = np.searchsorted(_ranges(h1 >> np.uint64(64 - PROBE_BITS), parts), np.arange(parts + 1))
        part = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
        rows = [(i, part, pack_sorted(h1[x:y]), pack(h2[x:y]), np.packbits(again[x:y]).tobytes()) for i, x, y in zip(range(parts), edge[:-1], edge[1:], strict=True) if y > x]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("range", "part", "h1", "h2", "repeated"), cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)})

    def answer(group: pa.Table) -> pa.Table:
        give_back()
        rows = group.to_pydict()
        h1 = [unpack_sorted(x) for x in rows["h1"]]
        size = [len(x) for x in h1]
        h2 = [unpack(x) for x in rows["h2"]]
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows["repeated"], size, strict=True)])
        a, b, several, number = _distinct(np.concatenate(h1), np.concatenate(h2).astype(np.uint64) << np.uint64(32))
        many = several | (np.bincount(number, weights=again, minlength=len(a)) > 0)
        bits = np.split(many[number], np.cumsum(size)[:-1])
        return pa.table({"part": pa.array(rows["part"], pa.int32()), "range": pa.array(rows["range"], pa.int32()), "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})

    windows = split.select("__part", "doc_id", "text").groupBy("__part").cogroup(hits.groupBy("part")).applyInArrow(send, _WINDOW_SCHEMA)
    answers = windows.groupBy("range").applyInArrow(answer, "part int, range int, bits binary")
    marks = hits.select("part", "doc_ids", "places", F.lit(None).cast("int").alias("range"), F.lit(None).cast("binary").alias("bits"))
    both = marks.unionByName(answers.select("part", F.lit(None).cast("binary").alias("doc_ids"), F.lit(None).cast("binary").alias("places"), "range", "bits"))
    both = materialise(both, "repeats")

    def finish(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        give_back()  # of the group before

        blocks = list(_part_windows(texts, told.filter(pc.is_null(told.column("range"))), window, block))
        h1, _, _, number = _distinct(np.concatenate([np.zeros(0, np.uint64), *[x[-2] for x in blocks]]), np.concatenate([np.zeros(0, np.uint64), *[x[-1] for x in blocks]]))
        edge = np.searchsorted(_ranges(h1 >> np.uint64(64 - PROBE_BITS), parts), np.arange(parts + 1))
        many = np.zeros(len(h1), bool)
        bits = told.filter(pc.is_valid(told.column("range")))
        for r, b in zip(bits.column("range").to_pylist(), bits.column("bits").to_pylist(), strict=True):
            many[edge[r] : edge[r + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=edge[r + 1] - edge[r])
        ids, n_words, n_gone, kept, done = [], [], [], [], 0
        for first, doc_ids, data, s, e, counts, at, *_ in blocks:
            start = at[many[number[done : done + len(at)]]]
            done += len(at)
            delta = np.zeros(len(s) + 1, np.int32)
            np.add.at(delta, start, 1)
            np.add.at(delta, start + window, -1)
            gone = np.cumsum(delta)[:-1] > 0
            edge_w = np.concatenate([[0], np.cumsum(counts)])
            raw = data.tobytes()
            for t in range(len(counts)):
                x, y = edge_w[t], edge_w[t + 1]
                lost = gone[x:y]
                n_words.append(int(y - x))
                n_gone.append(int(lost.sum()))
                words = raw[s[x] : e[y - 1]].split() if y > x else []
                kept.append(b" ".join([w for w, g in zip(words, lost.tolist(), strict=True) if not g] if lost.any() else words))
        made = {"doc_id": texts.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        if whole:
            made["kept"] = pc.if_else(pc.equal(made["n_removed"], 0), texts.column("text"), made["kept"])
        return pa.table(made | {f"c{i}": texts.column(f"c{i}") for i in range(len(carry))})

    long, text = T.LongType(), T.StringType()
    schema = T.StructType([T.StructField("doc_id", long), T.StructField("n_words", long), T.StructField("n_removed", long), T.StructField("kept", text), *docs.schema.fields[2:]])
    done = split.groupBy("__part").cogroup(both.groupBy("part")).applyInArrow(finish, schema)
    return done.select("doc_id", "n_words", "n_removed", "kept", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """The same, plainly: (n_words, n_removed, sha256 of the kept text) for each text. For tests."""
    words = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out
