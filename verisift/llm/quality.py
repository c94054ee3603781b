"""Quality classification by co-training.

Two logistic views of a document, its text (hashed words and shape of the text) and its metadata (source, language,
stated and relative length), are fitted on labelled documents, a bounded sample. Over rounds each view labels the unlabelled
documents it is surest of for the other view: of all documents, whose views are written once. What a view may label is told
by the distribution of its log-odds over the documents that are still free; what the other one learns from them is the
second-order sum of their loss, so that the driver gets numbers of the size of a view, however many documents there are.
The views' outputs are calibrated on labelled documents held out of the fit and combined in log-odds, weighted by how well
each view does there. All documents are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import _LOWER, hash_words, lean, materialise, text_blocks, word_spans

WORD_DIM, SHAPE_DIM, META_DIM = 512, 12, 96
#: Labelled documents that the views are fitted on, at most: those whose ids have the smallest hashes.
FIT_LABELLED = 6000
#: Rounds, share of the free documents that a view labels in one, log-odds from which it may, weight of such a label.
ROUNDS, GIVEN_PER_ROUND, SURE, GIVEN_WEIGHT = 4, 0.1, 1.0, 0.5
#: Steps of log-odds that are told apart, and how far.
STEP, FARTHEST = 0.01, 30.0
#: Parts of the fitting rows, each scored by fits on the others, that show if a view can teach.
FOLDS = 3
KEEP_FROM = 0.5


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Word hashes (square root of frequency, scaled to length one) and shape features of each text."""
    n = len(offsets) - 1
    low = _LOWER[data]
    s, e, counts = word_spans(low, offsets)
    h = hash_words(low, s, e)
    text = np.repeat(np.arange(n), counts)
    x = np.sqrt(np.bincount(text * WORD_DIM + (h >> np.uint64(55)).astype(np.int64), minlength=n * WORD_DIM).reshape(n, WORD_DIM))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    which = np.repeat(np.arange(n), np.diff(offsets))
    share = lambda m: np.bincount(which[m], minlength=n) / np.maximum(np.diff(offsets), 1)
    kind = np.zeros(256, np.int8)
    kind[65:91], kind[48:58], kind[[33, 35, 36, 37, 38, 42, 60, 61, 62, 64, 91, 93, 95, 123, 124, 125, 126]], kind[[46, 44]] = 1, 2, 3, 4
    kinds = kind[data]
    words = np.maximum(counts, 1)
    order = np.lexsort((h, text))
    hs, ts = h[order], text[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
    same_next = np.bincount(text[1:][(h[1:] == h[:-1]) & (text[1:] == text[:-1])], minlength=n) / words if len(h) > 1 else np.zeros(n)
    distinct = np.bincount(ts[new], minlength=n) / words
    shape = [share(kinds == 1), share(kinds == 2), share(kinds == 3), share(kinds == 4), same_next, distinct, (counts == 0) * 1.0, np.minimum(counts, 50) / 50, np.minimum(np.log1p(counts) / 10, 1), np.minimum(np.diff(offsets) / words / 20, 2), share(data == 10), np.ones(n)]
    return np.concatenate([x * 2, np.array(shape).T * 3], axis=1).astype(np.float32)


def meta_view(source: list, lang: list, n_chars: list, sizes: np.ndarray) -> np.ndarray:
    """Hashed source and language and the stated length in steps; nulls have slots of their own."""
    x = np.zeros((len(source), META_DIM), np.float32)
    slot = lambda v, lo, n: lo + zlib.crc32(("" if v is None else "=" + str(v)).encode()) % n
    for i, (s, g, c) in enumerate(zip(source, lang, n_chars, strict=True)):
        x[i, slot(s, 0, 48)] = 1
        x[i, slot(g, 48, 16)] = 1
        x[i, 64 if c is None else 65 + min(20, int(np.log2(max(c, 1) + 1)))] = 1
        x[i, 90] = c is not None and abs(c - sizes[i]) > 0.2 * max(c, 1)
    x[:, META_DIM - 1] = 1
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, ridge: float = 1e-3, given: Given | None = None) -> np.ndarray:
    """Weights of a balanced ridge logistic regression, by momentum gradient steps. given: further rows by the second-order
    sums of their loss around some weights."""
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    if not len(y):
        return w
    x = x.astype(float)  # once, not in every step
    more = [GIVEN_WEIGHT * n for n in given.n] if given else [0.0, 0.0]
    pos, neg = max(float(weight[y > 0.5].sum()) + more[1], 1e-9), max(float(weight[y <= 0.5].sum()) + more[0], 1e-9)
    c = weight * np.where(y > 0.5, 0.5 / pos, 0.5 / neg)
    bound = 0.25 * float((c * (x**2).sum(axis=1)).sum()) + ridge
    if given:
        share = [GIVEN_WEIGHT * 0.5 / neg, GIVEN_WEIGHT * 0.5 / pos]
        slope, bend = (sum(k * part[i] for i, k in enumerate(share)) for part in (given.slope, given.bend))
        bound += float(np.trace(bend))
    rate = 1.0 / bound
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (p - y)) + ridge * w
        if given:
            g = g + slope + bend @ (w - given.around)
        v = 0.9 * v - rate * g
        w = w + v
    return w


@dataclass
class Given:
    """Pseudo-labelled documents of a view: for labels 0 and 1 their number, and slope and bend of their loss around weights."""

    around: np.ndarray
    n: np.ndarray
    slope: np.ndarray
    bend: np.ndarray


#: What a view labelled: the view, its weights, and log-odds below and above which documents got labels 0 and 1.
Rule = tuple[int, np.ndarray, float, float]


def told(rules: list[Rule], t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The view that each document was labelled for (-1: free) and the label: the first rule that takes it counts."""
    to, label = np.full(len(t), -1), np.zeros(len(t), np.int64)
    for k, w, low, high in rules:
        z = (t, m)[k] @ w
        for hit, value in (((to < 0) & (z < low), 0), ((to < 0) & (z > high), 1)):
            to[hit], label[hit] = 1 - k, value
    return to, label


def spread_of(rules: list[Rule], k: int, w: np.ndarray, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the log-odds that a view gives the free documents, and how many have each."""
    z = ((t, m)[k] @ w)[told(rules, t, m)[0] < 0]
    return np.unique(np.floor(np.clip(z, -FARTHEST, FARTHEST) / STEP).astype(np.int64), return_counts=True)


def sums_of(rules: list[Rule], k: int, w: np.ndarray, t: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For labels 0 and 1 a table of a view's pseudo-labelled documents: rows of bend, then slope, then their number."""
    to, label = told(rules, t, m)
    out = np.zeros((2, len(w) + 2, len(w)))
    for value in (0, 1):
        x = (t, m)[k][(to == k) & (label == value)].astype(float)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        out[value, : len(w)] = (x * (p * (1 - p))[:, None]).T @ x
        out[value, len(w)] = x.T @ (p - value)
        out[value, len(w) + 1, 0] = len(x)
    return out


class ArrayPool:
    """Unlabelled documents as arrays of both views."""

    def __init__(self, t: np.ndarray, m: np.ndarray):
        self.views = t, m

    def spread(self, rules: list[Rule], k: int, w: np.ndarray) -> dict[int, int]:
        return dict(zip(*(x.tolist() for x in spread_of(rules, k, w, *self.views)), strict=True))

    def sums(self, rules: list[Rule], k: int, w: np.ndarray) -> np.ndarray:
        return sums_of(rules, k, w, *self.views)


class TablePool:
    """Unlabelled documents as a table of both views (t, m: packed half-precision numbers): each question is one pass, whose
    answer is summed on the cluster."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _pass(self, one, schema: str, names: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if len(batch):
                    t, m = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<f2").astype(np.float32).reshape(len(batch), -1) for i in (0, 1))
                    total = one(total, t, m)
            if total is not None:
                yield from (pa.RecordBatch.from_pydict(dict(zip(names, part, strict=True))) for part in total.parts())

        return self.rows.select("t", "m").mapInArrow(lean(run), schema)

    def spread(self, rules: list[Rule], k: int, w: np.ndarray) -> dict[int, int]:
        class Counts(dict):
            def parts(self):
                yield pa.array(self.keys(), pa.int64()), pa.array(self.values(), pa.int64())

        def one(total, t, m):
            total = Counts() if total is None else total
            for step, n in zip(*(x.tolist() for x in spread_of(rules, k, w, t, m)), strict=True):
                total[step] = total.get(step, 0) + n
            return total

        got = self._pass(one, "step long, n long", ["step", "n"]).groupBy("step").agg(F.sum("n").alias("n"))
        return {r["step"]: r["n"] for r in got.collect()}  # at most 2 * FARTHEST / STEP steps

    def sums(self, rules: list[Rule], k: int, w: np.ndarray) -> np.ndarray:
        class Table:
            def __init__(self, of):
                self.of = of

            def parts(self):
                flat = self.of.reshape(-1, self.of.shape[-1])
                yield pa.array(np.arange(len(flat))), pa.array([x.tobytes() for x in flat], pa.binary())

        def one(total, t, m):
            made = sums_of(rules, k, w, t, m)
            return Table(made if total is None else total.of + made)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of the rows of one place, as they stream by in order."""
            at, held = None, None
            for batch in batches:
                for place, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    row = np.frombuffer(row, float)
                    if place != at:
                        if at is not None:
                            yield pa.RecordBatch.from_pydict({"place": pa.array([at], pa.int64()), "row": pa.array([held.tobytes()], pa.binary())})
                        at, held = place, row
                    else:
                        held = held + row
            if at is not None:
                yield pa.RecordBatch.from_pydict({"place": pa.array([at], pa.int64()), "row": pa.array([held.tobytes()], pa.binary())})

        parts = self._pass(one, "place long, row binary", ["place", "row"])
        out = np.zeros((2 * (len(w) + 2), len(w)))
        for r in parts.repartition("place").sortWithinPartitions("place").mapInArrow(added, "place long, row binary").collect():  # a row for each number of a view
            out[r["place"]] = np.frombuffer(r["row"], float)
        return out.reshape(2, len(w) + 2, len(w))


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    #: For each view: slope and shift of its log-odds; weight in the sum.
    calibration: list[tuple[float, float, float]]

    def score(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        total = np.zeros(len(t))
        for z, (slope, shift, weight) in zip((t @ self.text, m @ self.meta), self.calibration, strict=True):
            total += weight * (slope * z + shift)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _auc(y: np.ndarray, z: np.ndarray) -> float:
    if not 0 < y.sum() < len(y):
        return 0.5
    rank = np.empty(len(z))
    rank[np.argsort(z, kind="stable")] = np.arange(1, len(z) + 1)
    pos = y.sum()
    return float((rank[y > 0.5].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def _limits(spread: dict[int, int]) -> tuple[float, float]:
    """Log-odds below and above which a view labels: GIVEN_PER_ROUND of the free documents, half on either side, with all
    that are equal to the last of them; only as far as the view is SURE."""
    steps = sorted(spread)
    n = max(1, int(GIVEN_PER_ROUND * sum(spread.values()) / 2))
    low = high = None
    for order, sign in ((steps, 1), (steps[::-1], -1)):
        got = 0
        for step in order:
            got += spread[step]
            if got >= n:
                break
        if sign > 0:
            low = min((step + 1) * STEP, -SURE)
        else:
            high = max(step * STEP, SURE)
    return low, high


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, pool: ArrayPool | TablePool) -> Model:
    """Fit both views on most labelled rows, exchange confident pseudo-labels over the pool, calibrate on the rest."""
    held = np.arange(len(y)) % 4 == 3
    views, ys = [t, m], y[~held]
    base = [v[~held] for v in views]
    rules: list[Rule] = []
    given: list[Given | None] = [None, None]
    ones, fold = np.ones(len(ys)), np.random.default_rng(5).permutation(len(ys)) % FOLDS

    def held_out_auc(k: int) -> float:
        """AUC of a view on its fitting rows, each scored by a fit without its fold (with the view's pseudo-labels)."""
        z = np.zeros(len(ys))
        for f in range(FOLDS):
            use = fold != f
            z[~use] = base[k][~use] @ fit_logistic(base[k][use], ys[use], ones[use], given=given[k])
        return _auc(ys, z)

    w = [fit_logistic(base[k], ys, ones) for k in (0, 1)]
    auc = [held_out_auc(k) for k in (0, 1)]
    for _ in range(ROUNDS if 0 < ys.sum() < len(ys) else 0):
        before = len(rules)
        for k in (0, 1):
            if auc[k] < 0.7:  # a view that can't tell good from bad teaches nothing
                continue
            spread = pool.spread(rules, k, w[k])
            if spread:
                rules.append((k, w[k], *_limits(spread)))
        if len(rules) == before:
            break
        for k in (0, 1):
            if any(teacher == 1 - k for teacher, *_ in rules):
                s = pool.sums(rules, k, w[k])
                given[k] = Given(w[k], s[:, -1, 0], s[:, -2], s[:, :-2])
                w[k] = fit_logistic(base[k], ys, ones, given=given[k])
                auc[k] = held_out_auc(k)
    calibration = []
    for k in (0, 1):
        z, yh = views[k][held] @ w[k], y[held]
        a = fit_logistic(np.stack([z, np.ones(len(z))], 1), yh, np.ones(len(yh))) if 0 < yh.sum() < len(yh) else np.array([1.0, 0.0])
        calibration.append((max(float(a[0]), 0.0), float(a[1]), max(0.0, 2 * _auc(yh, z) - 1)))
    total = sum(c[2] for c in calibration) or 1.0
    return Model(w[0], w[1], [(a, b, c / total) for a, b, c in calibration])


def _views(batch: pa.RecordBatch):
    """Blocks of rows with both views: (first, text view, metadata view)."""
    source, lang, n_chars = (batch.column(i).to_pylist() for i in (2, 3, 4))
    for at, data, offsets in text_blocks(batch.column(1)):
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        yield at, text_view(data, offsets), meta_view(source[at : at + n], lang[at : at + n], n_chars[at : at + n], sizes)


def _columns(docs: DataFrame) -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = FIT_LABELLED) -> Model:
    """Fit on documents that labels has a quality (0 or 1) for, the smallest one where it has several, and on all others
    without labels. At most `labelled` of the former, by the smallest hashes of their ids; of repeated ids one row."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    have = docs.select(F.col("doc_id").cast("long").alias("id"))
    drawn = known.join(have, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(labelled).collect()  # at most `labelled` rows
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in drawn], "id long, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, t, m in _views(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(t)), pa.array([x.astype("<f2").tobytes() for x in t], pa.binary()), pa.array([x.astype("<f2").tobytes() for x in m], pa.binary())], names=["doc_id", "t", "m"])

    rows = materialise(docs.select(*_columns(docs)).mapInArrow(lean(run), "doc_id long, t binary, m binary"), "views")
    few = F.broadcast(ids)
    taken = rows.join(few, rows["doc_id"] == ids["id"]).groupBy("id", "quality").agg(F.min(F.struct("t", "m")).alias("v")).collect()
    free = rows.join(few, rows["doc_id"] == ids["id"], "left_anti")
    got = sorted(((r["quality"], r["id"], bytes(r["v"]["t"]), bytes(r["v"]["m"])) for r in taken), key=lambda r: (zlib.crc32(str(r[1]).encode()), r[1]))
    array = lambda k, d: np.array([np.frombuffer(r[k], "<f2") for r in got], np.float32).reshape(len(got), d)
    return co_train(array(2, WORD_DIM + SHAPE_DIM), array(3, META_DIM), np.array([min(r[0], 1) for r in got], float), TablePool(free))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, larger is better) and keep for each row.

    Null texts count as empty; null metadata has a value of its own; rows are scored one by one, so repeated rows, ties,
    null ids and extra columns make no difference; an empty table gives no rows. Without labels all scores are 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, t, m in _views(batch):
                s = model.score(t, m)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(t)), pa.array(s), pa.array(s >= KEEP_FROM)], names=["doc_id", "score", "keep"])

    return docs.select(*_columns(docs)).mapInArrow(run, "doc_id long, score double, keep boolean")
