"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors become integers, floor(64 * x). Pivots, the means of a bounded sample's clusters, divide the data into cells; each
cell has a summary (pivot, radius, count). Queries are grouped by their nearest pivot, cut into blocks, and first solved in
their own cell and, if that is small, the next ones; this gives each query a score that enough candidates reach. A cell then
matters to a query only if its upper bound <q, pivot> + |q| * radius reaches that score. Each cell is met by the queries that
it matters to alone, in packed pieces of bounded size, solved as matrix products; partial lists are merged as they stream by,
in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import materialise, mix

SCALE = 64
#: Vectors that the pivots are chosen from, at most (about); pivots; rows of a data block and of a query block.
PIVOT_SAMPLE, PIVOTS, DATA_BLOCK, QUERY_BLOCK = 4096, 48, 4096, 512
#: Rounds of moving pivots to the means of their cells.
ROUNDS = 8
_EXACT = float(1 << 52)


def to_ints(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id and integer components of vectors that take part: not null or empty, all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vec_col)
    rows = vectors.filter(v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull())
    rows = rows.filter(~F.exists(v, lambda x: F.coalesce(bad(x.cast("double")), F.lit(True))))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(col: pa.Array) -> list[np.ndarray]:
    """Rows of an Arrow list column as int64 arrays."""
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy()
    return [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


def choose_pivots(ints: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots for each vector length: means of the clusters of a bounded, hash-drawn sample. They begin at evenly spaced rows
    of the sorted sample, and a pivot that loses its rows moves to the row farthest from its own, so that cells balance."""
    total = ints.count()
    share = min(1.0, PIVOT_SAMPLE / max(total, 1))
    got = ints.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) <= F.lit(share * 1_000_003)).select("v").limit(4 * PIVOT_SAMPLE).collect()
    by: dict[int, list] = {}
    for (v,) in got:
        by.setdefault(len(v), []).append(v)
    out = {}
    for size, rows in by.items():
        x = np.array(sorted(rows), float)
        x = np.unique(x, axis=0)
        c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
        for _ in range(ROUNDS):
            d2 = (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)
            own = d2.argmin(axis=1)
            held = np.bincount(own, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            c = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], c)
            empty = np.flatnonzero(held == 0)
            if len(empty):
                c[empty] = x[np.argsort(-d2[np.arange(len(x)), own], kind="stable")[: len(empty)]]
        out[size] = c
    return out


CELL_SCHEMA = "dim int, cell int, vec_id long, v array<long>, far double, norm double"


def assign(ints: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Each vector with its cell (nearest pivot of its length; length unseen in the sample: cell 0 around the origin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1))
            dim = np.array([len(r) for r in rows], np.int32)
            cell, far, norm = np.zeros(len(rows), np.int32), np.zeros(len(rows)), np.zeros(len(rows))
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = np.array([rows[i] for i in at], float)
                p = pivots.get(int(d), np.zeros((1, d)))
                d2 = (x**2).sum(axis=1)[:, None] - 2 * x @ p.T + (p**2).sum(axis=1)
                cell[at] = d2.argmin(axis=1)
                far[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(axis=1))
                norm[at] = np.sqrt((x**2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(dim), pa.array(cell), batch.column(0), batch.column(1), pa.array(far), pa.array(norm)], names=["dim", "cell", "vec_id", "v", "far", "norm"])

    return ints.mapInArrow(run, CELL_SCHEMA)


BLOCK_SCHEMA = "dim int, cell int, block long, n int, norm double, ids binary, m binary"


def blocks(cells: DataFrame, each: int) -> DataFrame:
    """Rows of a cell packed into blocks of at most `each`. A cell is dealt out by a salt in proportion to its size, so
    that no task gets a whole large cell."""
    size = cells.groupBy("dim", "cell").agg(F.count("*").alias("cell_n"))
    salted = cells.join(F.broadcast(size), ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "far"), F.ceil(F.col("cell_n") / F.lit(each))))
    dealt = salted.repartition("dim", "cell", "salt").sortWithinPartitions("dim", "cell", "salt", "vec_id").select("dim", "cell", "salt", "vec_id", "v", "norm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, norm, n = None, [], [], 0.0, 0

        def made():
            m = np.array(rows, "<i8")
            block = int(mix(np.array([len(ids) + 1], np.uint64) ^ mix(np.array([ids[0]], np.int64).view(np.uint64)) + np.uint64(n))[0] >> np.uint64(1))
            cols = [[key[0]], [key[1]], [block], [len(ids)], [norm], [np.array(ids, "<i8").tobytes()], [m.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["dim", "cell", "block", "n", "norm", "ids", "m"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            got, vs, norms = batch.column(3).to_pylist(), _matrix(batch.column(4)), batch.column(5).to_pylist()
            for k, i, v, w in zip(keys, got, vs, norms, strict=True):
                if ids and (k != key or len(ids) >= each):
                    yield made()
                    ids, rows, norm, n = [], [], 0.0, n + 1
                key = k
                ids.append(i)
                rows.append(v)
                norm = max(norm, w)
        if ids:
            yield made()

    return dealt.mapInArrow(run, BLOCK_SCHEMA)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; one that 64 bits may not hold is an error."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most >= float(1 << 62):
        raise ValueError("inner products beyond 62 bits")
    return np.rint(q.astype(float) @ x.T.astype(float)).astype(np.int64) if most < _EXACT else q @ x.T


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then smaller id; ids: one row or a row for each. Cut exactly at ties."""
    ids = np.broadcast_to(ids, score.shape)
    if score.shape[1] > 4 * k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        width = int((score >= least[:, None]).sum(axis=1).max())
        if width < score.shape[1] // 2:
            at = np.argpartition(-score, width - 1, axis=1)[:, :width]
            score, ids = np.take_along_axis(score, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


NONE = -(1 << 62)  # its negative is a valid integer too


def _merge(score: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return _top(np.concatenate([score, more], 1), np.concatenate([ids, more_ids], 1), k)


#: Partial lists: a block of queries, its ids and their own scores, which of them (by place) the lists are of, and the lists.
PART_SCHEMA = "q_block long, salt int, q_ids binary, own binary, places binary, width int, scores binary, ids binary"
_PART = pa.schema([("q_block", pa.int64()), ("salt", pa.int32()), ("q_ids", pa.binary()), ("own", pa.binary()), ("places", pa.binary()), ("width", pa.int32()), ("scores", pa.binary()), ("ids", pa.binary())])


def _fold(k: int):
    """Partial lists, sorted by block and salt, merged to one list for each, as they stream by: one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = None

        def made() -> pa.RecordBatch:
            (q_ids, own), score, ids = held
            n = len(score)
            return pa.RecordBatch.from_pylist([{"q_block": key[0], "salt": key[1], "q_ids": q_ids, "own": own, "places": np.arange(n, dtype="<i4").tobytes(), "width": score.shape[1], "scores": score.astype("<i8").tobytes(), "ids": ids.astype("<i8").tobytes()}], schema=_PART)

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if (r["q_block"], r["salt"]) != key:
                    if held is not None:
                        yield made()
                    n = len(r["q_ids"]) // 8
                    key, held = (r["q_block"], r["salt"]), ((r["q_ids"], r["own"]), np.full((n, k), NONE), np.full((n, k), NONE))
                places = np.frombuffer(r["places"], "<i4")
                score, ids = (np.frombuffer(r[c], "<i8").reshape(len(places), r["width"]) for c in ("scores", "ids"))
                held[1][places], held[2][places] = _merge(held[1][places], held[2][places], score, ids, k)
        if held is not None:
            yield made()

    return run


def _merged(parts: DataFrame, k: int, salts: int) -> DataFrame:
    """One list for each block of queries: partial lists of a block are first merged in `salts` groups."""
    once = parts.repartition("q_block", "salt").sortWithinPartitions("q_block", "salt").mapInArrow(_fold(k), PART_SCHEMA)
    if salts > 1:
        once = once.withColumn("salt", F.lit(0)).repartition("q_block").sortWithinPartitions("q_block").mapInArrow(_fold(k), PART_SCHEMA)
    return once


def search(queries: DataFrame, data: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, among: bool = True, seen: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates (all, if fewer), ties to smaller vec_id.

    Vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part. among: the
    queries are rows of data, and a query's candidates are all rows of the same length but its own one; other rows are
    candidates even if they share its id. If not, all rows are candidates. Tables without vectors give no rows; columns
    besides the two named are ignored. Inner products that 64 bits may not hold are an error. seen: gets the number of (query,
    row) pairs that were multiplied under "pairs", by an extra pass, to tell what the bounds spare."""
    ints = to_ints(data, id_col, vec_col, scale)
    pivots = choose_pivots(ints)
    cells = materialise(assign(ints, pivots), "cells")
    d_blocks = materialise(blocks(cells, DATA_BLOCK), "blocks")
    q_blocks = materialise(blocks(assign(to_ints(queries, id_col, vec_col, scale), pivots), QUERY_BLOCK).withColumnRenamed("block", "q_block"), "queries")
    most = k + among  # the query's own row is found with the others, and taken out at the end
    #: At most PIVOTS summaries for each vector length.
    summary = {(r["dim"], r["cell"]): (r["n"], r["far"]) for r in cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    salts = max(1, int(d_blocks.count() ** 0.5))

    def cell_bounds(dim: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of this length and for each query the most a candidate in each can score."""
        own = sorted(c for d, c in summary if d == dim)
        if not own:
            return np.zeros(0, int), np.zeros((len(q), 0))
        p = pivots.get(dim, np.zeros((1, dim)))[own]
        far = np.array([summary[dim, c][1] for c in own])
        norm = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        return np.array(own), q.astype(float) @ p.T + norm[:, None] * far + 1e-6 * (1 + norm[:, None]) * (1 + np.abs(p).max(initial=0) + far)

    ask_schema = "dim int, cell int, q_block long, q_ids binary, own binary, places binary, q binary"
    _ask = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("q_block", pa.int64()), ("q_ids", pa.binary()), ("own", pa.binary()), ("places", pa.binary()), ("q", pa.binary())])

    def ask(r: dict, q: np.ndarray, cell: int, places: np.ndarray) -> dict:
        own = (q * q).sum(axis=1)
        return {"dim": r["dim"], "cell": int(cell), "q_block": r["q_block"], "q_ids": r["ids"], "own": own.astype("<i8").tobytes(), "places": places.astype("<i4").tobytes(), "q": q[places].tobytes()}

    def near(r: dict, q: np.ndarray) -> list[int]:
        """The cells nearest to a block of queries that together hold enough candidates; its own one first."""
        own, bound = cell_bounds(r["dim"], q)
        order = [int(own[i]) for i in np.argsort(-bound.max(axis=0, initial=-np.inf), kind="stable")]
        order.sort(key=lambda c: c != r["cell"])
        need, got = [], 0
        for c in order:
            if got < most:
                need.append(c)
                got += summary[r["dim"], c][0]
        return need

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["m"], "<i8").reshape(r["n"], -1)
                yield pa.RecordBatch.from_pylist([ask(r, q, c, np.arange(len(q))) for c in near(r, q)], schema=_ask)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells outside a block's homes, each with the queries that it can still hold one of the best of."""
        for batch in batches:
            for r in batch.to_pylist():
                q = np.frombuffer(r["m"], "<i8").reshape(r["n"], -1)
                own, bound = cell_bounds(r["dim"], q)
                least = np.frombuffer(r["scores"], "<i8").reshape(len(q), -1)[:, -1].astype(float)
                open_, home = bound >= least[:, None], set(near(r, q))
                yield pa.RecordBatch.from_pylist([ask(r, q, c, np.flatnonzero(open_[:, i])) for i, c in enumerate(own) if int(c) not in home and open_[:, i].any()], schema=_ask)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                places, ids = np.frombuffer(r["places"], "<i4"), np.frombuffer(r["ids"], "<i8")
                score, best = _top(_scores(np.frombuffer(r["q"], "<i8").reshape(len(places), -1), np.frombuffer(r["m"], "<i8").reshape(len(ids), -1)), ids, most)
                yield pa.RecordBatch.from_pylist([{**{c: r[c] for c in ("q_block", "salt", "q_ids", "own", "places")}, "width": score.shape[1], "scores": np.ascontiguousarray(score).tobytes(), "ids": np.ascontiguousarray(best).tobytes()}], schema=_PART)

    def pairs(asked: DataFrame) -> DataFrame:
        rows = d_blocks.select("dim", "cell", "ids", "m", F.pmod("block", F.lit(salts)).cast("int").alias("salt"))
        return asked.join(rows, ["dim", "cell"]).select("q_block", "salt", "q_ids", "own", "places", "q", "ids", "m")

    home = q_blocks.mapInArrow(homes, ask_schema)
    first = materialise(_merged(pairs(home).mapInArrow(solve, PART_SCHEMA), most, salts), "first")
    rest = q_blocks.join(first.select("q_block", "scores"), "q_block").select("dim", "cell", "q_block", "n", "ids", "m", "scores").mapInArrow(others, ask_schema)
    if seen is not None:
        seen["pairs"] = home.unionByName(rest).join(d_blocks.select("dim", "cell", "n"), ["dim", "cell"]).agg(F.sum(F.octet_length("places") / 4 * F.col("n"))).first()[0]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, own = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["own"], "<i8")
                score, ids = (np.frombuffer(r[c], "<i8").reshape(len(q_ids), -1) for c in ("scores", "ids"))
                there = score != NONE
                if among:  # of rows equal to a query's own in id and score any one may go
                    mine = there & (ids == q_ids[:, None]) & (score == own[:, None])
                    mine &= mine.cumsum(axis=1) == 1
                    there &= ~mine
                rank = there.cumsum(axis=1)
                at, col = np.nonzero(there & (rank <= k))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(rank[at, col].astype(np.int32)), pa.array(ids[at, col]), pa.array(score[at, col])], names=["query_id", "rank", "vec_id", "score"])

    parts = first.unionByName(pairs(rest).mapInArrow(solve, PART_SCHEMA))
    return _merged(parts, most, salts).mapInArrow(final, "query_id long, rank int, vec_id long, score long")
