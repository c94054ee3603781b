"""Exact top-k search: balanced cells, pruning on clustered vectors, rows that share an id, hot cells, ties."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.llm import topk_search

SCHEMA = "vec_id long, embedding array<double>, cell int"


def brute(queries, rows, k, among=True):
    """Sorted (query_id, rank, vec_id, score) by definition: a query row's own row, by position, is no candidate."""
    ints = lambda v: [int(np.floor(64 * x)) for x in v]
    out = []
    for at, (q, v) in queries:
        own = ints(v)
        scored = sorted((-sum(a * b for a, b in zip(own, ints(w), strict=True)), i) for j, (i, w) in enumerate(rows) if (not among or j != at) and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, wanted, k, **options):
    data = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk_search.search(data.filter(wanted), data, k, **options).collect())


def clustered(n=2000, dims=8, clusters=20):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 10) for _ in range(dims)] for _ in range(clusters)]
    return [(i, [c + rng.gauss(0, 0.2) for c in centres[i % clusters]]) for i in range(n)]


def test_cells_balance_and_bounds_prune(spark):
    rows = clustered()
    data = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    ints = topk_search.to_ints(data, "vec_id", "embedding")
    cells = topk_search.assign(ints, topk_search.choose_pivots(ints)).groupBy("cell").count().agg(F.max("count")).first()[0]
    assert cells <= 300
    seen = {}
    got = run(spark, rows, "vec_id % 100 = 0", 10, seen=seen)
    assert got == brute([(i, r) for i, r in enumerate(rows) if r[0] % 100 == 0], rows, 10)
    assert seen["pairs"] < 0.35 * 20 * len(rows)


def test_rows_that_share_an_id(spark):
    rng = random.Random(1)
    rows = [(i % 40, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (7, rows[0][1])]
    for k in (1, 3, 250):
        got = run(spark, rows, "vec_id = 0", k)
        assert got == brute([(i, r) for i, r in enumerate(rows) if r[0] == 0], rows, k)
    other = run(spark, rows, "vec_id = 0", 3, among=False)
    assert other == brute([(i, r) for i, r in enumerate(rows) if r[0] == 0], rows, 3, among=False)


def test_hot_cell_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "DATA_BLOCK", 64)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 8)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i % 7), 0.5, -1.0]) for i in range(900)] + [(1000, [1.0]), (1020, [2.0]), (1040, [])]
    got = run(spark, rows, "vec_id % 20 = 0", 5)
    assert got == brute([(i, r) for i, r in enumerate(rows) if r[0] % 20 == 0 and r[1]], rows, 5)
    assert max(collections.Counter(q for q, *_ in got).values()) == 5


def test_too_large_products_are_an_error(spark):
    with pytest.raises(Exception, match="beyond 62 bits"):
        run(spark, [(0, [1e15, 1.0]), (1, [1e15, 1.0])], "vec_id = 0", 1)
