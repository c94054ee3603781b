"""Percentiles by buckets whose bounds are approximate."""

import random

from pyspark.sql import functions as F

from verisift.operators import tables


def test_percentiles_whatever_the_bounds(spark, monkeypatch):
    """Approximate bounds may come out differently each time they are worked out."""
    rng = random.Random(5)
    rows = [(k, round(rng.gammavariate(2, 10), 2)) for k in ("a", "b") for _ in range(4000)]
    bounds = F.udf(lambda low, high: [random.uniform(low, high) for _ in range(63)], "array<double>").asNondeterministic()
    monkeypatch.setattr(tables.F, "percentile_approx", lambda value, *_: bounds(F.min(value), F.max(value)))
    for _ in range(3):
        for r in tables.usage_percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect():
            values = sorted(v for k, v in rows if k == r["k"])
            assert [r["n"], r["p50"], r["p95"], r["p99"]] == [4000, values[2000], values[3800], values[3960]]
