"""Stateful streams against plain simulations of what they must do, over several micro-batches."""

import math
import tempfile

import pytest
from pyspark.sql import functions as F

from verisift.streaming import stateful


@pytest.fixture(scope="module")
def calls(spark):
    """1,200 calls of 19 keys over three days, in four files that are four micro-batches."""
    rows = spark.range(1200).select(F.col("id"), F.concat(F.lit("o"), (F.col("id") * F.col("id") % 37).cast("string")).alias("who"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 200 + (F.col("id") * 31 % 97)).alias("ts"))
    folder = tempfile.mkdtemp()
    for i in range(4):
        rows.filter(f"id >= {i * 300} AND id < {i * 300 + 300}").coalesce(1).write.mode("append").parquet(folder)
    return folder, rows.schema, [(r["id"], r["who"], r["ts"].timestamp()) for r in rows.collect()]


def stream(spark, calls):
    return spark.readStream.schema(calls[1]).option("maxFilesPerTrigger", 1).parquet(calls[0])


def collect(spark, made, name):
    q = made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return {r["tie"]: r for r in spark.table(name).collect()}


def batches(calls):
    """The micro-batches in the order of the files, rows by time."""
    rows = calls[2]
    return [sorted(rows[i : i + 300], key=lambda r: (r[2], r[0])) for i in range(0, 1200, 300)]


def test_rule_cache(spark, calls):
    made = collect(spark, stateful.rule_cache_stream(stream(spark, calls), key="who", most=12, ttl=9000, shards=1, late="10 days"), "cache")
    held, want = {}, {}
    for rows in batches(calls):
        for i, who, t in rows:
            hit, gone = who in held and t - held[who] < 9000, None
            if not hit:
                if len(held) >= 12:
                    gone = next(iter(held))
                    del held[gone]
                held[who] = t
            want[i] = (hit, gone)
    assert {i: (r["hit"], r["evicted"]) for i, r in made.items()} == want and 0 < sum(h for h, _ in want.values()) < 1200


def test_buckets_are_bounded(spark, calls):
    made = collect(spark, stateful.bounded_bucket_stream(stream(spark, calls), 0.005, 1.995, key="who", tie="id", most=15, shards=1, late="10 days"), "buckets")
    full, rate, held, want = 2.0, 0.005 / 60, {}, {}
    for rows in batches(calls):
        held = dict(sorted(held.items(), key=lambda x: x[1][1]))
        for i, who, t in rows:
            left, last = held.pop(who, (full, t))
            left = min(full, left + max(0.0, t - last) * rate)
            if len(held) >= 15:
                for k in list(held)[:64]:
                    if t - held[k][1] >= 300 and held[k][0] + (t - held[k][1]) * rate >= full:
                        del held[k]
            while len(held) >= 15:
                del held[next(iter(held))]
            ok = left >= 1
            want[i] = (ok, 0 if ok else max(1, math.ceil((1 - left) / rate)))
            held[who] = (left - ok, t)
    assert {i: (r["allowed"], r["retry_seconds"]) for i, r in made.items()} == want


def test_daily_quota_and_late_rows(spark, calls):
    made = collect(spark, stateful.client_quota_stream(stream(spark, calls), 4, key="who", tie="id", shards=3, late="10 days"), "quota")
    day, served, want = {}, {}, {}
    for rows in batches(calls):
        for i, who, t in rows:
            d = int(t // 86400)
            late = d < day.get(who, d)
            if not late and d > day.get(who, -1):
                day[who], served[who] = d, 0
            want[i] = (not late and served[who] < 4, late)
            served[who] += want[i][0]
    assert {i: (r["allowed"], r["late"]) for i, r in made.items()} == want


def test_sink_replaces_a_replayed_batch(spark, calls):
    path, checkpoint = tempfile.mkdtemp() + "/usage", tempfile.mkdtemp()
    assert stateful.append_usage(stream(spark, calls), path, checkpoint).awaitTermination(120)
    assert spark.read.json(path).count() == 1200
    first = spark.read.json(path).filter("batch = 0").drop("batch")
    stateful.write_batch(spark.createDataFrame(first.collect(), first.schema), 0, path)
    assert spark.read.json(path).count() == 1200 and spark.read.json(path).select("id").distinct().count() == 1200
    assert stateful.append_usage(stream(spark, calls), path, checkpoint).awaitTermination(120) and spark.read.json(path).count() == 1200
