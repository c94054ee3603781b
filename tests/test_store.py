"""The keyed table: merges touch only their buckets, later writes win, deletions, expiry and retention."""

import os
import tempfile

from pyspark.sql import functions as F

from verisift.functions.common import shared_path
from verisift.operators.store import KeyedTable

SCHEMA = "key string, seq long, stored_at timestamp, expires_at timestamp, bytes long"


def rows(spark, *items):
    made = spark.createDataFrame([(k, s, at, at + live, b) for k, s, at, live, b in items], "key string, seq long, a long, e long, bytes long")
    return made.select("key", "seq", F.timestamp_seconds("a").alias("stored_at"), F.timestamp_seconds("e").alias("expires_at"), "bytes")


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def held(t):
    return {r["key"]: r["seq"] for r in t.rows().collect()}


def test_merge_rewrites_touched_buckets(spark):
    path = tempfile.mkdtemp() + "/t"
    t = KeyedTable(spark, path, SCHEMA, buckets=8)
    assert t.rows().collect() == [] and t.get(rows(spark, ("a", 1, 1, 1, 1)).select("key"), F.lit(0).cast("timestamp")).collect()[0]["hit"] is False
    t.put(rows(spark, *[(f"k{i}", i, 100 + i, 50, 10) for i in range(40)], (None, 1, 1, 1, 1), ("k3", 99, 500, 50, 1), ("k3", 98, 500, 50, 1)))
    assert len(held(t)) == 40 and held(t)["k3"] == 99
    before = files(path)
    touched = t.put(rows(spark, ("k5", 77, 400, 50, 2), ("k6", 1, 1, 50, 2)))
    assert 1 <= len(touched) <= 2 and held(t)["k5"] == 77 and held(t)["k6"] == 6
    assert all(f"bucket={b}/" in f for f in before ^ files(path) for b in [int(f.split("bucket=")[1].split("/")[0])] if b in touched)
    assert {f for f in before ^ files(path) if int(f.split("bucket=")[1].split("/")[0]) not in touched} == set()
    same = held(t)
    t.put(rows(spark, ("k5", 77, 400, 50, 2)))
    assert held(t) == same
    assert t.put(rows(spark)) == [] and t.delete(rows(spark, ("none", 1, 1, 1, 1)).select("key")) == []


def test_delete_expire_retain(spark):
    t = KeyedTable(spark, shared_path(spark, "store"), SCHEMA, buckets=4)
    t.put(rows(spark, *[(f"k{i}", i, 100 + i // 2, i, 10) for i in range(20)]))
    t.delete(spark.createDataFrame([("k0",), ("k1",), (None,)], "key string"))
    assert len(held(t)) == 18
    now = F.timestamp_seconds(F.lit(110))
    assert {r["key"]: r["hit"] for r in t.get(spark.createDataFrame([("k2",), ("k9",), ("zz",)], "key string"), now).collect()} == {"k2": False, "k9": True, "zz": False}
    stats = t.stats(now).first()
    t.purge(now)
    assert len(held(t)) == stats["live"] and set(held(t)) == {f"k{i}" for i in range(8, 20)}
    assert t.retain(50) == []
    t.retain(3)
    assert set(held(t)) == {"k19", "k18", "k17"}
    t.retain(0)
    assert held(t) == {}
    t.put(rows(spark, ("new", 1, 1, 1, 1)))
    assert held(t) == {"new": 1}
