"""Registered queries against their SQL on the smallest tables, and the streaming forms."""

import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from verisift.operators import tables
from verisift.plans import catalog, contracts, derived, extraction, fetching, questions, serving  # noqa: F401
from verisift.streaming import usage

DATA = "/root/testdata/sf0.001"


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", list(catalog.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(catalog.SQL[name])
    got = catalog.Q[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda made, names: sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in made)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_streams(spark):
    folder = tempfile.mkdtemp()
    batch = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema(batch.schema).parquet(folder)
    daily = usage.usage_daily_stream(stream).writeStream.format("memory").queryName("daily").outputMode("complete")
    assert daily.trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("daily").agg(F.sum("calls")).first()[0] == batch.count()
    bucket = usage.token_bucket_stream(stream, 0.001, 2.999).writeStream.format("memory").queryName("bucket").outputMode("append")
    assert bucket.trigger(availableNow=True).start().awaitTermination(60)
    want = {r["event_id"]: r["allowed"] for r in tables.token_bucket(batch, 0.001, 2.999).collect()}
    assert {r["event_id"]: r["allowed"] for r in spark.table("bucket").collect()} == want
