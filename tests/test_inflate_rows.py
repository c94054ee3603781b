"""Rows of encoded bodies: the same as the column, a few bytes of bodies at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from verisift.functions import inflate, wire

gz = inflate.encoder("gzip")


def test_slices():
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "b": [b"x" * 10, None, b"", b"y" * 25, b"z" * 4, b"w" * 6, b"v"]})
    got = [s.column("i").to_pylist() for s in inflate.slices(batch.slice(0), "b", 10)]
    assert got == [[0, 1, 2], [3], [4, 5], [6]] and [s.column("i").to_pylist() for s in inflate.slices(batch.slice(3), "b", 1 << 20)] == [[3, 4, 5, 6]]
    assert list(inflate.slices(batch.slice(7), "b")) == []


def test_rows_equal_the_column(spark, monkeypatch):
    rows = [(1, gz(b"abc"), "gzip"), (2, b"raw", None), (3, b"raw", "br, gzip"), (4, gz(b"abc")[:-3], "gzip"), (5, gz(b"x" * 200), "GZIP"), (6, None, "gzip"), (7, b"", "identity")]
    given = spark.createDataFrame(rows * 40, "i int, b binary, e string").select("i", "b", wire.content_encodings(F.col("e")).alias("t"))
    want = given.select("i", inflate.decoded(F.col("b"), F.col("t"), most=100).alias("d")).select("i", "d.body", "d.bytes", "d.code", "d.message")
    plain = lambda df: sorted(repr([x if not isinstance(x, bytearray) else bytes(x) for x in r]) for r in df.collect())
    assert plain(inflate.decode_rows(given, "b", "t", most=100)) == plain(want)
