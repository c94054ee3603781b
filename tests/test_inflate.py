"""Bounded decoding: all members, chains, caps and bombs under fixed memory, broken streams."""

import os
import time
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from verisift.functions import inflate, wire

gz, de = inflate.encoder("gzip"), inflate.encoder("deflate")


def test_members_and_chains():
    text = os.urandom(100_000) + b"ab" * 50_000
    assert inflate.decode(gz(text), ["gzip"]) == (text, 200_000)
    assert inflate.decode(gz(b"ab") + gz(b"cd") + gz(b""), ["x-gzip"]) == (b"abcd", 4)
    assert inflate.decode(gz(b"ab") + b"rubbish", ["gzip"])[0] == b"ab" and inflate.decode(de(b"ab") + gz(b"x"), ["deflate"])[0] == b"ab"
    assert inflate.decode(gz(gz(b"twice")), ["gzip", "gzip"])[0] == b"twice" and inflate.decode(de(gz(b"x")), ["gzip", "deflate"])[0] == b"x"
    members = b"".join(gz(bytes([i % 256]) * 10) for i in range(20_000))
    began = time.time()
    assert inflate.decode(members, ["gzip"])[1] == 200_000 and time.time() - began < 10
    for broken in (gz(text)[:-4], b"", b"no gzip", gz(b"ab") + gz(b"cd")[:9]):
        with pytest.raises(zlib.error):
            inflate.decode(broken, ["gzip"])
    assert inflate.decode(b"", []) == (b"", 0) and inflate.decode(b"plain", []) == (b"plain", 5)


def test_bombs_under_fixed_memory():
    zeros = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = b"".join(zeros.compress(bytes(1 << 20)) for _ in range(300)) + zeros.flush()
    twice = gz(bomb)
    tracemalloc.start()
    for body, tokens, says in ((bomb, ["gzip"], inflate.TOO_DENSE), (twice, ["gzip", "gzip"], inflate.TOO_DENSE)):
        with pytest.raises(inflate.TooLarge, match=says):
            inflate.decode(body, tokens)
    with pytest.raises(inflate.TooLarge, match=inflate.TOO_MANY):
        inflate.decode(bomb, ["gzip"], ratio=10_000)
    assert inflate.decode(bomb, ["gzip"], most=1 << 30, ratio=10_000, keep=False) == (None, 300 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    assert inflate.decode(gz(bytes(65_536)), ["gzip"])[1] == 65_536
    with pytest.raises(inflate.TooLarge):
        inflate.decode(gz(bytes(65_537)), ["gzip"])


def test_decoded_column(spark):
    rows = [(1, gz(b"abc"), "gzip"), (2, b"raw", None), (3, b"raw", "br, gzip"), (4, gz(b"abc")[:-3], "gzip"), (5, gz(b"x" * 200), "GZIP"), (6, None, "gzip"), (7, b"", "identity")]
    made = spark.createDataFrame(rows, "i int, b binary, e string").select("i", inflate.decoded(F.col("b"), wire.content_encodings(F.col("e")), most=100).alias("d")).select("i", "d.*").orderBy("i").collect()
    assert [(r["body"] and bytes(r["body"]), r["bytes"], r["code"]) for r in made] == [(b"abc", 3, None), (b"raw", 3, None), (b"raw", 3, "UNSUPPORTED_CONTENT_ENCODING"), (None, None, "UPSTREAM_HTTP_FAILURE"), (None, None, "RESPONSE_TOO_LARGE"), (None, 0, None), (b"", 0, None)]
    assert made[2]["message"] == "Content encoding br is not supported; the body was left undecoded."


def test_redaction_and_failures(spark):
    texts = ['{"a":1e3,"b":1.50,"c":-0.0,"d":1e-7,"e":1e21,"f":0.00001,"g":12345678901234567890,"h":[true,null,"é"],"token":1}', '{"a":NaN}', "[1.0]", '"x"', "broken", '{"a":1e999}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", wire.redact("t").alias("r")).orderBy("i").collect()
    assert [r["r"] for r in rows] == ['{"a":1000,"b":1.5,"c":0,"d":1e-7,"e":1e+21,"f":0.00001,"g":12345678901234567000,"h":[true,null,"é"],"token":"[redacted]"}', None, "[1]", '"x"', None, '{"a":null}']
    bodies = ['[[{"error":{"code":1}}]]', "[[[]]]", '[{"result":{}},[{"result":{"isError":true}}]]', '[[{"result":{}}]]', "null"]
    got = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", wire.response_failed(F.col("b"), F.lit(None).cast("string")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in got] == [True, False, True, False, False]
