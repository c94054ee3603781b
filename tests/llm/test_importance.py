"""Importance resampling against plain counting; odd rows, long words and texts, ties, ranks over many partitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.llm import importance

DOCS = "doc_id long, text string, starts string, n_words int"


def features(text, longest=2):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, buckets, longest=2, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: Counter(bucket(f) for t in texts for f in features(t, longest)[1])
    s, t = count(x for _, x in rows), count(target)
    s_all, t_all = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in s}
    out, able = [], []
    for doc, text in rows:
        words, fs = features(text, longest)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(fs), weight, score, None])
        if len(words) >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


def corpus(n=200):
    rng = random.Random(5)
    vocab = ["Alpha", "beta", "γάμμα", "Élan", "x1", "long" * 30, "it's", "a_b", "日本語", "n-gram", "Ünder"]
    rows = [(i, rng.choice((" ", ", ", "\n")).join(rng.choice(vocab) for _ in range(rng.choice((0, 1, 2, 19, 20, 40, 90))))) for i in range(n)]
    rows += [(3, rows[3][1]), (4, "another text " * 20), (None, "beta x1 " * 15), (None, None), (900, None), (901, ""), (902, "... !!"), (903, "word" * 100_000 + " tail " * 90_000), (-8, "alpha " * 25)]
    return rows, ["alpha beta gamma x1", "Élan n-gram", "", None, "it's alpha beta"]


@pytest.mark.parametrize(("buckets", "longest"), [(10_000, 2), (97, 3), (70_000, 1)])
def test_equals_plain_counting(spark, buckets, longest):
    rows, target = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(5)
    items = spark.createDataFrame([(i, t, 5) for i, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = importance.resample(docs, items, buckets=buckets, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, buckets, longest)


def test_bigrams_cross_pieces():
    text = ("some words of a text " * 40_000).encode()
    n, at, counts = importance.FeatureCounter(10_000, 2).count(text)
    want = Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text.decode())[1])
    assert n == 200_000 and dict(zip(at.tolist(), counts.tolist(), strict=True)) == dict(want)


def test_ranks_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("score"), F.col("id").alias("doc_id"))
        made = importance.rank_first(rows, [F.desc("score"), F.asc("doc_id")], 3000).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    made.sort(key=lambda r: (-r["score"], r["doc_id"]))
    assert [r["rank"] for r in made] == [*range(1, 3001), *[None] * 2000]


def test_blocks_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    block = importance.count_matrix(docs.coalesce(1)).first()
    starts, at, n = importance.matrix_rows(block["starts"], block["buckets"], block["counts"])
    assert block["doc_ids"] == [1, 2] and block["n_words"] == [3, 0] and starts.tolist() == [0, 4, 4]
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == Counter(zlib.crc32(f) % 10_000 for f in (b"a", b"b", b"a", b"a b", b"b a"))
    none = docs.limit(0)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert importance.resample(none, items).collect() == []
    got = importance.resample(docs, items.limit(0)).orderBy("doc_id").collect()
    assert [r["rank"] for r in got] == [None, None] and got[1]["weight"] == 0
    assert np.all(importance.gains_of(np.zeros(5), np.zeros(5)) == 0)
