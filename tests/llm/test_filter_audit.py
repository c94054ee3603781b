"""The filter audit against definition: chains applied one by one, odd rows, copies over many partitions."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verisift.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, lang string, mask int, sha string", "doc_id long, quality int, toxic int, text string"


def fails_of(rows):
    """Failing letters of each row, by definition."""
    out = []
    for doc, text, *_ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        out.append(f + "E" * any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, *_ in rows))
    return out


def brute(rows, labels):
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, _ in labels if t == 1 and d is not None}
    fails, out, shapley = fails_of(rows), {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        left = {p: [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == p] for p in {r[2] or "" for r in rows}}
        for p in left:
            whole = left[p]
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left[p] if x in f]
                redundant = sum(x in f for _, f in whole) - len(gone)
                left[p] = [(d, f) for d, f in left[p] if x not in f]
                shapley[p, x] += len(gone)
                out[p, order, step] = (len(left[p]), len(gone), redundant, sum(f == x for _, f in whole), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(("ab", "Cd", "ef", "GH", "ij")) + (str(rng.randrange(300)) if rng.random() < p else "") for _ in range(n)) + rng.choice(("", "", " #")) for n in (0, 1, 5, 199, 200, 201, 300) for p in (0, 0.3, 0.9)]
    rows = [(i, rng.choice(texts), rng.choice(("en", "de", "", None)), 1, "x") for i in range(150)]
    rows += [(7, rows[7][1], "en", 1, "x"), (None, texts[0], "en", 1, "x"), (None, texts[0], "en", 1, "x"), (None, "null id only", "de", 1, "x"), (900, None, None, 1, "x"), (901, "", "fr", 1, "x"), (902, "w " * 60_000, "fr", 1, "x"), (-3, texts[5], "fr", 1, "x")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None)), "t") for i in range(0, 150, 2)] + [(2, 1, 1, "t"), (None, 1, 1, "t"), (5000, 1, 1, "t")]
    return rows, labels


@pytest.mark.parametrize("parts", ["3", "40"])
def test_equals_definition(spark, parts):
    rows, labels = corpus()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        made = filter_audit.audit(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in made} == brute(rows, labels) and len(made) == len({tuple(r)[:3] for r in made})


def test_one_text_over_many_partitions(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        masks = filter_audit.failure_masks(docs)
        assert masks.filter("mask & 16 > 0").count() == docs.filter("doc_id % 3 > 0").count() - 1
        assert masks.filter("mask & 16 = 0 AND doc_id % 3 > 0").first()["doc_id"] == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_of_one_fingerprint():
    """Different texts that share a fingerprint are told apart, within batches and across them."""
    import pyarrow as pa

    rows = [(5, "a", 1), (5, "a", 2), (5, "b", 0), (5, "b", 0), (5, "b", 4), (9, "c", None), (9, "c", 3), (9, "d", 1)]
    for size in (1, 2, 3, 8):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([d for _, _, d in c], pa.int64()), "part": ["p"] * len(c), "text": [t for _, t, _ in c], "fp": pa.array([f for f, _, _ in c], pa.int64()), "mask": pa.array([0] * len(c), pa.int32())}) for c in cut]
        made = [r for b in filter_audit._compare(iter(batches)) for r in b.to_pylist()]
        assert [r["copy"] for r in made if r["kind"] == 0] == [False, True, False, False, True, False, False, False]
        assert [r["sha"] is not None for r in made if r["kind"] == 0] == [True] * 5 + [False] * 3
        assert sorted(r["doc_id"] for r in made if r["kind"] == 1) == [0, 1, 1, 3]


def test_other_filters_and_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "x y", "en"), (2, "x y", "en"), (3, "z", "de")], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = {tuple(r)[:3]: r["removed"] for r in filter_audit.audit(docs, labels, {"Q": None, "R": F.size("words") > 1}, "source").collect()}
    assert made == {("en", "QR", 1): 1, ("en", "QR", 2): 1, ("en", "RQ", 1): 2, ("en", "RQ", 2): 0, ("de", "QR", 1): 0, ("de", "QR", 2): 0, ("de", "RQ", 1): 0, ("de", "RQ", 2): 0}
    assert filter_audit.audit(docs.limit(0), labels, part="source").collect() == []
