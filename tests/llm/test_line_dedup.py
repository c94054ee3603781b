"""Line deduplication against brute force: hot lines over many partitions, odd rows, repeated and null ids."""

import hashlib
import random

import numpy as np
import pytest

from verisift.llm import line_dedup

SCHEMA = "doc_id long, text string, keep string, doc int"


def brute(rows, least_chars, least_docs, pick=max):
    """Kept text of each (doc_id, text), by definition. A null id counts as the smallest."""
    order = lambda d: -(1 << 63) if d is None else d
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held.setdefault(k, []).append(order(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(k := key(x)) >= least_chars and len(held[k]) >= least_docs and order(doc) != pick(held[k]))]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    common = ["The very Common line of all documents", "  another line with Blanks at its ends\t", "Ünïcode line of twenty and more", "short one", "exactly twenty chars", "nineteen characters", "é" * 19 + " ", "É" * 20]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"line {rng.randrange(60)} of document or of others" for _ in range(rng.randrange(9))]
        if i % 2:
            lines += [common[0], common[0].upper() + "\r"]
        rows.append((i * 3, "\n".join(lines)))
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (None, "exactly twenty chars\n" + common[0]), (None, None), (6, rows[2][1]), (6, common[0] + "\nother text of a repeated id"), (1003, "x" * 50_000 + "\n" + common[0])]
    return rows


@pytest.mark.parametrize("keeper", ["largest", "smallest"])
@pytest.mark.parametrize("least_docs", [2, 3, 5])
def test_equals_brute_force(spark, keeper, least_docs):
    rows = corpus(least_docs)
    docs = spark.createDataFrame([(*r, "extra", 7) for r in rows], SCHEMA).repartition(5)
    got = line_dedup.dedup_lines(docs, ["keep", "doc"], least_docs=least_docs, keeper=keeper)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept", "keep", "doc"]
    made = got.collect()
    assert sorted([tuple(r)[:4] for r in made], key=repr) == brute(rows, 20, least_docs, max if keeper == "largest" else min)
    assert all(tuple(r)[4:] == ("extra", 7) for r in made)


def test_hot_line_over_many_partitions(spark):
    rows = [(i, "one line that every document holds\n" + (f"own text number {i} of this row" if i % 3 else "")) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r["doc_id"]: (r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[2999] == (0, rows[2999][1])
    assert all(got[i] == (1, rows[i][1].split("\n")[1]) for i in range(2999))


def test_stream_in_small_batches():
    """Runs that cross batches, in every cutting of the rows, with the edges settled by hand."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted(((h, 0, -d, d) for h in range(6) for d in range(rng.choice((1, 2, 3, 7)))))
    want = {(h, d) for h, _, _, d in rows if sum(x[0] == h for x in rows) >= 3 and d != max(x[3] for x in rows if x[0] == h)}
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("places", pa.list_(pa.int32()))])
    for size in (1, 2, 3, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[(h, 0, d, h, [d]) for h, _, _, d in rows[i : i + size]], strict=True), schema, strict=True)], schema=schema) for i in range(0, len(rows), size)]
        made = [r for b in line_dedup._stream_runs(3)(iter(batches)) for r in b.to_pylist()]
        edges = {r["h1"]: (r["n"], r["doc"]) for r in made if r["kind"] == 2}
        assert set(edges) == {0, 5}
        got = {(r["text_hash"], r["doc"]) for r in made if r["kind"] == 0}
        got |= {(r["h1"], r["doc"]) for r in made if r["kind"] == 1 and edges[r["h1"]][0] >= 3 and r["doc"] != edges[r["h1"]][1]}
        assert got == want


def test_empty_table_and_bitmaps(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).collect() == []
    docs = spark.createDataFrame([(i, "a line of twenty characters\nb") for i in range(3)], "doc_id long, text string")
    keeps = {r["doc"]: r for r in line_dedup.keep_bitmaps(docs).collect()}
    assert set(keeps) == {0, 1} and keeps[0]["n_dropped"] == 1
    assert line_dedup.unpack_keep(keeps[0]["keep"], 2).tolist() == [False, True]
    assert np.all(line_dedup.unpack_keep(None, 3))
    assert hashlib.sha256(b"b").hexdigest() == line_dedup.dedup_lines(docs).filter("doc_id = 0").selectExpr("sha2(kept, 256) h").first()["h"]
