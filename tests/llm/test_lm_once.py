"""op1 takes its texts apart once: later steps read what was packed then."""

import numpy as np
from test_llm import MODEL, corpus

from verisift.llm import lm_scoring


def test_texts_are_taken_apart_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [*((r[0], r[1]) for r in corpus(4, 40)), (None, "no id"), (None, None), (7, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    made = lm_scoring.score_documents(spark.read.parquet(path), MODEL, part_bytes=2000, least_parts=3)
    assert made.inputFiles() and not [f for f in made.inputFiles() if path in f]
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in made.collect())
    assert got == sorted((str(d), 1 + len((t or "").encode().split())) for d, t in rows)


def test_laid_texts_are_the_same():
    codec = lm_scoring._codec(open(MODEL, "rb").read())
    symbol = np.arange(codec.bare.vocab_size() + 1, dtype=np.int32) % lm_scoring.HEAD
    texts = ["a b c " * 90, "", None, "x Grüße", " \n"]
    t = lm_scoring.Texts(texts, codec, symbol)
    ids = t.ids[t.ids >= 0]
    other = lm_scoring.Texts.laid(t.counts, ids.astype(np.uint16), t.each, symbol)
    for name in ("x", "y", "ids", "edge", "begin"):
        np.testing.assert_array_equal(getattr(t, name), getattr(other, name))
    assert t.counts.tolist() == [270, 0, 0, 2, 0] and len(t.y) == len(ids) + 5 and (t.y[t.edge[1:] - 1] == 0).all()
    want = [i for w in "a b c".split() * 90 + ["x", "grüße"] for i in codec.bare.encode("▁" + w)]
    assert ids.tolist() == want
