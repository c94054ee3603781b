"""The head of op1 holds the most common ids of all training texts."""

import numpy as np
from test_llm import MODEL

from verisift.llm import lm_scoring


def test_head_counts_all_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "START_TEXTS", 20)
    codec = lm_scoring._codec(open(MODEL, "rb").read())
    own = [p[1:] for p in codec.pieces if p.startswith("▁") and p[1:].isascii() and p[1:].isalpha() and p.islower()]
    rows = [(i, " ".join([own[(37 * i + k) % 3000] for k in range(9)] * (1 + i % 3))) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    symbol, _ = lm_scoring._start(docs.filter("text IS NOT NULL"), open(MODEL, "rb").read())
    n = np.bincount(np.concatenate([lm_scoring._subwords(codec, [w.encode() for w in (t or "").lower().split()])[0] for _, t in rows if t]), minlength=len(symbol) - 1)
    want = np.argsort(-n, kind="stable")[: lm_scoring.HEAD - 1]
    assert (symbol[want] == np.arange(1, lm_scoring.HEAD)).all() and (symbol == lm_scoring.TAIL).sum() == len(symbol) - lm_scoring.HEAD + 1
