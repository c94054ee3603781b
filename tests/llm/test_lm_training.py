"""The network of op1 sees every training window."""

import numpy as np
from test_llm import MODEL, SCHEMA, corpus

from verisift.llm import lm_scoring
from verisift.llm.langid import fold


def test_network_trains_on_all_windows(spark):
    docs = spark.createDataFrame(corpus(3, 40), SCHEMA).coalesce(1)
    blob = open(MODEL, "rb").read()
    codec = lm_scoring._codec(blob)
    symbol, weights = lm_scoring._start(docs.filter((fold(docs["doc_id"], 10) != 0) & docs["text"].isNotNull()), blob)
    rows = docs.select("doc_id", "text", (fold(docs["doc_id"], 10) == 0).alias("held_out")).collect()
    t = lm_scoring.Texts([r["text"] for r in rows], codec, symbol)
    train = np.array([not r["held_out"] for r in rows])
    net, prior = lm_scoring.Network.from_flat(weights), lm_scoring.Prior(t.neighbours(train))
    net.train(prior, t, *t.windows(np.flatnonzero(train)), 0.001)
    want = np.add.reduceat(net.score(prior, t) + np.where(t.y == lm_scoring.TAIL, np.nan, 0), t.edge[:-1]) / np.log(10)
    got = {r["doc_id"]: r["net_score"] for r in lm_scoring.score_documents(docs, MODEL, part_bytes=1 << 30, least_parts=1).collect()}
    seen = [(got[r["doc_id"]], w) for r, w in zip(rows, want.tolist(), strict=True) if np.isfinite(w)]  # texts without tail ids
    assert len(seen) > 30
    np.testing.assert_allclose(*zip(*seen, strict=True), rtol=1e-4)
