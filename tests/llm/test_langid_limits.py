"""Texts of unlearned languages in the same script are rejected, short texts of learned ones are kept."""

import os

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.01"
FOREIGN = [
    "Il gatto dorme sul divano mentre la pioggia cade lenta sulla città.",
    "Bugün hava çok güzel, birlikte parka gidelim mi acaba?",
    "Tänään on kaunis päivä ja menemme yhdessä puistoon kävelemään.",
    "Dzisiaj jest piękny dzień i idziemy razem do parku na spacer.",
]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_unlearned_latin_script(spark):
    from verisift.llm import langid

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    foreign = spark.createDataFrame([(i, t) for i, t in enumerate([*FOREIGN, *[" ".join([t] * 20) for t in FOREIGN]])], "doc_id long, text string")
    assert langid.predict(foreign, model, ["doc_id"]).filter("NOT rejected").count() == 0
    unseen = docs.filter("doc_id % 2 = 1 AND length(text) > 0 AND lang IS NOT NULL")
    for words in (2, 4, 10, 10**6):
        short = unseen.selectExpr("doc_id", f"array_join(slice(split(text, ' '), 1, {words}), ' ') AS text").filter("text rlike '[a-z]{2}'")
        got = [r["rejected"] for r in langid.predict(short, model, ["doc_id"]).collect()]
        assert len(got) > 300 and sum(got) <= 0.02 * len(got)
