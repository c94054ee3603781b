"""The pipeline against its stages' own brute-force forms."""

from test_llm import SCHEMA, corpus, links_of

import corpus_pipeline
from verisift.llm import substring_dedup


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(9), SCHEMA).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one item that is not in any of these documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(texts[i] for i in texts) and 60 not in texts and 64 not in texts and len(texts) >= 60
    one = {d for d, (_, c) in links_of(list(texts.items()), 5, 80).items() if c == d}
    kept = corpus_pipeline.near_duplicates(spark, kept, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == one
    rows = [(d, texts[d]) for d in sorted(one)]
    gone = {d: x[1] for (d, _), x in zip(rows, substring_dedup.brute_force([t for _, t in rows]), strict=True)}
    kept = corpus_pipeline.repeated_passages(spark, kept, str(tmp_path))
    for r in kept.collect():
        assert (r["text"] == texts[r["doc_id"]]) == (gone[r["doc_id"]] == 0)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == one
