"""op7 and the stage `tokens` project their pieces to byte spans of the source."""

import hashlib

from test_llm import MODEL, SCHEMA

import corpus_pipeline
from verisift.llm import queries

TEXTS = {1: "héllo  world\n日本 🙂", 2: "", 3: None, 4: " x "}


def spans_of(text):
    """Begins and ends of the library's own pieces, each laid on the source bytes: a mark is a space, the first one none."""
    import sentencepiece

    sp, src, at, out = sentencepiece.SentencePieceProcessor(model_file=MODEL), (text or "").encode(), 0, [(0, 0)]
    for k, i in enumerate(sp.encode(text or "")):
        n = 1 if sp.is_byte(i) else len(sp.id_to_piece(i).replace("▁", " ").encode()) - (k == 0)
        out.append((at, at + n))
        at += n
    assert at == len(src)
    flat = [x for side in zip(*out, (len(src), len(src)), strict=True) for x in side]
    return hashlib.sha256(b"".join(x.to_bytes(8, "little") for x in flat)).hexdigest()


def test_spans_reach_the_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, None, None, None, 0, "") for i, t in TEXTS.items()], SCHEMA).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for made in (queries.op7_sentencepiece(spark, str(tmp_path)), corpus_pipeline.tokens(spark, docs, str(tmp_path))):
        assert {r["doc_id"]: r["spans_sha256"] for r in made.collect()} == {i: spans_of(t) for i, t in TEXTS.items()}
