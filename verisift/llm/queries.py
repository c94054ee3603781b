"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm import decontam, filter_audit, importance, jaccard_join, langid, line_dedup, lm_scoring, piece_codec, quality, substring_dedup, topk_search, url_filter, warc
from verisift.llm.common import new_path


def tokenizer_path(name: str) -> str:
    """A public tokenizer file; the folder is taken from TOKENIZERS, else from the installed package, else /opt/tokenizers."""
    if folder := os.environ.get("TOKENIZERS"):
        return f"{folder}/{name}"
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(url_filter.label_by_rules(pages)), ["page_id"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.find_classes(_table(spark, sf_dir, "documents"), 4, 85)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = piece_codec.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return made.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), piece_codec.spans_digest().alias("spans_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.captures(_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return got.select("metadata.page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", F.col("response.refers_to_page").alias("refers_to"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return topk_search.search(rows.filter(F.col("vec_id") % 20 == 0), rows, 20)


OP10_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP11_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
               lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
x AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM x),
f AS (SELECT side, id, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM w),
n AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT feature, hex(encode(feature)) AS hx FROM n GROUP BY feature),
b AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hx) // 2), lambda i: CAST('0x' || hx[2 * i + 1:2 * i + 2] AS BIGINT))),
               lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 10000 AS bucket FROM d, crc),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM n JOIN b USING (feature) GROUP BY bucket),
a AS (SELECT CAST(sum(s) + 10000 AS DOUBLE) AS s_all, CAST(sum(t) + 10000 AS DOUBLE) AS t_all FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * s_all / ((CAST(s AS DOUBLE) + 1) * t_all))) AS BIGINT) AS gain FROM c, a),
m AS (SELECT id, sum(n) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
k AS (SELECT w.id AS doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, len(words) >= 20 AS able,
        CAST('0x' || substr(sha256('7:' || w.id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m ON w.id = m.id WHERE side = 0),
r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE able) OVER () AS all_able FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * all_able // 100 THEN place END AS rank FROM o
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, part,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM w),
b AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
      FROM m LEFT JOIN b USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
      WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, x,
        CAST(sum(CASE WHEN translate(fails, before || x, '') = fails THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN fails = x THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN n_good ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN contains(fails, x) AND translate(fails, before, '') = fails THEN n_toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, c.top IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def queries() -> dict:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_url_filter": op2_url_filter,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_quality": op6_quality,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_warc": op8_warc,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_top_k": op10_top_k,
        "op11_importance": op11_importance,
        "op12_filter_audit": op12_filter_audit,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": OP8_SQL, "op10_top_k": OP10_SQL, "op11_importance": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_line_dedup": OP13_SQL}
