"""Registered queries of scoring, keyed tables, quotas and caches that are kept up to date.

`conversations` stands in for requests (conversation) and their sources (turns; lines are passages), `events` for writes
and calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.functions import classify
from verisift.functions.common import shared_path, spread
from verisift.operators import evidence, requests, scoring, store, tables
from verisift.plans.catalog import _MOVES, _WRITES, QUESTION, _moves, _writes, evidence_sql, query, table
from verisift.sources import feeds
from verisift.streaming import stateful

# --- scoring --------------------------------------------------------------------------------------------------


def _model():
    class Model:
        """Scores by the length of a passage; each takes 250 ms of the model's own clock."""

        now = 0.0

        def clock(self):
            return self.now

        def score(self, pairs):
            self.now += 0.25 * len(pairs)
            return [(len(p) % 8) / 8 for _, p in pairs]

    return Model()


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS l, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, i, turn, l, 12000.0::DOUBLE AS before, len(l) >= 2 AND len(l) * 800 <= 12000 AS called FROM s WHERE i = 1
 UNION ALL SELECT s.conv_id, s.i, s.turn, s.l, b.rest, len(s.l) >= 2 AND len(s.l) * 800 <= b.rest FROM (SELECT conv_id, i, before - CASE WHEN called THEN 250.0::DOUBLE * least(len(l), 32) ELSE 0 END AS rest FROM r) b JOIN s ON s.conv_id = b.conv_id AND s.i = b.i + 1)
SELECT conv_id, turn, called, before - CASE WHEN called THEN 250.0::DOUBLE * least(len(l), 32) ELSE 0 END AS left_ms,
 CASE WHEN called AND len(l) <= 32 THEN list_sum(list_transform(l, lambda x: (length(x[:2000]) % 8) / 8.0::DOUBLE)) END AS total_score FROM r""")
def scored_sources(spark, d):
    """Sources of a request scored in packs, under a budget that gets back what a call did not take."""
    s = table(spark, d, "conversations").select("conv_id", "turn", F.lit("q").alias("question"), F.split(F.coalesce("text", F.lit("")), "\n").alias("passages"))
    made = scoring.score_sources(s, _model, 12_000, "conv_id", pos="turn")
    return made.select("conv_id", "turn", "called", "left_ms", F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("total_score"))


@query(evidence_sql(QUESTION) + """, c AS (SELECT doc_id, max(rank) AS n FROM best GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(n - rank + 1 AS INTEGER) ELSE rank END AS place, segment, doc_id % 3 = 0 AS reordered FROM best JOIN c USING (doc_id)""")
def ranker_orders(spark, d):
    """Orders of a ranker: the reverse for every third document, one with a repeat or with a stranger for the others."""
    r = evidence.rank(spread(table(spark, d, "documents")), QUESTION)
    n = F.size("candidates")
    back = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: n - i)).otherwise(F.array().cast("array<int>"))
    order = F.when(F.col("doc_id") % 3 == 0, back).when(F.col("doc_id") % 3 == 1, F.concat(back, F.array(F.lit(0)))).otherwise(F.transform(back, lambda i: i + 1))
    made = scoring.apply_order(r.withColumn("places", order), "places").select("doc_id", "reordered", F.posexplode_outer("candidates").alias("p", "c"))
    return made.filter("c IS NOT NULL").select("doc_id", (F.col("p") + 1).alias("place"), "c.segment", "reordered")


# --- keyed table ----------------------------------------------------------------------------------------------


@query(f"""WITH l AS (SELECT * FROM {_WRITES} QUALIFY row_number() OVER (PARTITION BY key ORDER BY stored_at DESC, seq DESC) = 1),
k AS (SELECT * FROM l WHERE key % 5 <> 0 AND expires_at > TIMESTAMP '2024-01-12 00:00:00')
SELECT key, seq, bytes FROM k ORDER BY stored_at DESC, key DESC LIMIT 300""")
def store_merged(spark, d):
    """A keyed table after two merges, deletions, expiry and retention of the 300 newest rows."""
    writes = _writes(spark, d)
    t = store.KeyedTable(spark, shared_path(spark, "store"), "key long, seq long, stored_at timestamp_ntz, expires_at timestamp_ntz, bytes long" if dict(writes.dtypes)["stored_at"] == "timestamp_ntz" else "key long, seq long, stored_at timestamp, expires_at timestamp, bytes long", buckets=16)
    t.put(writes.filter("seq % 2 = 1"))
    t.put(writes.filter("seq % 2 = 0"))
    t.delete(writes.filter("key % 5 = 0").select("key"))
    t.purge(F.lit("2024-01-12 00:00:00").cast("timestamp"))
    t.retain(300)
    return t.rows().select("key", "seq", "bytes")


# --- streams --------------------------------------------------------------------------------------------------


def _streamed(spark, d, run, schema: str) -> DataFrame:
    """What a stream makes of all events, by a sink of files in the shared folder."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    out, seen = shared_path(spark, "stream"), shared_path(spark, "progress")
    q = run(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def quota_stream(spark, d):
    made = _streamed(spark, d, lambda e: stateful.client_quota_stream(e, 3), "tie long, key string, allowed boolean, late boolean")
    return made.select(F.col("tie").alias("event_id"), "allowed")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT e.*, true AS allowed, CAST(2 AS DOUBLE) AS lft FROM e WHERE i = 1
 UNION ALL SELECT event_id, user_id, t, i, have >= 1 AS allowed, CASE WHEN have >= 1 THEN have - 1 ELSE have END AS lft FROM (
  SELECT e.*, least(3.0, r.lft + (e.t - r.t) * (CAST(0.001 AS DOUBLE) / 60)) AS have FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT event_id, allowed FROM r""")
def bucket_stream(spark, d):
    made = _streamed(spark, d, lambda e: stateful.bounded_bucket_stream(e, 0.001, 2.999, most=1 << 40), "tie long, key string, allowed boolean, retry_seconds long")
    return made.select(F.col("tie").alias("event_id"), "allowed")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, t AS fetched, false AS hit FROM e WHERE i = 1
 UNION ALL SELECT e.event_id, e.user_id, e.i, CASE WHEN e.t - r.fetched < 86400 THEN r.fetched ELSE e.t END, e.t - r.fetched < 86400 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, hit FROM r""")
def rule_cache_hits(spark, d):
    """Look-ups of a cache with a time to live of a day (users stand in for origins)."""
    made = _streamed(spark, d, lambda e: stateful.rule_cache_stream(e, "user_id", "ts", "event_id", 1 << 40, 86400), "tie long, key string, hit boolean, evicted string")
    return made.select(F.col("tie").alias("event_id"), "hit")


# --- answers --------------------------------------------------------------------------------------------------


@query(evidence_sql(QUESTION, k=5) + """, j AS (SELECT doc_id, count(*) AS n, string_agg(relevance || ' ' || context || ' ' || sha256(excerpt), '|' ORDER BY rank) FILTER (rank <= 3) AS excerpts FROM best GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS total, coalesce(excerpts, '') AS excerpts, 'https://e.com/' || d.doc_id AS final_url, CASE WHEN d.doc_id % 3 = 0 THEN 'xx' ELSE lang END AS language,
 concat_ws(',', CASE WHEN d.doc_id % 2 = 0 THEN 'ROBOTS_DISALLOWED' END, CASE WHEN d.doc_id % 5 = 0 THEN 'UPSTREAM_HTTP_FAILURE: The source returned HTTP 404.' END, CASE WHEN d.doc_id % 7 = 0 THEN 'SERVED_FROM_CACHE: Served from cache; originally retrieved at then.' END) AS warnings,
 CASE WHEN d.doc_id % 7 = 0 THEN 'then' ELSE 'now' END AS retrieved_at, sha256(text) AS hash FROM documents d LEFT JOIN j USING (doc_id)""")
def answered_sources(spark, d):
    """Sources as they are answered, and their previews of three excerpts."""
    k = F.col("doc_id")
    url = F.concat(F.lit("https://e.com/"), k.cast("string"))
    doc = F.struct(F.lit(None).cast("string").alias("title"), url.alias("canonical_url"), F.lit(None).cast("string").alias("description"), F.lit("p").alias("publisher"), F.col("lang").alias("language"), F.col("n_chars").alias("word_count"), F.sha2("text", 256).alias("content_hash"))
    own = F.when(k % 2 == 0, F.array(F.struct(F.lit("ROBOTS_DISALLOWED").alias("code"), F.lit(None).cast("string").alias("message"))))
    row = F.struct(url.alias("requested_url"), url.alias("final_url"), F.when(k % 5 == 0, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), doc.alias("doc"), F.col("candidates"), own.alias("warnings"), (k % 7 == 0).alias("from_cache"), F.lit("then").alias("retrieved_at"), F.lit(None).cast("array<string>").alias("redirect_chain"))
    ranked = evidence.rank(spread(table(spark, d, "documents")), QUESTION).select("doc_id", row.alias("row"), F.when(k % 3 == 0, "xx").when(k % 3 == 1, "auto").alias("asked"))
    made = ranked.select("doc_id", requests.answered_source(F.col("row"), F.col("asked"), F.lit("now")).alias("s"))
    made = made.select("doc_id", "s", requests.preview(F.lit(QUESTION), F.col("s"), F.lit(1)).alias("p"))
    listed = F.array_join(F.transform("p.excerpts", lambda e: F.concat_ws(" ", e["relevance"], e["context"], F.sha2(e["excerpt"], 256))), "|")
    warned = F.array_join(F.transform("s.warnings", lambda w: F.concat_ws(": ", w["code"], w["message"])), ",")
    return made.select("doc_id", F.col("p.excerpt_count_total").alias("total"), listed.alias("excerpts"), F.col("p.source.final_url").alias("final_url"), F.col("s.language").alias("language"), warned.alias("warnings"), F.col("s.retrieved_at").alias("retrieved_at"), F.col("s.content_hash_sha256").alias("hash"))


@query("""SELECT event_id, '{"level":"' || CASE event_id % 3 WHEN 0 THEN 'info' ELSE 'WARN' END || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(epoch_us(ts) // 1000 % 1000 AS BIGINT) AS VARCHAR), 3, '0') || 'Z","message":"' || event_type || '"' ||
 CASE WHEN event_id % 5 = 0 THEN ',"client":"curl"' ELSE '' END || ',"api_token":"[redacted]"}' AS line FROM events WHERE event_id % 3 <> 1""")
def log_records(spark, d):
    """Structured log lines from `info` on; clients that are no known token are left out, secrets hidden."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", F.when(k % 3 == 0, "info").when(k % 3 == 1, "debug").otherwise("WARN").alias("level"), classify.known_client(F.when(k % 5 == 0, "curl").otherwise('forged"}')).alias("client"), F.col("user_id").cast("string").alias("api_token"))
    return requests.log_lines(rows, "level", "event_type", "client", "api_token").select("event_id", "line")


@query(f"SELECT sender, count(*) AS n FROM {_MOVES} GROUP BY sender")
def sender_dump(spark, d):
    """Transfers of each sender, written as JSON lines in two goes and read back, a broken line among them."""
    path = shared_path(spark, "senders")
    counts = tables.sender_counts(_moves(spark, d))
    feeds.append_lines(counts.filter("sender % 2 = 0"), path)
    feeds.append_lines(counts.filter("sender % 2 = 1"), path)
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    return feeds.read_lines(spark, path, "sender long, n long")
