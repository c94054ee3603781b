"""Registered queries of requests, gates, feeds and checks over whole tables.

As in `catalog`, some columns stand in: `events` for calls and sources of a request (user_id: request, event_id: position),
`pages` for fetched pages, `lineitem` and `orders` for logs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verisift.functions import urls, wire
from verisift.operators import requests, robots, tables
from verisift.plans.catalog import _ITEMS, _MOVES, _items, _moves, query, table
from verisift.sources import feeds


# --- URLs and addresses ---------------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN url IS NULL THEN 'INVALID_URL' END AS code, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages")
def page_url_validation(spark, d):
    checked = urls.validate_url(F.col("url"), F.array(F.lit("93.184.216.34")))
    return table(spark, d, "pages").select("page_id", checked["code"].alias("code"), urls.host_of(F.col("url")).alias("host"))


# --- requests -------------------------------------------------------------------------------------------------


_SOURCES = "(SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 2 = 0 THEN 200 ELSE 404 END AS status, event_id % 5 = 0 AS from_cache, CASE WHEN event_type = 'error' THEN 'TIMEOUT' WHEN event_id % 2 = 1 THEN 'UPSTREAM_HTTP_FAILURE' END AS code, CAST(event_id % 4 AS INTEGER) AS n FROM events)"


def _sources(spark, d):
    status = F.when(F.col("event_type") == "error", None).when(F.col("event_id") % 2 == 0, 200).otherwise(404)
    code = F.when(F.col("event_type") == "error", "TIMEOUT").when(F.col("event_id") % 2 == 1, "UPSTREAM_HTTP_FAILURE")
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), status.alias("status"), (F.col("event_id") % 5 == 0).alias("from_cache"), F.array_compact(F.array(code)).alias("codes"), F.lit(False).alias("refined"), (F.col("event_id") % 4).cast("int").alias("n_candidates"))


@query(f"""WITH s AS (SELECT * FROM {_SOURCES}), f AS (SELECT user_id, code, min(event_id) AS first FROM s WHERE code IS NOT NULL GROUP BY ALL),
r AS (SELECT user_id, array_to_string(list(code ORDER BY first), ', ') AS reasons FROM f GROUP BY user_id)
SELECT user_id, count(*) AS sources, count(status) AS fetch_ok, count_if(status IS NULL) AS fetch_failed, count_if(from_cache) AS cache_hits, count_if(NOT from_cache) AS cache_misses, CAST(sum(n) AS BIGINT) AS candidates, bool_or(from_cache) AS any_cached,
 CASE WHEN count_if(status = 200) = 0 THEN 'NO_SOURCES_RETRIEVED' END AS code, CASE WHEN count_if(status = 200) = 0 THEN 'None of the ' || count(*) || ' requested source(s) could be retrieved, so no evidence was produced and no payment will be taken.' || CASE WHEN any_value(reasons) <> '' THEN ' Reasons: ' || any_value(reasons) || '.' ELSE '' END END AS message
FROM s LEFT JOIN r USING (user_id) GROUP BY user_id""")
def request_totals(spark, d):
    g = requests.request_totals(_sources(spark, d), "user_id")
    return g.select("user_id", "sources", "fetch_ok", "fetch_failed", "cache_hits", "cache_misses", "candidates", "any_cached", "code", "message")


@query("""SELECT conv_id, '{"question":"' || conv_id || '","sources":[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']}' AS response FROM conversations GROUP BY conv_id""")
def response_documents(spark, d):
    turns = table(spark, d, "conversations")
    asked = turns.select("conv_id", F.col("conv_id").cast("string").alias("question")).distinct()
    return requests.responses(asked, turns.select("conv_id", F.col("turn").alias("pos"), F.struct("turn", "role").alias("source")), "conv_id")


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, CAST(length(coalesce(text, '')) % 13 AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, c >= 2 AND c * 800 <= 9000 AS scored, CAST(9000 - CASE WHEN c >= 2 AND c * 800 <= 9000 THEN c * 800 ELSE 0 END AS BIGINT) AS lft FROM s WHERE i = 1
 UNION ALL SELECT s.conv_id, s.turn, s.i, s.c >= 2 AND s.c * 800 <= r.lft, CAST(r.lft - CASE WHEN s.c >= 2 AND s.c * 800 <= r.lft THEN s.c * 800 ELSE 0 END AS BIGINT) FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
SELECT conv_id, turn, scored FROM r""")
def scoring_budget(spark, d):
    s = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("pos"), "turn", (F.length(F.coalesce("text", F.lit(""))) % 13).cast("int").alias("n_candidates"))
    return requests.with_budget(s, 9000, "conv_id").select("conv_id", "turn", "scored")


# --- wire -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts + to_seconds(CAST(event_id % 86400 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS expires FROM events")
def expiries(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(wire.expiry(F.col("ts").cast("timestamp"), (F.col("event_id") % 86400).cast("int")), "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("SELECT event_type AS surface, count(*) AS calls FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY GROUP BY 1")
def usage_since(spark, d):
    start = wire.since(F.lit("2024-01-20 00:00:00").cast("timestamp"), "7d")
    return table(spark, d, "events").filter(F.col("ts").cast("timestamp") >= start).groupBy(F.col("event_type").alias("surface")).agg(F.count("*").alias("calls"))


# --- robots ---------------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS origin, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN origin LIKE '%e%' AND path LIKE '/en/%' AND path NOT LIKE '/en/1%' THEN 'BLOCKED_URL' END AS code FROM u""")
def robots_gate(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), urls.host_of(F.col("url")).alias("origin"), F.regexp_extract("url", "://[^/?#]+([^?#]*)", 1).alias("path"))
    bodies = pages.select("origin").distinct().withColumn("body", F.when(F.col("origin").contains("e"), "User-agent: *\nDisallow: /en/\nAllow: /en/1"))
    seen = robots.verdicts(pages, feeds.parse_robots(bodies, "VerisiftBot"))
    return seen.select(F.col("id").alias("page_id"), requests.source_gate(F.lit("text/html"), F.lit(1), F.lit(1), F.col("allowed"), F.col("rule"), policy="enforce")["code"].alias("code"))


# --- feeds ----------------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN event_type = 'view' THEN 'preview_evidence' WHEN event_type = 'click' THEN 'preview (rest)' WHEN event_type = 'error' THEN 'http paid route' ELSE event_type END AS surface, count(*) AS calls, count_if(event_type IN ('view', 'click')) AS previews, count_if(event_id % 3 = 0) AS paid, count_if(event_type = 'error') AS failed FROM events WHERE event_id % 11 <> 0 GROUP BY 1")
def usage_log_report(spark, d):
    """Log lines, every eleventh broken, to the report by surface."""
    e = F.col("event_type")
    tool = F.when(e == "view", "preview_evidence").when(e.isin("click", "error"), F.lit(None)).otherwise(e)
    line = F.to_json(F.struct(tool.alias("tool"), (e == "click").alias("preview"), (F.col("event_id") % 3 == 0).alias("payment_provided"), F.when(e == "error", "TIMEOUT").otherwise("ok").alias("outcome")))
    lines = table(spark, d, "events").select(F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(line).alias("line"))
    return tables.usage_report(feeds.parse_lines(lines, feeds.USAGE))


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 503 WHEN event_id % 7 = 1 THEN 0 WHEN event_id % 7 = 2 THEN 404 ELSE 200 END AS status, count(*) AS n, CASE CASE WHEN event_id % 7 = 0 THEN 503 WHEN event_id % 7 = 1 THEN 0 WHEN event_id % 7 = 2 THEN 404 ELSE 200 END WHEN 503 THEN '5xx' WHEN 0 THEN 'connection' WHEN 200 THEN 'ok' ELSE 'other' END AS kind FROM events GROUP BY 1, 3")
def status_histogram(spark, d):
    k = F.col("event_id") % 7
    return tables.status_histogram(table(spark, d, "events").withColumn("status", F.when(k == 0, 503).when(k == 1, 0).when(k == 2, 404).otherwise(200)))


@query("WITH w AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events WHERE event_type <> 'error') SELECT event_id, day, nth FROM w WHERE nth <= 200")
def valid_call_quota(spark, d):
    return tables.valid_quota(table(spark, d, "events"), F.col("event_type") != "error", 200).select("event_id", F.to_date("day").cast("string").alias("day"), F.col("nth").cast("bigint").alias("nth"))


@query(f"SELECT count(*) AS resources, count(calls) AS with_usage, CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls, CAST(coalesce(sum(payers), 0) AS BIGINT) AS payers, count_if(calls = 0) AS no_calls, count_if(coalesce(payers, 0) = 0) AS no_payers, printf('%.1f%%', 100.0 * count_if(coalesce(payers, 0) = 0) / count(*)) AS no_payers_share FROM {_ITEMS}")
def catalogue_totals(spark, d):
    return tables.catalogue_totals(_items(spark, d)).select("resources", "with_usage", "calls", "payers", "no_calls", "no_payers", "no_payers_share")


@query(f"SELECT item, calls, payers FROM {_ITEMS} ORDER BY payers DESC, item LIMIT 10")
def demand_widest(spark, d):
    return tables.widest(_items(spark, d)).select("item", "calls", "payers")


@query(f"SELECT item, payers FROM {_ITEMS} WHERE payers > 0 ORDER BY payers DESC, item LIMIT 40")
def demand_payouts(spark, d):
    return tables.top_payouts(_items(spark, d)).select("item", "payers")


@query(f"WITH p AS (SELECT sender, count(*) AS n FROM {_MOVES} GROUP BY 1), t AS (SELECT sender, n, round(sum(n) OVER (ORDER BY n DESC, sender) / (SELECT sum(n) FROM p), 6) AS share_so_far FROM p) SELECT * FROM t ORDER BY n DESC, sender LIMIT 10")
def payer_top_senders(spark, d):
    return tables.top_senders(_moves(spark, d), 10)


@query(f"SELECT count(*) AS seen, count_if(category = 'search') AS found, true AS complete FROM {_ITEMS}")
def catalogue_containment(spark, d):
    items = _items(spark, d)
    return feeds.containment(items.select("item", "category"), '"category":"search"', 1)


@query("SELECT '0x' || lpad(CAST(o_custkey AS VARCHAR), 40, '0') AS sender, '0x' || lpad(CAST(l_suppkey AS VARCHAR), 40, '0') AS recipient, CAST(l_orderkey AS VARCHAR) AS tx FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey BETWEEN 100 AND 30000 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def transfer_scan(spark, d):
    """Log rows of a block range (order key: block) whose recipient is a wanted one."""
    pad = lambda c: F.concat(F.lit("0x" + "0" * 24), F.lpad(F.col(c).cast("string"), 40, "0"))
    logs = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("block"), F.col("l_orderkey").cast("string").alias("tx"), F.array(F.lit("transfer"), pad("o_custkey"), pad("l_suppkey")).alias("topics"))
    wanted = table(spark, d, "supplier").filter("s_nationkey < 12").select(F.concat(F.lit("0x"), F.lpad(F.col("s_suppkey").cast("string"), 40, "0")).alias("address"))
    return feeds.transfers(logs, wanted, 100, 30_000)


@query("SELECT k.key, k.hit, k.seq FROM (WITH w AS (SELECT user_id AS key, ts AS stored_at, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT c.c_custkey AS key, w.seq IS NOT NULL AS hit, w.seq FROM customer c LEFT JOIN (SELECT * FROM w WHERE r = 1 AND stored_at + INTERVAL 1 DAY > TIMESTAMP '2024-01-15 00:00:00' AND key % 5 <> 0) w ON w.key = c.c_custkey) k")
def cache_point_reads(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("stored_at"), F.col("event_id").alias("seq"))
    held = tables.cache_upsert(e).withColumn("expires_at", F.expr("stored_at + INTERVAL 1 DAY"))
    held = tables.cache_delete(held, table(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("key")))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return tables.cache_point_read(wanted, held, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("key", "hit", "seq")


# --- errors and listing checks --------------------------------------------------------------------------------


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda x: CASE WHEN regexp_matches(x, '^https?://') THEN x WHEN starts_with(x, '/') THEN 'https://own.example' || x END), lambda x: x IS NOT NULL))), ' ') AS links FROM pages""")
def page_link_list(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(tables.page_links(F.col("html"), "https://own.example/"), " ").alias("links"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: contains(x, 'the'))) AS INTEGER) AS n FROM documents")
def lines_with_needle(spark, d):
    return table(spark, d, "documents").select("doc_id", tables.matching_lines(F.col("text"), "the").alias("n"))
