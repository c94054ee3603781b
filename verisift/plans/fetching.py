"""Registered queries of fetched things: redirects, blocked hosts, encoded bodies, paged sources, robots rules.

`pages` stands in for what a fetcher has left: locations, addresses, encodings and rules are derived from its rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from verisift.functions import inflate, urls, wire
from verisift.functions.common import shared_path
from verisift.operators import redirects
from verisift.plans.catalog import query, table
from verisift.sources import feeds, paged

# --- URLs -----------------------------------------------------------------------------------------------------

_PATH = "regexp_extract(url, '://[^/?#]+([^?#]*)', 1)"


@query(f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN NULL WHEN 5 THEN 'INVALID_URL' ELSE 'BLOCKED_URL' END AS code,
 CASE page_id % 6 WHEN 1 THEN 'internal hostname (localhost)' WHEN 2 THEN 'numeric host loopback (127.0.0.0/8)' WHEN 3 THEN 'port 22 is not allowed' WHEN 4 THEN 'URLs containing credentials are not allowed' WHEN 5 THEN 'not a valid absolute URL' END AS reason,
 CASE page_id % 6 WHEN 1 THEN 'http://localhost' || replace({_PATH}, '\\', '/') WHEN 2 THEN 'http://127.0.0.1' || {_PATH} WHEN 5 THEN '[unparseable-url]' WHEN 3 THEN 'https://' || regexp_extract(url, '://([^/?#:]+)', 1) || ':22' || {_PATH} ELSE regexp_replace(url, '[?#].*', '') END AS safe FROM pages""")
def url_hostile_hosts(spark, d):
    """Every page's URL, five in six turned into one that hides a blocked host, port or user, or that is none."""
    part = lambda p: F.regexp_extract("url", p, 1)
    path, host = part("://[^/?#]+([^?#]*)"), part("://([^/?#:]+)")
    k = F.col("page_id") % 6
    made = (
        F.when(k == 1, F.concat(F.lit("http:\\\\localhost"), F.translate(path, "/", "\\")))
        .when(k == 2, F.concat(F.lit("http://0x7F.1"), F.translate(path, "/", "\\")))
        .when(k == 3, F.concat(F.lit("https://"), host, F.lit(":22"), path))
        .when(k == 4, F.regexp_replace("url", "://", "://user:secret@"))
        .when(k == 5, F.concat(F.lit("https://müll."), host, path))
        .otherwise(F.col("url"))
    )
    rows = table(spark, d, "pages").select("page_id", made.alias("made"))
    return rows.select("page_id", urls.validate_url(F.col("made"), F.array(F.lit("8.8.8.8"))).alias("v"), urls.safe_url(F.col("made")).alias("safe")).select("page_id", "v.code", "v.reason", "safe")


# --- redirects ------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE p AS (SELECT page_id, regexp_replace(url, '#.*', '') AS spot, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages),
t AS (SELECT p.*, q.spot AS other FROM p LEFT JOIN p q ON q.page_id = (p.page_id * 7 + 3) % 97),
resp AS (SELECT spot, host, CASE WHEN page_id % 3 = 0 THEN 301 WHEN page_id % 9 = 2 THEN 302 WHEN page_id % 9 = 5 THEN 307 ELSE 200 END AS status,
  CASE WHEN page_id % 3 = 0 THEN other WHEN page_id % 9 = 2 THEN '/none/' || page_id % 97 WHEN page_id % 9 = 5 THEN 'local' END AS location FROM t),
one AS (SELECT * FROM resp QUALIFY row_number() OVER (PARTITION BY spot ORDER BY status, location NULLS FIRST) = 1),
edges AS (SELECT spot, status, location IS NOT NULL AS moved, CASE WHEN location = 'local' THEN 'http://localhost/x' WHEN location LIKE '/%' THEN regexp_extract(spot, '^[a-z]+://[^/?]+') || location ELSE location END AS next FROM one),
judged AS (SELECT *, coalesce(next = 'http://localhost/x' OR regexp_matches(next, '://blog\\.'), false) AS bad FROM edges),
walk AS (SELECT page_id, spot AS first, spot, 0 AS hop, CAST([] AS VARCHAR[]) AS chain FROM p WHERE NOT starts_with(host, 'blog.')
  UNION ALL SELECT w.page_id, w.first, e.next, w.hop + 1, list_append(w.chain, e.next) FROM walk w JOIN judged e ON e.spot = w.spot WHERE e.moved AND NOT e.bad AND w.hop < 5),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY hop DESC) = 1),
told AS (SELECT n.page_id, n.spot, n.first, n.chain, e.status, e.next, CASE WHEN e.spot IS NULL THEN 'UPSTREAM_HTTP_FAILURE' WHEN e.moved AND n.hop = 5 THEN 'REDIRECT_LIMIT' WHEN e.bad THEN 'BLOCKED_URL' END AS code FROM ends n LEFT JOIN judged e ON e.spot = n.spot)
SELECT p.page_id, CASE WHEN t.code IS NULL THEN t.spot END AS final_url, CASE WHEN t.code IS NULL THEN CAST(t.status AS INTEGER) END AS status, CAST(coalesce(len(t.chain), 0) AS INTEGER) AS hops, coalesce(array_to_string(t.chain, ' '), '') AS chain,
  coalesce(len(list_distinct(list_append(t.chain, t.first))) < len(t.chain) + 1 OR list_contains(list_append(t.chain, t.first), t.next), false) AS loops, CASE WHEN t.page_id IS NULL THEN 'BLOCKED_URL' ELSE t.code END AS code
FROM p LEFT JOIN told t USING (page_id)""")
def redirects_followed(spark, d):
    """Pages as answers, a third of which point to another page, some to paths without an answer or to a local host."""
    pages = table(spark, d, "pages").select("page_id", "url")
    host = urls.host_of(F.col("url"))
    other = pages.select(F.col("page_id").alias("to"), F.col("url").alias("other"))
    k = F.col("page_id")
    answers = pages.join(other, F.col("to") == (k * 7 + 3) % 97, "left").select(
        "url",
        F.when(k % 3 == 0, 301).when(k % 9 == 2, 302).when(k % 9 == 5, 307).otherwise(200).alias("status"),
        F.when(k % 3 == 0, F.col("other")).when(k % 9 == 2, F.concat(F.lit("/none/"), (k % 97).cast("string"))).when(k % 9 == 5, "http:\\\\localhost\\x").alias("location"),
    )
    hosts = pages.select(host.alias("host")).distinct().withColumn("addresses", F.array(F.when(F.col("host").startswith("blog."), "10.0.0.9").otherwise("8.8.8.8")))
    made = redirects.follow(pages, answers, hosts)
    return made.select("page_id", "final_url", "status", F.size("redirect_chain").alias("hops"), F.array_join("redirect_chain", " ").alias("chain"), "loops", "code")


# --- encoded bodies -------------------------------------------------------------------------------------------

_CODE = "CASE WHEN octet_length(encode(html)) > 6000 THEN 'RESPONSE_TOO_LARGE' WHEN page_id % 7 = 3 THEN 'UNSUPPORTED_CONTENT_ENCODING' WHEN page_id % 7 = 5 THEN 'UPSTREAM_HTTP_FAILURE' END"


@query(f"""SELECT page_id, {_CODE} AS code, CASE WHEN {_CODE} IS NULL THEN octet_length(encode(html)) END AS bytes, CASE WHEN {_CODE} IS NULL THEN sha256(html) END AS body_hash FROM pages""")
def encoded_bodies(spark, d):
    """Pages as they come over the wire: gzip of one and of several members, deflate, both, plain; some with an unknown
    encoding, some without their last bytes; at most 6,000 bytes once decoded."""
    gz, de = inflate.encoder("gzip"), inflate.encoder("deflate")
    ways = [(lambda b: b, ""), (gz, "gzip"), (lambda b: b"".join(gz(b[i : i + 700]) for i in range(0, len(b), 700)), "x-gzip"), (de, "deflate"), (lambda b: de(gz(b)), "gzip, deflate")]

    def sent(batches):
        for batch in batches:
            for part in inflate.slices(batch, "html"):
                rows = []
                for i, b in zip(part.column("page_id").to_pylist(), part.column("html"), strict=True):
                    make, name = ways[4 if i % 7 == 5 else 0 if i % 7 == 3 else i % 5]
                    made = make(b.as_py().encode())
                    rows.append((made[:-4] if i % 7 == 5 else made, name + ", br" * (i % 7 == 3)))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([w for w, _ in rows], pa.binary()), pa.array([e for _, e in rows], pa.string())], names=["page_id", "wire", "encoding"])

    pages = table(spark, d, "pages").select("page_id", "html")
    rows = pages.mapInArrow(sent, f"page_id {dict(pages.dtypes)['page_id']}, wire binary, encoding string")
    got = inflate.decode_rows(rows.select("page_id", "wire", wire.content_encodings(F.col("encoding")).alias("tokens")), "wire", "tokens", 6000)
    ok = F.col("code").isNull()
    return got.select("page_id", "code", F.when(ok, F.col("bytes")).alias("bytes"), F.when(ok, F.sha2("body", 256)).alias("body_hash"))


# --- paged sources --------------------------------------------------------------------------------------------

HEAD, DAYS = 50_000, 2
_TRANSFERS = "SELECT '0x' || lpad(CAST(o_custkey AS VARCHAR), 40, '0') AS sender, '0x' || lpad(CAST(l_suppkey AS VARCHAR), 40, '0') AS recipient, l_orderkey AS block FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _log(spark, d) -> str:
    """A transfer log made of line items (block: order key), written in chunks."""
    pad = lambda c: F.concat(F.lit("0x" + "0" * 24), F.lpad(F.col(c).cast("string"), 40, "0"))
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    path = shared_path(spark, "log")
    paged.write_log(rows.select(F.col("l_orderkey").alias("block"), F.col("l_orderkey").cast("string").alias("tx"), F.array(F.lit("transfer"), pad("o_custkey"), pad("l_suppkey")).alias("topics")), path, HEAD, DAYS)
    return path


@query(f"SELECT sender, recipient, count(*) AS n FROM ({_TRANSFERS}) JOIN supplier ON recipient = '0x' || lpad(CAST(s_suppkey AS VARCHAR), 40, '0') WHERE s_nationkey < 12 AND block BETWEEN 100 AND 30000 GROUP BY ALL")
def paged_log_transfers(spark, d):
    """Transfers to wanted recipients in a range of blocks, read chunk by chunk."""
    wanted = table(spark, d, "supplier").filter("s_nationkey < 12").select(F.concat(F.lit("0x"), F.lpad(F.col("s_suppkey").cast("string"), 40, "0")).alias("address"))
    return feeds.transfers(paged.read_log(spark, _log(spark, d), HEAD, DAYS), wanted, 100, 30_000).groupBy("sender", "recipient").agg(F.count("*").alias("n"))


@query("SELECT first, least(first + 1999, 50000) AS last, count(l_orderkey) AS n FROM range(1, 50001, 2000) t(first) LEFT JOIN lineitem ON l_orderkey BETWEEN first AND least(first + 1999, 50000) GROUP BY ALL")
def block_chunks(spark, d):
    """Every chunk of the last days with its number of log rows."""
    rows = paged.read_log(spark, _log(spark, d), HEAD, DAYS).groupBy((F.col("block") - (F.col("block") - 1) % feeds.CHUNK).alias("first")).agg(F.count("*").alias("n"))
    return feeds.block_chunks(spark, HEAD, DAYS).join(rows, "first", "left").select("first", F.col("last").cast("bigint").alias("last"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH i AS (SELECT p_partkey AS place, p_name, p_retailprice, p_size FROM part)
SELECT place - place % 300 AS "offset", count(*) AS items, (SELECT count(*) FROM i) AS total, CAST(sum(p_size) AS DOUBLE) AS calls, min(p_name) AS first_name, count_if(p_retailprice > 1000) AS dear FROM i GROUP BY place - place % 300""")
def paged_catalogue(spark, d):
    """Parts as catalogue items in pages of 300, read back page by page."""
    part = table(spark, d, "part")
    item = F.struct(F.col("p_name").alias("resource"), F.array(F.struct(F.round(F.col("p_retailprice") * 100).cast("long").cast("string").alias("amount"))).alias("accepts"), F.struct(F.col("p_size").alias("l30DaysTotalCalls")).alias("quality"))
    path = shared_path(spark, "pages")
    paged.write_pages(part.select(F.col("p_partkey").alias("place"), item.alias("item")), path, page=300)
    read = paged.read_pages(spark, path, 300, last_offset=None)
    return read.groupBy("offset").agg(F.count("*").alias("items"), F.max("total").alias("total"), F.round(F.sum("quality.l30DaysTotalCalls"), 4).alias("calls"), F.min("resource").alias("first_name"), F.count_if(F.col("accepts")[0]["amount"].cast("long") > 100_000).alias("dear"))
