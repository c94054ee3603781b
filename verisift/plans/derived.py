"""Registered queries of small functions over whole tables: their inputs are made of the rows, and so are the results in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verisift.functions import classify, urls, wire
from verisift.operators import requests, tables
from verisift.plans.catalog import _IP_CASE, _KEYED, query, table
from verisift.sources import feeds


def _pick(by: Column, *ways: Column | str | None) -> Column:
    """The way of each remainder of a whole number."""
    as_column = lambda w: w if isinstance(w, Column) else F.lit(w)
    out, n = None, len(ways)
    for i, w in enumerate(ways):
        out = F.when(by % n == i, as_column(w)) if out is None else out.when(by % n == i, as_column(w))
    return out


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


class _Columns:
    """Columns by name, and parts of a page's URL; made when asked for, as a column needs a session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)

    scheme = property(lambda self: F.regexp_extract("url", "^([a-z]+):", 1))
    host = property(lambda self: F.regexp_extract("url", "://([^/?#]+)", 1))
    rest = property(lambda self: F.regexp_extract("url", "://[^/?#]+(.*)$", 1))
    loud = property(lambda self: F.concat(F.upper(self.scheme), F.lit("://"), F.upper(self.host), F.when(F.col("url").startswith("https"), ":443").otherwise(":80"), self.rest))
    hexa = property(lambda self: F.lower(F.hex(F.col("event_id") % 65536)))


C = _Columns()


# --- URLs over pages ------------------------------------------------------------------------------------------


@query(f"SELECT page_id, cache_key AS result FROM {_KEYED}")
def cache_key_cases(spark, d):
    """One canonical form, however a page's URL is spelt."""
    head = F.regexp_extract("url", "^[^#]*", 0)
    more = F.concat(head, F.when(head.contains("?"), "&").otherwise("?"), F.lit("UTM_x=1&GCLID=2"))
    made = _pick(C.page_id, F.col("url"), F.regexp_replace("url", "://", "://u:p@"), C.loud, F.concat(C.scheme, F.lit("://"), C.host, F.lit("/z/.."), C.rest), more)
    return table(spark, d, "pages").select("page_id", made.alias("u")).select("page_id", urls.cache_key(F.col("u")).alias("result"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'no url ' || page_id WHEN 1 THEN '[::' || page_id || ']' ELSE lower(regexp_extract(url, '://([^/?#]+)', 1)) END AS result FROM pages")
def host_of_cases(spark, d):
    made = _pick(C.page_id, _text("no url ", C.page_id), _text("http://[::", C.page_id, "]/x"), F.concat(F.lit("HTTPS://U:P@"), F.upper(C.host), F.lit(":8/x")))
    return table(spark, d, "pages").select("page_id", made.alias("u")).select("page_id", urls.host_of(F.col("u")).alias("result"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '[unparseable-url]' ELSE regexp_replace(url, '[?#].*', '') END AS result FROM pages")
def safe_url_cases(spark, d):
    made = _pick(C.page_id, _text("::", C.page_id), F.concat(F.regexp_replace("url", "://", "://u:p@"), F.lit("?token=1#x")), F.concat(C.loud, F.lit("#?secret")))
    return table(spark, d, "pages").select("page_id", made.alias("u")).select("page_id", urls.safe_url(F.col("u")).alias("result"))


@query("""SELECT page_id, CASE page_id % 20 WHEN 2 THEN 'INVALID_URL: not a valid absolute URL' WHEN 3 THEN 'INVALID_URL: unsupported scheme ftp' WHEN 4 THEN 'INVALID_URL: unsupported scheme file' WHEN 5 THEN 'INVALID_URL: unsupported scheme javascript'
 WHEN 6 THEN 'BLOCKED_URL: URLs containing credentials are not allowed' WHEN 7 THEN 'BLOCKED_URL: internal hostname (localhost)' WHEN 8 THEN 'BLOCKED_URL: internal hostname suffix (.internal)' WHEN 9 THEN 'BLOCKED_URL: numeric host loopback (127.0.0.0/8)'
 WHEN 10 THEN 'BLOCKED_URL: numeric host loopback (127.0.0.0/8)' WHEN 11 THEN 'BLOCKED_URL: numeric host loopback (127.0.0.0/8)' WHEN 12 THEN 'BLOCKED_URL: IPv6 loopback (::1)' WHEN 13 THEN 'BLOCKED_URL: port 22 is not allowed' WHEN 14 THEN 'INVALID_URL: not a valid absolute URL'
 WHEN 15 THEN 'INVALID_URL: hostname did not resolve' WHEN 16 THEN 'BLOCKED_URL: resolved private (10.0.0.0/8)' WHEN 18 THEN 'INVALID_URL: not a valid absolute URL' WHEN 19 THEN 'INVALID_URL: not a valid absolute URL' END AS result, CASE WHEN page_id % 20 NOT IN (0, 1) AND url IS NOT NULL THEN true END AS plain FROM pages""")
def url_validation(spark, d):
    """Every page's URL in one of the twenty forms that a check must tell apart, and whether the URL itself passes (`plain`, of
    the pages whose form is not that already)."""
    n = C.page_id % 250
    path = F.regexp_extract("url", "://[^/?#]+([^?#]*)", 1)
    at = lambda head, tail="": F.concat(F.lit(head), F.lit(tail), path)
    made = _pick(
        C.page_id, F.col("url"), F.concat(F.lit("http://"), C.host, F.lit(":8080/x")), _text("nonsense ", C.page_id), F.regexp_replace("url", "^https?", "ftp"), at("file://"), _text("javascript:alert(", C.page_id, ")"), F.regexp_replace("url", "://", "://user:pw@"),
        at("http://localhost"), F.concat(F.lit("http://"), C.host, F.lit(".internal/x")), F.concat(_text("http://127.0.0.", n), path), F.concat(_text("http://", F.lit(2130706433) + n), path), F.concat(_text("http://0x7f.", n), path), at("http://[::1]"),
        F.concat(F.lit("https://"), C.host, F.lit(":22/x")), F.concat(F.lit("https://"), C.host, F.lit(":99999/x")), F.col("url"), F.col("url"), F.concat(_text("http://8.8.8.", n), path), "https://", None,
    )
    none, one = F.lit(None).cast("array<string>"), F.array(F.lit("8.8.8.8"))
    k = C.page_id % 20
    found = F.when(k == 1, F.array(F.lit("8.8.8.8"), F.lit("2606:2800:220:1::1"))).when(k == 7, F.array(F.lit("127.0.0.1"))).when(k == 16, F.array(F.lit("8.8.8.8"), _text("10.0.0.", n))).when(k.isin(0, 3, 6, 13, 14), one).otherwise(none)
    rows = table(spark, d, "pages").select("page_id", "url", made.alias("u"), found.alias("a"))
    passes = F.when(~k.isin(0, 1) & F.col("url").isNotNull(), urls.validate_url(F.col("url"), one)["code"].isNull())
    return rows.select("page_id", urls.validate_url(F.col("u"), F.col("a")).alias("v"), passes.alias("plain")).select("page_id", F.concat("v.code", F.lit(": "), "v.reason").alias("result"), "plain")


@query("SELECT page_id, url || '|x|https://b.com/' || page_id AS result FROM pages")
def unique_urls_cases(spark, d):
    given = F.array(F.col("url"), F.concat(F.lit(" "), F.col("url"), F.lit(" ")), F.lit(""), C.loud, F.lit("x"), F.concat("url", F.lit("#z")), F.lit(" x"), _text("https://b.com/", C.page_id))
    return table(spark, d, "pages").select("page_id", given.alias("g")).select("page_id", F.array_join(requests.unique_urls(F.col("g")), "|").alias("result"))


# --- addresses and ports over events --------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '8193,3512,0,0,0,0,0,' || n WHEN 1 THEN '1,2,3,4,5,6,7,' || n WHEN 2 THEN n || ',0,0,0,0,0,0,0' END AS result FROM (SELECT event_id, event_id % 65536 AS n FROM events)""")
def ipv6_groups(spark, d):
    made = _pick(C.event_id, F.concat(F.lit("2001:db8::"), C.hexa), F.concat(F.lit("1:2:3:4:5:6:7:"), C.hexa), F.concat(C.hexa, F.lit("::")), F.concat(F.lit("1::2::"), C.hexa))
    return table(spark, d, "events").select("event_id", F.array_join(urls.expand_ipv6(made), ",").alias("result"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'IPv6 loopback (::1)' WHEN 1 THEN 'IPv6 link-local (fe80::/10)' WHEN 2 THEN 'IPv6 unique-local (fc00::/7)' WHEN 3 THEN 'IPv6 multicast (ff00::/8)'
 WHEN 4 THEN 'IPv4-mapped private (10.0.0.0/8)' WHEN 6 THEN 'unparseable IPv6 address' WHEN 7 THEN 'IPv6 unspecified (::)' END AS result FROM events""")
def ipv6_classes(spark, d):
    made = _pick(C.event_id, "::1", F.concat(F.lit("fe80::"), C.hexa), F.concat(F.lit("fd00:"), C.hexa, F.lit("::1")), F.concat(F.lit("ff02::"), C.hexa), F.concat(F.lit("::ffff:a00:"), C.hexa), F.concat(F.lit("2606:4700::"), C.hexa), F.concat(F.lit("x"), C.hexa), "::")
    return table(spark, d, "events").select("event_id", urls.classify_ipv6(made).alias("result"))


@query(f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not a valid IP address' WHEN event_id % 5 = 1 THEN 'IPv6 loopback (::1)' ELSE (CASE {_IP_CASE} END) END AS result FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS n FROM events)""")
def ip_classes(spark, d):
    n = (C.event_id * 2654435761) % (1 << 32)
    octet = lambda bits: F.shiftright(n, bits).bitwiseAND(255)
    made = F.when(C.event_id % 5 == 0, _text("host", C.event_id)).when(C.event_id % 5 == 1, "::1").otherwise(_text(octet(24), ".", octet(16), ".", octet(8), ".", octet(0)))
    return table(spark, d, "events").select("event_id", made.alias("a")).select("event_id", urls.classify_ip(F.col("a")).alias("result"))


@query("SELECT event_id, CASE WHEN p NOT BETWEEN 1 AND 65535 THEN 'invalid port' WHEN p NOT IN (80, 443, 8080, 8443) THEN 'port ' || p || ' is not allowed' END AS result FROM (SELECT event_id, (event_id * 7) % 70000 - 4 AS p FROM events)")
def port_classes(spark, d):
    return table(spark, d, "events").select("event_id", ((C.event_id * 7) % 70000 - 4).cast("int").alias("p")).select("event_id", urls.classify_port(F.col("p")).alias("result"))


@query("""SELECT event_id, CASE event_id % 18 WHEN 0 THEN 'numeric host loopback (127.0.0.0/8)' WHEN 1 THEN 'numeric host loopback (127.0.0.0/8)' WHEN 2 THEN 'numeric host loopback (127.0.0.0/8)' WHEN 3 THEN 'numeric host loopback (127.0.0.0/8)' WHEN 4 THEN 'numeric host private (10.0.0.0/8)'
 WHEN 5 THEN 'numeric host private (172.16.0.0/12)' WHEN 7 THEN 'numeric host private (192.168.0.0/16)' WHEN 8 THEN 'numeric host link-local / cloud metadata (169.254.0.0/16)' WHEN 11 THEN 'internal hostname (localhost)' WHEN 12 THEN 'internal hostname (metadata.goog)' WHEN 13 THEN 'internal hostname suffix (.internal)'
 WHEN 14 THEN 'internal hostname suffix (.local)' WHEN 16 THEN 'empty hostname' WHEN 17 THEN 'numeric host reserved (240.0.0.0/4)' END AS reason FROM events""")
def host_classify(spark, d):
    """A host for every event, in one of the eighteen forms that a check must tell apart."""
    n = C.event_id % 256
    made = _pick(
        C.event_id, _text("127.0.0.", n), _text(F.lit(2130706433) + C.event_id % 16_000_000), _text("0x7f.", n), _text("0177.0.0.", C.event_id % 8), _text("10.1.", n, ".7"), _text("172.31.", n, ".255"), _text("172.32.0.", n), _text("192.168.", n), _text("169.254.", n, ".254"),
        _text("8.8.8.", n), _text("1.2.3.", F.lit(256) + n), "LOCALHOST.", "metadata.goog", _text("h", C.event_id, ".Internal"), _pick(F.floor(C.event_id / 18), "local", _text("h", C.event_id, ".local")), _text("h", C.event_id, ".example.com"), "", _text("255.255.255.", n),
    )
    return table(spark, d, "events").select("event_id", urls.classify_host(made).alias("reason"))


# --- requests over conversations and events -------------------------------------------------------------------


@query("""WITH r AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '  ' WHEN 2 THEN repeat('x', CAST(1999 + turn % 3 AS INTEGER)) WHEN 3 THEN text END AS q, CASE WHEN conv_id % 7 <> 0 THEN conv_id % 30 END AS n, turn * 9 AS m,
 CASE turn % 3 WHEN 0 THEN 'en' WHEN 1 THEN '' ELSE repeat('x', 36) END AS lang, CASE turn % 2 WHEN 0 THEN 'evidence' ELSE 'search' END AS mode FROM conversations)
SELECT conv_id, turn, concat_ws(',', CASE WHEN NOT coalesce(length(trim(q)) BETWEEN 1 AND 2000, false) THEN 'question' END, CASE WHEN n > 25 THEN 'urls' END, CASE WHEN m NOT BETWEEN 1 AND 25 THEN 'max_sources' END, CASE WHEN length(lang) NOT BETWEEN 1 AND 35 THEN 'language' END, CASE WHEN mode <> 'evidence' THEN 'mode' END) AS result FROM r""")
def request_validation(spark, d):
    q = _pick(C.conv_id, "  ", None, F.expr("repeat('x', CAST(1999 + turn % 3 AS INT))"), F.col("text"))
    given = F.when(C.conv_id % 7 != 0, F.array_repeat(F.lit("u"), (C.conv_id % 30).cast("int")))
    lang, mode = _pick(C.turn, "en", "", "x" * 36), _pick(C.turn, "evidence", "search")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(requests.request_issues(q, given, C.turn * 9, lang, mode), ",").alias("result"))


@query("SELECT event_id, CASE WHEN n = 0 THEN 'At least one source URL is required. Version 0.1.0 supports agent-supplied URLs only.' WHEN n > 5 THEN 'Too many URLs: ' || n || ' supplied, limit is 5.' END AS result FROM (SELECT event_id, event_id % 8 AS n FROM events)")
def request_policy(spark, d):
    return table(spark, d, "events").select("event_id", requests.policy_error(F.array_repeat(F.lit("u"), (C.event_id % 8).cast("int"))).alias("result"))


@query("SELECT event_id, CAST(least(coalesce(m, n), n, 5, 25) AS INTEGER) AS result FROM (SELECT event_id, event_id % 11 AS n, nullif(event_id % 7, 0) AS m FROM events)")
def effective_limit(spark, d):
    return table(spark, d, "events").select("event_id", F.size(requests.targets(F.array_repeat(F.lit("u"), (C.event_id % 11).cast("int")), F.nullif((C.event_id % 7).cast("int"), F.lit(0)))).alias("result"))


@query("""SELECT conv_id, turn, CASE WHEN length(trim(substr(text, 1, turn * 4 + conv_id % 9))) >= 8 THEN CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'url must be one absolute http(s) URL.' END ELSE 'question must be at least 8 characters.' END AS result FROM conversations""")
def preview_validation(spark, d):
    q = F.substring("text", F.lit(1), (C.turn * 4 + C.conv_id % 9).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", requests.preview_error(q, _pick(C.conv_id, _text("https://a.com/", C.conv_id), "a.com", None)).alias("result"))


@query("SELECT conv_id, turn, coalesce(regexp_matches(substr(text, 1, conv_id % 4), '^[A-Za-z]{2}$'), false) AS result FROM conversations")
def state_validation(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", requests.place_valid(state=F.substring("text", F.lit(1), (C.conv_id % 4).cast("int"))).alias("result"))


@query("SELECT event_id, event_id % 11 <> 0 AND value - 50 BETWEEN -90 AND 90 AND value * 2 - 30 BETWEEN -180 AND 180 AS result FROM events")
def place_validation(spark, d):
    return table(spark, d, "events").select("event_id", requests.place_valid(lat=F.when(C.event_id % 11 != 0, F.col("value") - 50), lon=F.col("value") * 2 - 30).alias("result"))


@query("""WITH r AS (SELECT page_id, octet_length(encode(html)) * (1 + page_id % 600) AS size, CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 3 THEN 'TEXT/PLAIN' END AS ct FROM pages)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'BLOCKED_URL: robots.txt disallows this path for our user agent (rule: "/p' || page_id || '").' WHEN size > 2097152 THEN 'RESPONSE_TOO_LARGE: response exceeded the maximum allowed size'
 WHEN size > 65536 AND size > (size // (1 + page_id % 300)) * 200 THEN 'RESPONSE_TOO_LARGE: response expanded beyond the maximum allowed decompression ratio'
 WHEN ct IS NULL THEN 'UNSUPPORTED_CONTENT: The source returned no content type, which this service does not process.' WHEN ct = 'application/pdf' THEN 'UNSUPPORTED_CONTENT: The source returned application/pdf, which this service does not process.' END AS result FROM r""")
def source_gates(spark, d):
    size = F.octet_length("html") * (1 + C.page_id % 600)
    rows = table(spark, d, "pages").select("page_id", size.alias("size"), F.floor(size / (1 + C.page_id % 300)).alias("wire"), _pick(C.page_id, "text/html; charset=utf-8", "application/pdf", None, "TEXT/PLAIN").alias("ct"))
    gate = requests.source_gate(F.col("ct"), F.col("size"), F.col("wire"), C.page_id % 5 != 0, _text("/p", C.page_id), policy="enforce")
    return rows.select("page_id", gate.alias("g")).select("page_id", F.concat("g.code", F.lit(": "), "g.message").alias("result"))


@query("SELECT page_id, page_id % 5 = 4 AS result FROM pages")
def payload_usable_cases(spark, d):
    k = C.page_id % 5
    made = F.concat(F.lit('{"doc":'), F.when(k == 0, "null").otherwise(F.to_json(F.struct("url"))), F.lit(',"candidates":'), F.when(k == 1, "{}").otherwise("[]"), F.lit(',"finalUrl":"u","status":'), F.when(k == 2, '"200"').otherwise("200"), F.when(k == 3, "").otherwise("}"))
    return table(spark, d, "pages").select("page_id", requests.payload_usable(made).alias("result"))


# --- the wire over events -------------------------------------------------------------------------------------


@query("SELECT event_id, event_id % 6 IN (1, 4, 5) AS result FROM events")
def payment_needed(spark, d):
    ping, call = _text('{"id":', C.event_id, ',"method":"ping"}'), lambda name: _text('{"id":', C.event_id, ',"method":"tools/call","params":{"name":"' + name + '"}}')
    made = _pick(C.event_id, ping, call("research_evidence"), call("health"), F.concat(F.lit("["), ping, F.lit(',{"method":"tools/list"}]')), F.concat(F.lit("["), ping, F.lit(","), call("research_evidence"), F.lit("]")), _text("{broken", C.event_id))
    return table(spark, d, "events").select("event_id", wire.needs_payment(made, wire.PAID_EVIDENCE).alias("result"))


@query("SELECT event_id, event_id % 6 IN (1, 2, 3, 5) AS result FROM events")
def response_failures(spark, d):
    good, bad = _text('{"id":', C.event_id, ',"result":{}}'), _text('{"id":', C.event_id, ',"error":{"code":', C.event_id % 7, "}}")
    made = _pick(C.event_id, good, bad, _text('{"id":', C.event_id, ',"result":{"isError":true}}'), F.concat(F.lit("["), good, F.lit(",["), bad, F.lit("]]")), F.concat(F.lit("data: "), good, F.lit("\n\ndata: "), good), F.concat(F.lit("event: message\ndata: "), good, F.lit("\r\ndata: "), bad, F.lit("\n")))
    return table(spark, d, "events").select("event_id", wire.response_failed(made, F.when(C.event_id % 6 >= 4, "text/event-stream").otherwise("application/json")).alias("result"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN replace(props, ': ', ':') END AS result FROM events")
def header_json(spark, d):
    made = _pick(C.event_id, F.base64(F.col("props").cast("binary")), F.col("props"), F.base64(_text("not json ", C.event_id).cast("binary")))
    return table(spark, d, "events").select("event_id", wire.decode_header(made).alias("result"))


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN '{"api_key":"[redacted]","a":' || replace(props, ': ', ':') || ',"b":[{"Password":"[redacted]"},' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || ']}' END AS result FROM events""")
def redactions(spark, d):
    made = F.concat(F.lit('{"api_key":"'), F.col("user_id").cast("string"), F.lit('","a":'), F.col("props"), F.lit(',"b":[{"Password":[1]},'), F.col("value").cast("string"), F.when(C.event_id % 9 == 0, "").otherwise("]}"))
    return table(spark, d, "events").select("event_id", wire.redact(made).alias("result"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 3 THEN CASE WHEN 9007199254736000 + event_id <= 9007199254740991 THEN 9007199254736000 + event_id END END AS result FROM events")
def content_lengths(spark, d):
    return table(spark, d, "events").select("event_id", wire.content_length(_pick(C.event_id, _text(C.event_id), _text("-", C.event_id), _text(C.event_id, ".5"), _text(F.lit(9007199254736000) + C.event_id))).alias("result"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || ',gzip' END AS result FROM events")
def encoding_tokens(spark, d):
    made = F.when(C.event_id % 3 != 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" , identity,, GZip")))
    return table(spark, d, "events").select("event_id", F.array_join(wire.content_encodings(made), ",").alias("result"))


@query("SELECT conv_id, turn, nullif(substr(regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f]', '', 'g'), 1, 60), '') AS result FROM conversations")
def agent_prefixes(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", wire.agent_prefix(F.col("text")).alias("result"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1.1.1.' || event_id % 200 WHEN 1 THEN '2.2.2.' || event_id % 200 ELSE '3.3.3.' || event_id % 200 END AS result FROM events")
def client_keys(spark, d):
    n = C.event_id % 200
    made = wire.client_key(_pick(C.event_id, _text(" 1.1.1.", n, " "), "", None, None), _pick(C.event_id, _text("9.9.9.", n), _text("2.2.2.", n, ", 4.4.4.4"), " ,x", None), _text("3.3.3.", n))
    return table(spark, d, "events").select("event_id", made.alias("result"))


@query("SELECT user_id, CASE WHEN count_if(value > 20) = 0 THEN 'n/a' ELSE printf('%.1f%%', round(100.0 * count_if(event_type = 'error' AND value > 20) / count_if(value > 20), 1)) END AS result FROM events GROUP BY user_id")
def percents(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("value") > 20)).alias("n"), F.count_if(F.col("value") > 20).alias("d"))
    return g.select("user_id", wire.percent(F.col("n"), F.col("d")).alias("result"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id * 37 / 1e6 WHEN 2 THEN 0.0 END AS result FROM events")
def amounts_usd(spark, d):
    return table(spark, d, "events").select("event_id", wire.amount_usd(_pick(C.event_id, _text(C.event_id * 37), _text("x", C.event_id), "", None)).alias("result"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '0.000000' ELSE printf('%.6f', event_id * 977 / 1e6) END AS result FROM events")
def wallet_amounts(spark, d):
    made = _pick(C.event_id, _text("x", C.event_id), F.concat(F.lit("0x"), F.hex(C.event_id * 977)), F.concat(F.lit("0X"), F.lower(F.hex(C.event_id * 977))))
    return table(spark, d, "events").select("event_id", wire.wallet_usd(made).cast("string").alias("result"))


@query("SELECT event_id, round(greatest(user_id - value, 0), 4) AS spent, round(500 - greatest(user_id - value, 0), 4) AS remaining, 500 - greatest(user_id - value, 0) > 0 AS inside FROM events")
def budgets(spark, d):
    b = table(spark, d, "events").select("event_id", wire.budget(F.col("value"), F.col("user_id").cast("double"), F.lit(500.0)).alias("b"))
    return b.select("event_id", F.round("b.spent", 4).alias("spent"), F.round("b.remaining", 4).alias("remaining"), "b.inside")


@query("SELECT event_id, printf('%.4f', value / 3.0::DOUBLE - 60) AS result FROM events")
def coordinates(spark, d):
    return table(spark, d, "events").select("event_id", wire.fixed4(F.col("value") / 3.0 - 60).alias("result"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '.000Z' WHEN 2 THEN strftime(ts, '%Y-%m-%d') || 'T00:00:00.000Z' END AS result FROM events""")
def iso_times(spark, d):
    at = lambda f: F.date_format("ts", f)
    made = _pick(C.event_id, at("yyyy-MM-dd HH:mm:ss"), F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), at("yyyy-MM-dd"), _text("soon ", C.event_id))
    return table(spark, d, "events").select("event_id", wire.to_iso(made).alias("result"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '504 {"error":{"code":"TIMEOUT","message":"The source did not respond within the allowed time.","request_id":"r' || event_id || '"}}'
 WHEN 1 THEN '429 {"error":{"code":"RATE_LIMIT","message":"wait ' || event_id || '","request_id":"r' || event_id || '"}}' ELSE '404 {"error":{"code":"NOT_FOUND","message":"No such endpoint.","request_id":"r' || event_id || '"}}' END AS result FROM events""")
def error_envelopes(spark, d):
    made = tables.error_envelope(_pick(C.event_id, "TIMEOUT", "RATE_LIMIT", "NOT_FOUND"), _text("r", C.event_id), F.when(C.event_id % 3 == 1, _text("wait ", C.event_id)))
    return table(spark, d, "events").select("event_id", made.alias("e")).select("event_id", F.concat_ws(" ", F.col("e.status").cast("string"), "e.body").alias("result"))


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'curl' WHEN 1 THEN 'none' WHEN 2 THEN 'browser' WHEN 3 THEN 'python' WHEN 4 THEN 'gptbot' WHEN 5 THEN 'node' WHEN 6 THEN 'go' WHEN 7 THEN 'other' ELSE 'googlebot' END AS client FROM events""")
def client_tokens(spark, d):
    v = C.event_id % 100
    made = _pick(C.event_id, _text("curl/8.", v), "", _text("Mozilla/5.0 (X11) AppleWebKit Chrome/", v, " Safari/537"), _text("python-requests/2.", v), _text("Mozilla/5.0 (compatible; GPTBot/", v, ")"), _text("node-fetch/", v), _text("Go-http-client/", v), _text("something ", v), _text("mozilla googlebot/2.", v))
    return table(spark, d, "events").select("event_id", classify.classify_client(made).alias("client"))


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 0 AND value > 0 THEN CAST(round(value * 1000000) AS BIGINT) END AS atomic,
 CASE WHEN event_id % 7 <> 0 AND value > 0 THEN '$' || regexp_replace(CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR), '\\.?0+$', '') END AS rendered FROM events""")
def price_render(spark, d):
    p = table(spark, d, "events").select("event_id", F.when(C.event_id % 7 == 0, _text("free ", C.event_id)).otherwise(F.concat(F.when(C.event_id % 2 == 0, "$").otherwise(""), F.col("value").cast("string"))).alias("p"))
    p = p.select("event_id", classify.price_atomic(F.col("p")).alias("atomic"))
    return p.select("event_id", "atomic", classify.price_string(F.col("atomic")).alias("rendered"))


@query("""SELECT event_id, 'Event: ' || event_type || chr(10) || 'Area: ' || CASE WHEN event_id % 2 = 0 THEN 'a' || user_id ELSE 'Unknown' END || chr(10) || 'Severity: ' || CASE WHEN event_id % 3 = 0 THEN 'Severe' ELSE 'Unknown' END || chr(10) || 'Description: No description available' || chr(10)
 || 'Instructions: ' || CASE WHEN event_id % 5 = 0 THEN 'leave' ELSE 'No specific instructions provided' END || chr(10) || '---' AS alert FROM events""")
def weather_alerts(spark, d):
    """Alerts in the JSON of a weather service, one feature for each event."""
    one = F.struct(F.col("event_type").alias("event"), F.when(C.event_id % 2 == 0, _text("a", F.col("user_id"))).alias("areaDesc"), F.when(C.event_id % 3 == 0, "Severe").alias("severity"), F.when(C.event_id % 5 == 0, "leave").alias("instruction"))
    raw = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.array(F.struct(one.alias("properties"))).alias("features"))).alias("body"))
    shape = "features array<struct<properties:struct<event:string,areaDesc:string,severity:string,description:string,instruction:string>>>"
    return raw.select("event_id", F.explode(F.from_json("body", shape)["features"]).alias("f")).select("event_id", classify.format_alert(F.col("f.properties")).alias("alert"))


@query("""WITH p AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events)
SELECT user_id, CAST(place AS INTEGER) AS place, event_type || ':' || chr(10) || 'Temperature: ' || CASE WHEN event_id % 4 = 0 THEN 'Unknown' ELSE CAST(floor(value) AS BIGINT) || '°F' END || chr(10) || 'Wind: ' || event_id % 30 || ' mph Unknown' || chr(10) || 'Clear.' || chr(10) || '---' AS period FROM p WHERE place <= 5""")
def weather_forecast(spark, d):
    """The first five periods of each user's forecast, in the JSON of a weather service."""
    one = F.struct(F.col("event_type").alias("name"), F.when(C.event_id % 4 != 0, F.floor("value").cast("int")).alias("temperature"), F.lit("F").alias("temperatureUnit"), _text(C.event_id % 30, " mph").alias("windSpeed"), F.lit("Clear.").alias("detailedForecast"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("p")))), lambda x: x["p"])
    raw = table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.struct(listed.alias("periods"))).alias("body"))
    shape = "periods array<struct<name:string,temperature:int,temperatureUnit:string,windSpeed:string,windDirection:string,detailedForecast:string>>"
    p = raw.select("user_id", F.posexplode(F.slice(F.from_json("body", shape)["periods"], 1, 5)).alias("i", "p"))
    return p.select("user_id", (F.col("i") + 1).alias("place"), classify.format_period(F.col("p")).alias("period"))


# --- listings over conversations, parts and pages -------------------------------------------------------------


def _turns(spark, d, one: Column, name: str):
    """Each conversation with a JSON object that lists its turns."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))), lambda x: x["x"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(listed.alias(name))).alias("body"))


@query("SELECT conv_id, CAST(min(i) FILTER (role = 'assistant') AS INTEGER) AS result FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id")
def own_rank(spark, d):
    return _turns(spark, d, F.struct("role"), "rows").select("conv_id", feeds.find_rank(F.col("body"), "$.rows", "role", "assistant").cast("int").alias("result"))


@query("SELECT conv_id, string_agg(role || turn, ',' ORDER BY role || turn) AS names, coalesce(string_agg(role || turn, ',' ORDER BY turn) FILTER (turn % 2 = 1), '') AS untyped FROM conversations GROUP BY conv_id")
def tool_lists(spark, d):
    one = F.struct(F.concat("role", C.turn.cast("string")).alias("name"), F.when(C.turn % 2 == 0, F.struct(F.lit("object").alias("type"))).alias("outputSchema"))
    t = _turns(spark, d, one, "tools").select("conv_id", tables.tool_list(F.col("body")).alias("t"))
    return t.select("conv_id", "t.names", F.array_join("t.untyped", ",").alias("untyped"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 1 THEN 'size' END, CASE WHEN p_partkey % 3 = 0 THEN 'brand' END) AS result FROM part")
def manifest_fields(spark, d):
    k = F.col("p_partkey")
    manifest = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")))
    challenge = F.to_json(F.struct((F.col("p_size") + k % 2).alias("size"), F.when(k % 3 != 0, F.col("p_brand")).alias("brand")))
    return table(spark, d, "part").select("p_partkey", F.array_join(tables.manifest_differs(manifest, challenge, ["size", "brand", "none"]), ",").alias("result"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY first) AS result FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def registry_names(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("names"))
    return g.select("conv_id", tables.names_seen(F.col("names")).alias("result"))


@query("SELECT user_id, CAST(count(*) FILTER (event_type = 'view' AND event_id % 3 <> 0) AS INTEGER) AS result FROM events GROUP BY user_id")
def checks_failed(spark, d):
    check = F.struct(F.when(F.col("event_type") == "view", "required").otherwise("optional").alias("severity"), F.when(C.event_id % 3 == 0, True).when(C.event_id % 3 == 1, False).alias("passed"))
    return table(spark, d, "events").groupBy("user_id").agg(F.collect_list(check).alias("c")).select("user_id", tables.failed_checks(F.col("c")).alias("result"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT 'o' || page_id AS origin, allow, CASE WHEN allow THEN '/open' ELSE path END AS path FROM u, (SELECT unnest([true, false]) AS allow) WHERE page_id % 4 IN (0, 1) OR (page_id % 4 = 2 AND NOT allow)""")
def robots_parse(spark, d):
    """A robots.txt for each page: groups for all agents, for ours before those, for two agents at once, and for others only."""
    path = F.regexp_extract("url", "://[^/?#]+([^?#]*)", 1)
    rules = F.concat(F.lit("Disallow: "), path, F.lit(" # no\r\nAllow: /open\r\nDisallow:\r\n"))
    made = _pick(C.page_id, F.concat(F.lit("# all\nUser-agent: *\n"), rules), F.concat(F.lit("User-agent: *\nDisallow: /\n\nUSER-AGENT : VerisiftBot\nCrawl-delay: 3\n"), rules), F.concat(F.lit("Disallow: /early\nUser-agent: other\nUser-agent: verisift\nDisallow: "), path), F.concat(F.lit("User-agent: other/1\n"), rules))
    bodies = table(spark, d, "pages").select(_text("o", C.page_id).alias("origin"), made.alias("body"))
    return feeds.parse_robots(bodies, "VerisiftBot/1.0 (+x)")
