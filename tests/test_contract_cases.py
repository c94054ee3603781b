"""Small functions on literal cases: each row holds the inputs and the value that must come out, written by hand."""

import pytest
from pyspark.sql import functions as F

from verisift.functions import classify, urls, wire
from verisift.operators import requests, tables
from verisift.sources import feeds

CASES = {}


def cases(name, rows, schema, result, kind=None):
    CASES[name] = (rows, schema, result)


cases(
    "cache_key_cases",
    [
        ("HTTPS://Example.COM/Path/", "https://example.com/Path"), ("https://example.com", "https://example.com/"), ("https://example.com/?", "https://example.com/"),
        ("https://example.com:443/a", "https://example.com/a"), ("http://example.com:80/a", "http://example.com/a"), ("http://example.com:8080/a", "http://example.com:8080/a"),
        ("https://u:p@example.com/a#f", "https://example.com/a"), ("https://example.com/a?b=2&a=1", "https://example.com/a?a=1&b=2"), ("https://example.com/a?x=2&x=1", "https://example.com/a?x=1&x=2"),
        ("https://example.com/?a=1&a-b=2", "https://example.com/?a=1&a-b=2"), ("https://example.com/?UTM_Source=x&FBCLID=y&ref=z&mc_cid=1&mc_eid=2&gclid=3&q=1", "https://example.com/?q=1"),
        ("https://example.com/?reference=1", "https://example.com/?reference=1"), ("https://example.com/?q=a%20b&r=a+b", "https://example.com/?q=a+b&r=a+b"), ("https://example.com/?q=%41&flag", "https://example.com/?flag=&q=A"),
        ("https://example.com/a/../b/", "https://example.com/b"), ("https://example.com/a/./b", "https://example.com/a/b"), ("http://[::1]/x", "http://[::1]/x"), ("http://0x7f.1/", "http://127.0.0.1/"),
        ("ftp://example.com/", None), ("not a url", None), ("", None), (None, None),
    ],
    "url string", urls.cache_key,
)
cases(
    "host_of_cases",
    [("https://A.example.com:8/x", "a.example.com"), ("http://[::1]/x", "[::1]"), ("http://u@h.example/x", "h.example"), ("nonsense", "nonsense"), (None, None)],
    "url string", urls.host_of,
)
cases(
    "safe_url_cases",
    [("https://u:p@example.com/a?token=1#x", "https://example.com/a"), ("http://example.com", "http://example.com/"), ("::", "[unparseable-url]"), (None, "[unparseable-url]")],
    "url string", urls.safe_url,
)
cases(
    "ipv6_groups",
    [
        ("::1", "0,0,0,0,0,0,0,1"), ("::", "0,0,0,0,0,0,0,0"), ("fe80::1%eth0", "65152,0,0,0,0,0,0,1"), ("2001:db8::8a2e:370:7334", "8193,3512,0,0,0,35374,880,29492"),
        ("1:2:3:4:5:6:7:8", "1,2,3,4,5,6,7,8"), ("::ffff:7f00:1", "0,0,0,0,0,65535,32512,1"), ("::ffff:127.0.0.1", "0,0,0,0,0,65535,0,0"), ("1::2::3", None), ("1:2:3", None), ("12345::", None), ("g::", None),
        ("1:2:3:4:5:6:7:8:9", None), ("::1.2.3.999", None), ("0:0:0:0:0:ffff:1.2.3.4", None),
    ],
    "address string", lambda a: F.array_join(urls.expand_ipv6(a), ","),
)
cases(
    "ipv6_classes",
    [
        ("::1", "IPv6 loopback (::1)"), ("::", "IPv6 unspecified (::)"), ("fe80::1", "IPv6 link-local (fe80::/10)"), ("febf::1", "IPv6 link-local (fe80::/10)"), ("fc00::1", "IPv6 unique-local (fc00::/7)"),
        ("fd12:3456::1", "IPv6 unique-local (fc00::/7)"), ("ff02::1", "IPv6 multicast (ff00::/8)"), ("::ffff:7f00:1", "IPv4-mapped loopback (127.0.0.0/8)"), ("::ffff:a00:1", "IPv4-mapped private (10.0.0.0/8)"),
        ("2606:4700:4700::1111", None), ("::ffff:808:808", None), ("xyz", "unparseable IPv6 address"), ("1::2::3", "unparseable IPv6 address"),
    ],
    "address string", urls.classify_ipv6,
)
cases(
    "ip_classes",
    [
        ("127.0.0.1", "loopback (127.0.0.0/8)"), ("8.8.8.8", None), ("169.254.169.254", "link-local / cloud metadata (169.254.0.0/16)"), ("10.1.2.3", "private (10.0.0.0/8)"), ("::1", "IPv6 loopback (::1)"),
        ("2001:4860:4860::8888", None), ("example.com", "not a valid IP address"), ("1.2.3", "not a valid IP address"), ("256.1.1.1", "not a valid IP address"), ("01.2.3.4", "not a valid IP address"), ("", "not a valid IP address"),
    ],
    "address string", urls.classify_ip,
)
cases("port_classes", [(80, None), (443, None), (8080, None), (8443, None), (22, "port 22 is not allowed"), (0, "invalid port"), (65536, "invalid port"), (65535, "port 65535 is not allowed"), (None, "invalid port")], "port int", urls.classify_port)
cases(
    "url_validation",
    [
        ("https://example.com/a", "93.184.216.34", None), ("http://example.com:8080/", "93.184.216.34 2606:2800:220:1::1", None), ("nonsense", None, "INVALID_URL: not a valid absolute URL"),
        ("ftp://example.com/", None, "INVALID_URL: unsupported scheme ftp"), ("file:///etc/passwd", None, "INVALID_URL: unsupported scheme file"), ("javascript:alert(1)", None, "INVALID_URL: unsupported scheme javascript"),
        ("https://user:pw@example.com/", "93.184.216.34", "BLOCKED_URL: URLs containing credentials are not allowed"), ("http://localhost/", "127.0.0.1", "BLOCKED_URL: internal hostname (localhost)"),
        ("http://a.internal/", None, "BLOCKED_URL: internal hostname suffix (.internal)"), ("http://127.0.0.1/", None, "BLOCKED_URL: numeric host loopback (127.0.0.0/8)"), ("http://2130706433/", None, "BLOCKED_URL: numeric host loopback (127.0.0.0/8)"),
        ("http://0x7f.1/", None, "BLOCKED_URL: numeric host loopback (127.0.0.0/8)"), ("http://[::1]/", None, "BLOCKED_URL: IPv6 loopback (::1)"), ("https://example.com:22/", "93.184.216.34", "BLOCKED_URL: port 22 is not allowed"),
        ("https://example.com:99999/", "93.184.216.34", "INVALID_URL: not a valid absolute URL"), ("https://example.com/", None, "INVALID_URL: hostname did not resolve"), ("https://example.com/", "93.184.216.34 10.0.0.8", "BLOCKED_URL: resolved private (10.0.0.0/8)"),
        ("http://8.8.8.8/", None, None), ("https://", None, "INVALID_URL: not a valid absolute URL"), (None, None, "INVALID_URL: not a valid absolute URL"),
    ],
    "url string, addresses string", lambda u, a: F.concat(urls.validate_url(u, F.split(a, " "))["code"], F.lit(": "), urls.validate_url(u, F.split(a, " "))["reason"]),
)
cases(
    "request_validation",
    [
        ("Is it so?", 2, 3, "en", "evidence", ""), ("  ", 1, None, None, None, "question"), (None, None, None, None, None, "question"), ("q", 26, 26, "", "search", "urls,max_sources,language,mode"), ("q", 25, 25, "auto", None, ""), ("q", 0, 0, "x" * 36, "evidence", "max_sources,language"),
        ("x" * 2000, None, 1, None, None, ""), ("x" * 2001, None, 1, None, None, "question"),
    ],
    "question string, n int, max_sources int, language string, mode string",
    lambda q, n, m, lang, mode: F.array_join(requests.request_issues(q, F.when(n.isNotNull(), F.array_repeat(F.lit("u"), F.coalesce(n, F.lit(0)))), m, lang, mode), ","),
)
cases(
    "unique_urls_cases",
    [
        ("https://a.com/|https://A.com|https://b.com/x/|https://b.com/x?utm_source=1", "https://a.com/|https://b.com/x/"), (" https://a.com/ ||  |x|x", "https://a.com/|x"), ("", ""),
        ("https://a.com/?b=1&a=2|https://a.com/?a=2&b=1|https://a.com/?a=2", "https://a.com/?b=1&a=2|https://a.com/?a=2"),
    ],
    "urls string", lambda u: F.array_join(requests.unique_urls(F.split(u, "\\|")), "|"),
)
cases(
    "request_policy",
    [(0, "At least one source URL is required. Version 0.1.0 supports agent-supplied URLs only."), (1, None), (5, None), (6, "Too many URLs: 6 supplied, limit is 5.")],
    "n int", lambda n: requests.policy_error(F.array_repeat(F.lit("u"), n)),
)
cases("effective_limit", [(3, None, 3), (3, 2, 2), (3, 9, 3), (9, None, 5), (9, 7, 5), (0, None, 0)], "n int, max_sources int", lambda n, m: F.size(requests.targets(F.array_repeat(F.lit("u"), n), m)), "INTEGER")
cases(
    "preview_validation",
    [("Is it so?", "https://a.com", None), ("short", "https://a.com", "question must be at least 8 characters."), ("   seven7 ", "x", "question must be at least 8 characters."), ("Is it so?", "a.com", "url must be one absolute http(s) URL."), ("Is it so?", None, "url must be one absolute http(s) URL."), (None, None, "question must be at least 8 characters.")],
    "question string, url string", requests.preview_error,
)
cases("state_validation", [("CA", True), ("ca", True), ("C", False), ("CAL", False), ("C1", False), ("", False), (None, False)], "state string", lambda s: requests.place_valid(state=s), "BOOLEAN")
cases("place_validation", [(0.0, 0.0, True), (90.0, 180.0, True), (-90.0, -180.0, True), (90.1, 0.0, False), (0.0, -180.5, False), (None, 0.0, False), (float("nan"), 0.0, False)], "lat double, lon double", lambda a, b: requests.place_valid(lat=a, lon=b), "BOOLEAN")
cases(
    "source_gates",
    [
        ("text/html; charset=utf-8", 10, 10, True, None), ("TEXT/HTML", 10, 10, None, None), ("application/pdf", 10, 10, True, "UNSUPPORTED_CONTENT: The source returned application/pdf, which this service does not process."),
        (None, 10, 10, True, "UNSUPPORTED_CONTENT: The source returned no content type, which this service does not process."), ("text/html", 2097153, 2097153, True, "RESPONSE_TOO_LARGE: response exceeded the maximum allowed size"),
        ("text/html", 65537, 300, True, "RESPONSE_TOO_LARGE: response expanded beyond the maximum allowed decompression ratio"), ("text/html", 65536, 1, True, None), ("text/html", 10, 10, False, 'BLOCKED_URL: robots.txt disallows this path for our user agent (rule: "/private").'),
    ],
    "ct string, size long, wire long, allowed boolean",
    lambda ct, n, w, a: F.concat(requests.source_gate(ct, n, w, a, F.lit("/private"), policy="enforce")["code"], F.lit(": "), requests.source_gate(ct, n, w, a, F.lit("/private"), policy="enforce")["message"]),
)
cases(
    "payload_usable_cases",
    [('{"doc":{},"candidates":[],"finalUrl":"u","status":200}', True), ('{"doc":null,"candidates":[],"finalUrl":"u","status":200}', False), ('{"doc":{},"candidates":{},"finalUrl":"u","status":200}', False), ('{"doc":{},"candidates":[],"finalUrl":"u","status":"200"}', False), ("{broken", False), ("null", False), (None, False)],
    "payload string", requests.payload_usable, "BOOLEAN",
)
cases(
    "payment_needed",
    [
        ('{"method":"initialize"}', False), ('{"method":"ping"}', False), ('{"method":"tools/call","params":{"name":"research_evidence"}}', True), ('{"method":"tools/call","params":{"name":"health"}}', False), ('{"method":"tools/call"}', True),
        ('{"method":"tools/call","params":null}', True), ('{"method":"resources/read"}', True), ('[{"method":"ping"},{"method":"tools/list"}]', False), ('[{"method":"ping"},{"method":"tools/call","params":{"name":"research_evidence"}}]', True),
        ("[]", False), ('[{"method":"ping"},null]', True), ("{broken", True), ("null", True), (None, True), ('{"method":5}', True), ('"ping"', True),
    ],
    "body string", lambda b: wire.needs_payment(b, wire.PAID_EVIDENCE), "BOOLEAN",
)
cases(
    "response_failures",
    [
        ('{"result":{"isError":true}}', "application/json", True), ('{"result":{"isError":false}}', "application/json", False), ('{"result":{"isError":"true"}}', "application/json", False), ('{"error":{"code":1}}', None, True), ('{"error":null,"result":{}}', "application/json", False),
        ('[{"result":{}},{"error":{"code":1}}]', "application/json", True), ('event: message\ndata: {"result":{"isError":true}}\n', "text/event-stream", True), ('data: {"result":{}}\ndata: {"result":{}}', "text/event-stream", False), ('broken "isError" : true', "text/plain", True), ("broken", "text/plain", False), ("", "text/plain", False), (None, None, False),
    ],
    "body string, ct string", wire.response_failed, "BOOLEAN",
)
cases("header_json", [("eyJhIjoxfQ==", '{"a":1}'), ("bm90IGpzb24=", None), ("%%%", None), (None, None)], "h string", wire.decode_header)
cases(
    "redactions",
    [('{"api_key":"x","a":{"Password":1,"b":[{"token":2},3]}}', '{"api_key":"[redacted]","a":{"Password":"[redacted]","b":[{"token":"[redacted]"},3]}}'), ('{"a":{"a":{"a":{"a":{"a":{"a":{"a":1}}}}}}}', '{"a":{"a":{"a":{"a":{"a":{"a":{"a":"[depth-limit]"}}}}}}}'), ("[1,2]", "[1,2]"), ("broken", None), (None, None)],
    "t string", lambda t: wire.redact(t),
)
cases("content_lengths", [("12", 12), ("0", 0), ("-1", None), ("1.5", None), ("", None), ("9007199254740991", 9007199254740991), ("9007199254740992", None), (None, None)], "h string", wire.content_length, "BIGINT")
cases("encoding_tokens", [("gzip", "gzip"), (" GZIP , identity,, br", "gzip,br"), ("", ""), (None, "")], "h string", lambda h: F.array_join(wire.content_encodings(h), ","))
cases("agent_prefixes", [("curl/8", "curl/8"), ("a\x01b\x7f", "ab"), ("x" * 70, "x" * 60), ("", None), (None, None)], "ua string", wire.agent_prefix)
cases("client_keys", [(" 1.1.1.1 ", "2.2.2.2", "3.3.3.3", "1.1.1.1"), ("", "2.2.2.2, 4.4.4.4", "3.3.3.3", "2.2.2.2"), (None, " ,x", "3.3.3.3", "3.3.3.3"), (None, None, "3.3.3.3", "3.3.3.3")], "cf string, fwd string, ip string", wire.client_key)
cases("percents", [(1, 3, "33.3%"), (0, 5, "0.0%"), (5, 5, "100.0%"), (0, 0, "n/a")], "n long, d long", wire.percent)
cases("amounts_usd", [("10000", 0.01), ("2500000", 2.5), ("x", None), ("NaN", None), ("", 0.0), (None, None)], "a string", wire.amount_usd, "DOUBLE")
cases("wallet_amounts", [("0x1e8480", "2.000000"), ("0x0", "0.000000"), ("x", "0.000000"), (None, "0.000000")], "h string", lambda h: wire.wallet_usd(h).cast("string"))
cases("budgets", [(8.0, 10.0, 5.0, "2.0/3.0/true"), (12.0, 10.0, 5.0, "0.0/5.0/true"), (1.0, 10.0, 5.0, "9.0/-4.0/false")], "now double, base double, allowance double", lambda n, b, a: F.concat_ws("/", *[wire.budget(n, b, a)[k].cast("string") for k in ("spent", "remaining", "inside")]))
cases("coordinates", [(38.58157, "38.5816"), (-121.5, "-121.5000"), (0.0, "0.0000")], "x double", wire.fixed4)
cases("iso_times", [("2024-01-05", "2024-01-05T00:00:00.000Z"), ("2024-01-05T10:00:00+02:00", "2024-01-05T08:00:00.000Z"), ("soon", None), (None, None)], "t string", wire.to_iso)
cases(
    "error_envelopes",
    [("TIMEOUT", None, '504 {"error":{"code":"TIMEOUT","message":"The source did not respond within the allowed time.","request_id":"r"}}'), ("RATE_LIMIT", "wait", '429 {"error":{"code":"RATE_LIMIT","message":"wait","request_id":"r"}}')],
    "code string, message string", lambda c, m: F.concat_ws(" ", tables.error_envelope(c, F.lit("r"), m)["status"].cast("string"), tables.error_envelope(c, F.lit("r"), m)["body"]),
)
cases("own_rank", [('{"r":[{"n":"a"},{"n":"b"}]}', 2), ('{"r":[{"n":"a"}]}', None), ('{"r":[]}', None), ("broken", None)], "body string", lambda b: feeds.find_rank(b, "$.r", "n", "b"), "INTEGER")
cases("tool_lists", [('{"tools":[{"name":"b","outputSchema":{"type":"object"}},{"name":"a"}]}', "a,b|a"), ('{"tools":[]}', "|")], "body string", lambda b: F.concat_ws("|", tables.tool_list(b)["names"], F.array_join(tables.tool_list(b)["untyped"], ",")))
cases("manifest_fields", [('{"a":1,"b":"x"}', '{"a":1,"b":"y"}', "b"), ('{"a":1}', '{"a":1}', ""), ('{"a":1}', "{}", "a")], "m string, c string", lambda m, c: F.array_join(tables.manifest_differs(m, c, ["a", "b"]), ","))
cases("registry_names", [("b,a,b", "b,a"), (None, "none")], "n string", lambda n: tables.names_seen(F.coalesce(F.split(n, ","), F.array().cast("array<string>"))))
cases("checks_failed", [("required:1,required:0,optional:0", 1), ("optional:0", 0)], "c string", lambda c: tables.failed_checks(F.transform(F.split(c, ","), lambda x: F.struct(F.substring_index(x, ":", 1).alias("severity"), (F.substring_index(x, ":", -1) == "1").alias("passed")))), "INTEGER")
HOSTS = [("127.0.0.1", "numeric host loopback (127.0.0.0/8)"), ("2130706433", "numeric host loopback (127.0.0.0/8)"), ("0x7f.1", "numeric host loopback (127.0.0.0/8)"), ("0177.0.0.1", "numeric host loopback (127.0.0.0/8)"), ("10.1.2.3", "numeric host private (10.0.0.0/8)"), ("172.31.255.255", "numeric host private (172.16.0.0/12)"), ("172.32.0.1", None), ("192.168.1", "numeric host private (192.168.0.0/16)"), ("169.254.169.254", "numeric host link-local / cloud metadata (169.254.0.0/16)"), ("8.8.8.8", None), ("1.2.3.256", None), ("LOCALHOST.", "internal hostname (localhost)"), ("metadata.goog", "internal hostname (metadata.goog)"), ("a.internal", "internal hostname suffix (.internal)"), ("local", "internal hostname suffix (.local)"), ("example.com", None), ("", "empty hostname"), ("255.255.255.255", "numeric host reserved (240.0.0.0/4)")]
cases("hosts", HOSTS, "host string", urls.classify_host)
AGENTS = [("curl/8.1", "curl"), ("", "none"), ("Mozilla/5.0 (X11) AppleWebKit Chrome/120 Safari/537", "browser"), ("python-requests/2.31", "python"), ("Mozilla/5.0 (compatible; GPTBot/1.0)", "gptbot"), ("node", "node"), ("Go-http-client/2.0", "go"), ("something", "other"), ("mozilla googlebot/2.1", "googlebot")]
cases("agents", AGENTS, "agent string", classify.classify_client)
PRICES = [("$0.01", 10000, "$0.01"), ("0.003", 3000, "$0.003"), ("1", 1000000, "$1"), ("$10.50", 10500000, "$10.5"), ("0", None, None), ("-1", None, None), ("free", None, None), ("0.000001", 1, "$0.000001")]
cases("prices", [(p, a) for p, a, _ in PRICES], "price string", classify.price_atomic)
cases("price_texts", [(a, s) for _, a, s in PRICES], "atomic long", classify.price_string)
ROBOTS = [
    ("a", "User-agent: *\nDisallow: /private # no\nAllow: /private/open\n\nUser-agent: other\nDisallow: /"), ("b", "User-agent: VerisiftBot\nUser-agent: x\nDisallow:\nAllow: /a\nUser-agent: *\nDisallow: /"),
    ("c", "Disallow: /early\nUser-agent: verisift\r\nCrawl-delay: 3\r\nDisallow: /v\nSitemap: s\nUser-agent: veri\nDisallow: /w"), ("d", "User-agent: nobody\nDisallow: /"), ("e", ""), ("f", None), ("g", "User-agent:\nDisallow: /x\nuser-AGENT : *\nDISALLOW : /y:z"),
]


def plain(x):
    return "NaN" if x != x else x


@pytest.mark.parametrize("name", list(CASES))
def test_cases(spark, name):
    rows, schema, result = CASES[name]
    names = [x.split()[0] for x in schema.split(", ")]
    made = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], "case_no int, " + schema)
    got = {r["case_no"]: r["result"] for r in made.select("case_no", result(*[F.col(n) for n in names]).alias("result")).collect()}
    assert got == {i: r[-1] for i, r in enumerate(rows)}


def test_robots_bodies(spark):
    got = feeds.parse_robots(spark.createDataFrame(ROBOTS, "origin string, body string"), "VerisiftBot/1.0")
    assert sorted(map(tuple, got.collect())) == [("a", False, "/private"), ("a", True, "/private/open"), ("b", True, "/a"), ("c", False, "/v"), ("c", False, "/w"), ("g", False, "/y:z")]


def test_weather_texts(spark):
    alert = "struct<event:string,areaDesc:string,severity:string,description:string,instruction:string>"
    got = spark.sql("SELECT from_json('{\"event\":\"Flood\",\"severity\":\"Severe\",\"description\":\"d\"}', '" + alert[7:-1].replace(":", " ") + "') AS a").select(classify.format_alert(F.col("a")).alias("x")).first()["x"]
    assert got == "Event: Flood\nArea: Unknown\nSeverity: Severe\nDescription: d\nInstructions: No specific instructions provided\n---"
    period = "name string, temperature int, temperatureUnit string, windSpeed string, windDirection string, detailedForecast string"
    rows = spark.createDataFrame([(("Tonight", 41, "F", "5 mph", "N", "Clear."),), (("Monday", None, "F", "9 mph", "S", "Rain."),)], "p struct<" + period.replace(" ", ":").replace(",:", ",") + ">")
    assert [r[0] for r in rows.select(classify.format_period(F.col("p"))).collect()] == ["Tonight:\nTemperature: 41°F\nWind: 5 mph N\nClear.\n---", "Monday:\nTemperature: Unknown\nWind: 9 mph S\nRain.\n---"]
