"""Text, URL, price and page functions on literal cases."""

from pyspark.sql import functions as F

from verisift.functions import classify, text, urls
from verisift.operators import evidence
from verisift.sources.html import extract, extract_documents


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col(F.col("x"))).first()[0]


def test_normalize_and_tokens(spark):
    assert one(spark, text.normalize_text, " a\t b\r\n\x00c  d ") == "a b c d"
    assert one(spark, text.normalize_lines, "a  b\r\n\r\n c ") == ["a b", "c"]
    assert one(spark, text.tokenize, "Don’t stop: 3 Éa-b") == ["don't", "stop", "3", "éa", "b"]
    assert one(spark, text.normalize_text, None) == "" and one(spark, text.tokenize, None) == []


def test_variants_and_truncate(spark):
    assert one(spark, text.variants, "industries") == ["industries", "industri", "industrie"]
    assert one(spark, lambda c: text.truncate(c, 10), "alpha beta gamma") == "alpha…"
    assert one(spark, lambda c: text.truncate(c, 4), "alphabet") == "alph…"
    assert one(spark, lambda c: text.truncate(c, 20), "alpha beta") == "alpha beta"


def test_negation(spark):
    for t in ("It is not so", "NO LONGER made", "they can’t", "A myth."):
        assert one(spark, text.has_negation_cue, t) is True
    for t in ("notable", "", "knot", "nowhere"):
        assert one(spark, text.has_negation_cue, t) is False


def test_cache_key(spark):
    cases = {
        "HTTP://User:pw@Example.com:80/a/?utm_source=x&b=2&a=1#f": "http://example.com/a?a=1&b=2",
        "https://example.com": "https://example.com/",
        "https://example.com:8443/x/?REF=1&fbclid=2": "https://example.com:8443/x",
        "ftp://example.com/": None,
        "nonsense": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.cache_key(F.col("u"))).collect()
    assert dict(map(tuple, got)) == cases


def test_prices_and_clients(spark):
    assert one(spark, classify.price_atomic, "$0.01") == 10000 and one(spark, classify.price_atomic, "x") is None
    assert one(spark, lambda c: classify.price_string(c.cast("bigint")), "10500000") == "$10.5"
    assert one(spark, classify.classify_client, "CURL/8") == "curl" and one(spark, classify.classify_client, None) == "none"


COMPANY = """<html lang=en><head><title>Rotamech</title><meta property="og:site_name" content="Rota"><script type="application/ld+json">{"@graph":[{"datePublished":"2024-03-01"}]}</script>
<link rel=canonical href="/c"></head><body><nav>menu</nav><header><h1>Top</h1></header><main><h2>Products</h2><p>Acme is a manufacturer of centrifugal pumps. It sells many.<p>The works make centrifugal pumps<div>loose</div>
<h2>Other</h2><ul><li>one<li>two</ul><a href="/x#y">l</a><a href="mailto:a">m</a></main><footer>f</footer></body></html>"""


def test_extract(spark):
    d = extract(COMPANY, "https://e.com/p")
    assert d["title"] == "Rotamech" and d["language"] == "en" and d["publisher"] == "Rota" and d["canonical_url"] == "https://e.com/c"
    assert d["main_text"].split("\n") == ["Products", "Acme is a manufacturer of centrifugal pumps. It sells many.", "The works make centrifugal pumps", "Other", "one", "two"]
    assert d["links"] == ["https://e.com/x"] and d["published_raw"] == ["2024-03-01"]
    assert extract(None, None)["word_count"] == 0
    rows = extract_documents(spark.createDataFrame([(1, "https://e.com/p", COMPANY), (2, None, None)], "page_id long, url string, html string"), ["page_id"]).orderBy("page_id").collect()
    assert rows[0]["published_at"].year == 2024 and rows[1]["main_text"] == ""


def test_rank_and_verdict(spark):
    pages = [(1, "https://a.com/", COMPANY), (2, "https://b.com/", "<body><main><p>Acme is not a manufacturer of centrifugal pumps.</main>"), (3, "https://c.com/", "<body><p>Rain.</body>")]
    docs = extract_documents(spark.createDataFrame(pages, "page_id long, url string, html string"), ["page_id", "url"])
    r = evidence.rank(docs, "Is Acme a manufacturer of centrifugal pumps?", headings="headings", text_col="main_text")
    rows = {x["page_id"]: x["candidates"] for x in r.select("page_id", "candidates").collect()}
    assert rows[1][0]["relevance"] == "direct" and rows[1][0]["context"] == "h2:Products > p[1]" and rows[1][1]["relevance"] == "context"
    assert rows[2][0]["relevance"] == "contradictory" and rows[3] == []
    s = r.select(F.lit("q").alias("q"), "page_id", urls.host_of(F.col("url")).alias("host"), F.col("page_id").alias("pos"), evidence.stance(F.col("candidates")).alias("stance"))
    v = evidence.assess(s, 0, "q").first()
    assert v["status"] == "mixed" and "a.com" in v["basis"]
    assert evidence.assess(s.filter("pos = 1"), 2, "q").first()["status"] == "inconclusive"
    assert evidence.assess(s.filter("pos = 1"), 0, "q").first()["status"] == "supported"


def test_worked_example(spark):
    text_ = "What we make\nRotamech Industries is a manufacturer of centrifugal pumps. Our pumps run.\nMore centrifugal pumps\nCentrifugal pumps here. Centrifugal alone."
    r = evidence.rank(spark.createDataFrame([(text_,)], "text string"), "Is Rotamech Industries a manufacturer of centrifugal pumps?")
    best = r.first()["candidates"][0]
    assert best["coverage"] == 1.0 and best["relevance"] == "direct" and best["rank"] == 1


def test_backslashes_hide_no_host(spark):
    cases = ["http://localhost\\x/", "http://127.0.0.1\\x/", "http:\\\\localhost\\x", "HTTP:/\\0x7f.1\\x", "http://user\\@localhost/", "http://１２７.0.0.1/", "https://e.com\\a?b=\\c"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, u string")
    got = rows.select("i", urls.validate_url(F.col("u"), F.array(F.lit("8.8.8.8"))).alias("v"), urls.host_of(F.col("u")).alias("h"), urls.safe_url(F.col("u")).alias("s"), urls.cache_key(F.col("u")).alias("k")).orderBy("i").collect()
    assert [r["v"] and r["v"]["code"] for r in got] == ["BLOCKED_URL", "BLOCKED_URL", "BLOCKED_URL", "BLOCKED_URL", None, "INVALID_URL", None]
    assert got[0]["h"] == "localhost" and got[4]["h"] == "user" and got[6]["s"] == "https://e.com/a" and got[6]["k"] == "https://e.com/a?b=%5Cc"


def test_plain_canonical_urls_equal_others(spark):
    """The compiled way of cache_key gives what the full one gives."""
    tails = ["", "/", "/x", "/x/", "/x//", "//", "/x?page=2&ref=x", "/x?utm_a=1&b=2&utm_c=3", "/x?b", "/x?b&c", "/x?=", "/x?a=b=c", "/x?&&a=1&&", "/x?#f", "/x#f?g=1", "/.x", "/x/../y", "/%2e%2e/y", "/x?refer=1&REF=2", "/x?a=%41", "/x?a=1+2", "/x y", "/x?gclid", "/?q=1&gclid=", "/x/?utm_=1", "/x?a=1&b=2", "/a.b/c..d", "/x\n", "/x?xutm_a=1", "/x?a=1&ref", "/x?-=1", "/x?ref=1&ref=2&c=3", "/x?c=3&ref&d"]
    cases = [h + t for h in ("https://a.com", "http://b-c.x1.org", "https://a.0x1f", "https://1.2", "https://A.com", "https://a.com.", "https://a.com:443") for t in tails]
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    assert rows.select("u", urls.cache_key(F.col("u")).alias("a"), urls._any_cache_key(F.col("u")).alias("b")).filter("NOT a <=> b").collect() == []


def test_matches_beyond_ascii_in_any_case(spark):
    rows = spark.createDataFrame([(1, "Die öffnung heute."), (2, "Öffnung heute um neun."), (3, "ÖFFNUNG!"), (4, "Nichts davon."), (5, "İSTANBUL")], "i int, text string")
    assert [r["i"] for r in evidence.candidates(evidence.rank(rows, "Öffnung"), "i").orderBy("i").collect()] == [1, 2, 3]
    assert [r["i"] for r in evidence.candidates(evidence.rank(rows, "İstanbul"), "i").collect()] == [5]


def test_dates(spark):
    from verisift.sources.html import _first_date

    cases = [(["Tue, 05 Mar 2024 10:00:00 GMT"], "2024-03-05 10:00:00"), (["5 Mar 2024 10:00:00 +0200"], "2024-03-05 08:00:00"), (["soon", "March 5, 2024"], "2024-03-05 00:00:00"), (["2024-03-05T10:00Z"], "2024-03-05 10:00:00"), (["2024-03-05T10:00:00.5+01:00", "2020-01-01"], "2024-03-05 09:00:00"), (["2024-03-05T10:00+0100"], "2024-03-05 09:00:00"), (["0001-01-01", "2024-03-05"], "2024-03-05 00:00:00"), (["99"], None), ([], None)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, raw array<string>")
    got = {r["i"]: r["t"] and str(r["t"]) for r in rows.select("i", F.date_format(_first_date(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}


def test_percentiles_beside_an_outlier(spark):
    from verisift.operators import tables

    rows = spark.range(20_001).select((F.col("id") % 2).alias("k"), F.when(F.col("id") == 20_000, 1e15).when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 10).alias("v"))
    got = {r["k"]: tuple(r)[1:] for r in tables.usage_percentiles(rows, "k", "v").collect()}
    for k in (0, 1):
        held = sorted(r["v"] for r in rows.filter(f"k = {k}").collect())
        assert got[k] == (len(held), *[held[min(len(held) - 1, int(len(held) * q))] for q in (0.5, 0.95, 0.99)])


def test_ipv6_hosts_and_paths_in_canonical_urls(spark):
    cases = {
        "http://[2001:DB8:0:0:0:0:0:1]/": "http://[2001:db8::1]/", "http://[0:0:0:0:0:0:0:0]/x": "http://[::]/x", "http://[1:0:0:2:0:0:0:3]/": "http://[1:0:0:2::3]/", "http://[1:0:0:2:0:0:3:4]/": "http://[1::2:0:0:3:4]/",
        "http://[::ffff:127.0.0.1]/": "http://[::ffff:7f00:1]/", "http://[1:2:3:4:5:6:0:8]/": "http://[1:2:3:4:5:6:0:8]/", "http://[1:2:3]/": None, "http://[g::]/": None, "http://[::1.2.3]/": None, "http://[fe80:0:0:0::]:81/": "http://[fe80::]:81/",
        "https://e.com/é x/日\"<>`{}": "https://e.com/%C3%A9%20x/%E6%97%A5%22%3C%3E%60%7B%7D", "https://e.com/%41|^~😀": "https://e.com/%41|^~%F0%9F%98%80",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    assert dict(map(tuple, rows.select("u", urls.cache_key(F.col("u"))).collect())) == cases
    v = spark.createDataFrame([("http://[::ffff:127.0.0.1]/",), ("http://[::FFFF:a9fe:a9fe]/",)], "u string").select(urls.validate_url(F.col("u"), F.array())["reason"]).collect()
    assert [r[0] for r in v] == ["IPv4-mapped loopback (127.0.0.0/8)", "IPv4-mapped link-local / cloud metadata (169.254.0.0/16)"]
