"""Redirects through tables: chains, limits, loops, blocked hops; odd rows."""

from pyspark.sql import functions as F

from verisift.functions import urls
from verisift.operators import redirects


def test_resolve_url(spark):
    cases = [
        ("https://a.com/x/y?q=1#f", "z", "https://a.com/x/z"), ("https://a.com/x/y?q=1", "/z", "https://a.com/z"), ("https://a.com/x/y", "//b.com/w", "https://b.com/w"),
        ("https://a.com/x/y?q=1", "?r=2", "https://a.com/x/y?r=2"), ("https://a.com/x/y?q=1", "#top", "https://a.com/x/y?q=1"), ("https://a.com/x/y?q=1", "", "https://a.com/x/y?q=1"),
        ("https://a.com/x/y", "../../w", "https://a.com/w"), ("https://a.com", "HTTP://B.com:80", "http://b.com/"), ("https://a.com/x", "mailto:x", None), ("nonsense", "/x", None),
        ("https://a.com/x", "\\\\localhost\\s", "https://localhost/s"), ("https://a.com/x", None, None), (None, "/x", None),
    ]
    rows = spark.createDataFrame([(i, b, r) for i, (b, r, _) in enumerate(cases)], "i int, b string, r string")
    got = {r["i"]: r["u"] for r in rows.select("i", urls.resolve_url(F.col("b"), F.col("r")).alias("u")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_follow(spark):
    public = ["8.8.8.8"]
    responses = [
        ("https://a.com/", 200, None), ("https://a.com/1", 301, "/"), ("https://a.com/2", 302, "1#x"), ("https://a.com/loop", 302, "https://b.com/loop"), ("https://b.com/loop", 302, "https://a.com/loop"),
        ("https://a.com/in", 302, "http:\\\\127.0.0.1\\admin"), ("https://a.com/meta", 307, "//meta.internal/x"), ("https://a.com/rebind", 302, "https://c.com/"), ("https://a.com/bad", 302, "ftp://x/"),
        ("https://a.com/odd", 304, None), ("https://a.com/gone", 404, "/"), ("https://a.com/void", 302, "/nothing"),
        *[(f"https://a.com/n{i}", 302, f"/n{i + 1}") for i in range(7)], ("https://a.com/n7", 200, None), ("https://a.com/1", 500, "x"),
    ]
    hosts = spark.createDataFrame([("a.com", public), ("b.com", public), ("c.com", ["8.8.8.8", "10.1.1.1"])], "host string, addresses array<string>")
    asked = ["https://a.com/", "https://A.com/1#frag", "https://a.com/2", "https://a.com/loop", "https://a.com/in", "https://a.com/meta", "https://a.com/rebind", "https://a.com/bad", "https://a.com/odd", "https://a.com/gone", "https://a.com/void", "https://a.com/n0", "https://a.com/n2", "https://a.com/n3", "http://localhost/", "nonsense", None, "https://a.com/2"]
    rows = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(asked)], "i int, url string, at string")
    made = redirects.follow(rows, spark.createDataFrame(responses, "url string, status int, location string"), hosts)
    got = {r["i"]: r for r in made.collect()}
    assert len(got) == len(asked) and all(r["at"] == "kept" for r in got.values())
    ends = {i: (r["status"], r["code"], len(r["redirect_chain"]), r["loops"]) for i, r in got.items()}
    assert ends == {
        0: (200, None, 0, False), 1: (200, None, 1, False), 2: (200, None, 2, False), 3: (None, "REDIRECT_LIMIT", 5, True), 4: (None, "BLOCKED_URL", 0, False), 5: (None, "BLOCKED_URL", 0, False),
        6: (None, "BLOCKED_URL", 0, False), 7: (None, "UPSTREAM_HTTP_FAILURE", 0, False), 8: (304, None, 0, False), 9: (404, None, 0, False), 10: (None, "UPSTREAM_HTTP_FAILURE", 1, False),
        11: (None, "REDIRECT_LIMIT", 5, False), 12: (200, None, 5, False), 13: (200, None, 4, False), 14: (None, "BLOCKED_URL", 0, False), 15: (None, "INVALID_URL", 0, False), 16: (None, "INVALID_URL", 0, False), 17: (200, None, 2, False),
    }
    assert got[2]["redirect_chain"] == ["https://a.com/1", "https://a.com/"] and got[2]["final_url"] == "https://a.com/"
    assert got[4]["message"] == "redirect blocked: numeric host loopback (127.0.0.0/8)" and got[6]["message"] == "redirect blocked: resolved private (10.0.0.0/8)"
    assert got[14]["message"] == "internal hostname (localhost) (http://localhost/)" and got[3]["message"] == "exceeded the maximum of 5 redirects"
    none = redirects.follow(rows.limit(0), spark.createDataFrame([], "url string, status int, location string"), hosts)
    assert none.collect() == []
