"""robots.txt: rules as one structure against plain matching, bodies and agents, hot origins."""

import random
import re

from verisift.operators import robots
from verisift.sources import feeds


def plain(rules, path):
    hits = []
    for allow, rule in rules:
        ends = rule.endswith("$")
        pattern = ".*".join(map(re.escape, (rule[:-1] if ends else rule).split("*"))) + ("$" if ends else "")
        if rule and re.match(pattern, path, re.S):
            hits.append((len(rule), allow, rule))
    return max(hits)[1:] if hits else (True, None)


def test_structure_equals_plain_matching():
    rng = random.Random(4)
    for _ in range(300):
        rules = [(rng.random() < 0.5, "/" + "".join(rng.choice("ab*/$") for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(8))]
        rules = list(dict.fromkeys(rules))
        made = robots.Rules()
        for allow, rule in rules:
            made.add(allow, rule)
        made.close()
        for _ in range(30):
            path = "/" + "".join(rng.choice("ab/$") for _ in range(rng.randrange(7)))
            allow, rule = made.decide(path)
            want = plain(rules, path)
            assert allow == want[0] and (rule is None) == (want[1] is None) and len(rule or "") == len(want[1] or "")


def test_verdicts(spark):
    rules = [("a", False, "/"), ("a", True, "/open"), ("a", False, "/open/*.pdf$"), ("b", False, ""), (None, False, "/"), ("c", None, "/")]
    urls = [(1, "a", "/x"), (2, "a", "/open/y"), (3, "a", "/open/y.pdf"), (4, "a", "/open/y.pdf?z"), (5, "b", "/x"), (6, None, "/x"), (7, "a", None), (8, "c", "/x"), (1, "a", "/x"), (None, "a", "/q")]
    got = robots.verdicts(spark.createDataFrame(urls, "id int, origin string, path string"), spark.createDataFrame(rules, "origin string, allow boolean, path string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "/x", False, "/"), (2, "/open/y", True, "/open"), (3, "/open/y.pdf", False, "/open/*.pdf$"), (4, "/open/y.pdf?z", True, "/open"), (5, "/x", True, None), (6, "/x", True, None), (7, None, True, None), (8, "/x", True, None), (1, "/x", False, "/"), (None, "/q", False, "/")], key=repr)
    hot = spark.range(5000).selectExpr("id", "'a' AS origin", "concat('/open/', id, '.pdf') AS path")
    assert robots.verdicts(hot, spark.createDataFrame(rules, "origin string, allow boolean, path string")).filter("allowed").count() == 0


def test_bodies_and_agents(spark):
    long = "User-agent: *\nDisallow: /a\n" + "# filler\n" * 20_000 + "Disallow: /x\n"
    bodies = [("long", long), ("full", "User-agent: *\n" + "#" * (128 * 1024 - 30) + "\nDisallow: /x"), ("slash", "User-agent: bot/1\nDisallow: /v\nUser-agent: *\nDisallow: /star"), ("name", "User-agent: bo\nDisallow: /bo\nUser-agent: *\nDisallow: /star")]
    got = feeds.parse_robots(spark.createDataFrame(bodies, "origin string, body string"), "Bot/1.0 (x)")
    assert sorted(map(tuple, got.collect())) == [("full", False, "/x"), ("name", False, "/bo"), ("slash", False, "/star")]
