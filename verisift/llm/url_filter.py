"""URL filters: host and path rules, and gradient-boosted trees on lexical features of the URL.

Only DataFrame functions touch the rows. Features are binned into small integers; training rows are summed up by
their bins, so the booster sees a bounded table of (bins, rows, positives), and the trees come back as one CASE
expression. The suffix of a host counts through its smoothed share of blocked training URLs, in a fixed number of
hashed buckets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import let

#: (host, path, verdict). A rule fits its host and all subdomains if the path starts with the rule's.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Labelled URLs the trees are fitted on, at most (about: drawn by a hash of the URL).
FIT_URLS = 50_000
SUFFIX_BUCKETS, BINS, TREES, DEPTH, RATE = 256, 8, 24, 3, 0.3


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    low = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return low(host), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; both null if none fits. Longest: of host and path together."""
    text = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return text if text is not None else F.lit(None).cast("string"), verdict if verdict is not None else F.lit(None).cast("string")


def _entropy(x: Column) -> Column:
    """Bits per character of the characters' distribution (0 for an empty text)."""

    def of(chars: Column) -> Column:
        share = lambda c: (F.size(chars) - F.size(F.array_remove(chars, c))) / F.size(chars)
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))

    return let(F.array_remove(F.split(x, ""), ""), of)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features, each binned to 0 .. BINS - 1. A null URL has those of the empty one."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    n = F.greatest(F.length(u), F.lit(1))
    cut = lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(BINS - 1)).cast("int")
    return {
        "length": cut(F.length(u) / 16),
        "host_length": cut(F.length(host) / 6),
        "depth": cut(F.size(F.array_remove(F.split(path, "/"), ""))),
        "labels": cut(F.size(F.split(host, r"\."))),
        "digits": cut(F.length(F.regexp_replace(u, "[^0-9]", "")) / n * 16),
        "entropy": cut(_entropy(host) * 2 - 3),
        "params": cut(F.when(query == "", 0).otherwise(F.size(F.split(query, "&")))),
        "hyphens": cut(F.length(F.regexp_replace(host, "[^-]", ""))),
    }


def suffix_bucket(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)), F.lit(SUFFIX_BUCKETS)).cast("int")


@dataclass
class Booster:
    base: float
    trees: list[dict]
    suffix_rank: dict[int, int]  # suffix bucket -> bin; others get the middle

    def margin(self) -> Column:
        """Log-odds of `block` from the columns named like the features and suffix."""

        def branch(t: dict) -> Column:
            if "value" in t:
                return F.lit(t["value"])
            return F.when(F.col(t["name"]) <= t["at"], branch(t["left"])).otherwise(branch(t["right"]))

        out = F.lit(self.base)
        for t in self.trees:
            out = out + branch(t)
        return out


def _grow(rows: list[dict], names: list[str], depth: int) -> dict:
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    leaf = {"value": RATE * g / (h + 1.0)}
    if depth == 0:
        return leaf
    best = (1e-3, None)
    for name in names:
        gs, hs = [0.0] * BINS, [0.0] * BINS
        for r in rows:
            gs[r[name]] += r["g"]
            hs[r[name]] += r["h"]
        gl = hl = 0.0
        for at in range(BINS - 1):
            gl, hl = gl + gs[at], hl + hs[at]
            if hl < 1 or h - hl < 1:
                continue
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, (name, at))
    if best[1] is None:
        return leaf
    name, at = best[1]
    return {"name": name, "at": at, "left": _grow([r for r in rows if r[name] <= at], names, depth - 1), "right": _grow([r for r in rows if r[name] > at], names, depth - 1)}


def fit(labelled: DataFrame, limit: int = FIT_URLS) -> Booster:
    """Fit on labelled URLs: columns url and bad (boolean or 0/1; null rows are left out). At most about `limit` rows,
    drawn by a hash of the URL, are summed up. Without rows of both kinds the model is a constant."""
    rows = labelled.filter(F.col("bad").isNotNull()).select("url", F.col("bad").cast("int").alias("bad"))
    total = rows.count()
    rows = rows.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_003)) <= F.lit(min(1.0, limit / max(total, 1)) * 1_000_003))
    host, path = split_url(F.col("url"))
    rows = rows.select("url", "bad", host.alias("host"), path.alias("path"))
    cols = features(F.col("url"), F.col("host"), F.col("path"))
    binned = rows.select("bad", suffix_bucket(F.col("host")).alias("bucket"), *[c.alias(k) for k, c in cols.items()])
    table = [r.asDict() for r in binned.groupBy("bucket", *cols).agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).collect()]
    n, bad = sum(r["n"] for r in table), sum(r["bad"] for r in table)
    rate = (bad + 0.5) / (n + 1)
    if not 0 < bad < n:
        return Booster(math.log(rate / (1 - rate)), [], {})
    seen: dict[int, list[int]] = {}
    for r in table:
        s = seen.setdefault(r["bucket"], [0, 0])
        s[0] += r["n"]
        s[1] += r["bad"]
    share = {k: (b + 20 * rate) / (m + 20) for k, (m, b) in seen.items()}
    rank = {k: min(BINS - 1, int(v * BINS)) for k, v in share.items()}
    for r in table:
        r["suffix"], r["margin"] = rank[r["bucket"]], math.log(rate / (1 - rate))
    names, trees = [*cols, "suffix"], []

    def value(t: dict, r: dict) -> float:
        while "value" not in t:
            t = t["left"] if r[t["name"]] <= t["at"] else t["right"]
        return t["value"]

    for _ in range(TREES):
        for r in table:
            p = 1 / (1 + math.exp(-r["margin"]))
            r["g"], r["h"] = r["bad"] - r["n"] * p, r["n"] * p * (1 - p)
        trees.append(_grow(table, names, DEPTH))
        for r in table:
            r["margin"] += value(trees[-1], r)
    return Booster(math.log(rate / (1 - rate)), trees, rank)


def judge(pages: DataFrame, model: Booster, keep: list[str], rules=RULES, url_col: str = "url") -> DataFrame:
    """`keep` columns with host, path, rule, verdict and score (the model's probability of block) for every row.

    A null URL has empty host and path and meets no rule; the model judges it like an empty one. Rows aren't joined:
    ties, repeated rows and null ids stay as they are; an empty table gives none."""
    url = F.col("__url")
    host, path = split_url(url)
    rows = pages.select(*[pages[c] for c in keep], pages[url_col].cast("string").alias("__url")).withColumns({"host": host, "path": path})
    bins = features(url, F.col("host"), F.col("path"))
    suffix = F.coalesce(F.create_map(*[F.lit(x) for kv in model.suffix_rank.items() for x in kv])[suffix_bucket(F.col("host"))], F.lit(BINS // 2)) if model.suffix_rank else F.lit(BINS // 2)
    rows = rows.withColumns({**bins, "suffix": suffix})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-model.margin()))
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "score": score})
    return rows.select(*keep, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def label_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """URLs that a rule decides, as labelled rows: url, bad."""
    host, path = split_url(F.col("url"))
    verdict = rule_for(host, path, rules)[1]
    return pages.select("url", (verdict == "block").alias("bad"))
