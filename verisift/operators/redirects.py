"""Requests followed through a table of responses: every hop validated, chains bounded.

No network: responses (url, status, location) and resolved addresses (host, addresses) are tables that a fetcher has left.
Responses become edges, each target resolved and validated once. Following is a fixpoint over the distinct URLs asked for:
each round joins the URLs still under way with the edges and writes what has ended and what goes on, so that a lost
executor costs one round; there is one more round than redirects are allowed. Requests meet the outcome of their URL at
the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions import urls as U
from verisift.functions.common import written

#: Fixed values.
MOST_REDIRECTS = 5
LIMIT_MESSAGE = "exceeded the maximum of %d redirects"
BAD_TARGET, NO_RESPONSE = "redirect target was not a valid URL", "no response was recorded for this URL"


def with_addresses(rows: DataFrame, hosts: DataFrame, url: str, into: str = "addresses") -> DataFrame:
    """rows with the addresses that the host of a URL column resolved to (hosts: host, addresses; one row a host), or null."""
    known = hosts.select(F.lower("host").alias("__host"), F.col("addresses").alias(into))
    return rows.withColumn("__host", U.host_of(F.col(url))).join(known, "__host", "left").drop("__host")


def _validated(rows: DataFrame, hosts: DataFrame, url: str, into: str) -> DataFrame:
    """rows with why a URL must not be fetched (code, reason), or null."""
    return with_addresses(rows, hosts, url, "__addresses").withColumn(into, U.validate_url(F.col(url), F.col("__addresses"))).drop("__addresses")


def _failure(code: Column | str, message: Column | str) -> Column:
    as_text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_text(code).alias("code"), as_text(message).alias("message"))


def _edges(responses: DataFrame, hosts: DataFrame) -> DataFrame:
    """at, status, moved (it is a redirect), next (its target, null if it can't be read) and bad (why that must not be fetched)
    of each URL with a response: targets are resolved and validated once, however often they are met."""
    known = responses.select(U.write_url(F.col("url")).alias("at"), F.struct("status", "location").alias("r")).filter("at IS NOT NULL").groupBy("at").agg(F.min("r").alias("r"))
    moved = F.coalesce(F.col("r.status").between(300, 399) & (F.col("r.location") != ""), F.lit(False))
    known = known.select("at", F.col("r.status").alias("status"), moved.alias("moved"), F.when(moved, U.resolve_url(F.col("at"), F.col("r.location"))).alias("next"))
    return _validated(known, hosts, "next", "bad").withColumn("bad", F.when(F.col("next").isNotNull(), F.col("bad")))


def follow(asked: DataFrame, responses: DataFrame, hosts: DataFrame, most: int = MOST_REDIRECTS, url: str = "url") -> DataFrame:
    """asked with final_url, status, redirect_chain, code, message and loops.

    A URL ends with the response that is no redirect (a 3xx status without a location is none), or with a code: INVALID_URL
    or BLOCKED_URL if it, or a hop, must not be fetched (a hop's message begins with `redirect blocked`), REDIRECT_LIMIT
    beyond `most` redirects, UPSTREAM_HTTP_FAILURE if a target can't be read or nothing was recorded for a URL. `loops`
    tells that a target was met before. Of several responses of a URL the one with the smallest status, then location,
    counts; URLs are compared as U.write_url() has them, so fragments don't matter. A null URL is INVALID_URL."""
    start = _validated(asked.select(F.col(url).alias("__url")).distinct(), hosts, "__url", "bad")
    refused = F.when(F.col("bad").isNotNull(), _failure(F.col("bad.code"), F.concat(F.col("bad.reason"), F.lit(" ("), U.safe_url(F.col("__url")), F.lit(")"))))
    start = written(start.select("__url", U.write_url(F.col("__url")).alias("first"), refused.alias("failure")), "hops")
    edges = written(_edges(responses, hosts), "hops")
    none = lambda kind: F.lit(None).cast(kind)
    done = [start.filter("failure IS NOT NULL").select("__url", F.array().cast("array<string>").alias("chain"), F.lit(False).alias("loops"), "failure", none("int").alias("status"), none("string").alias("final"))]
    active = start.filter("failure IS NULL").select("__url", "first", F.col("first").alias("at"), F.array().cast("array<string>").alias("chain"), F.lit(False).alias("loops"))
    for hop in range(most + 1):
        met = active.join(edges, "at", "left")
        failure = F.when(F.col("moved").isNull(), _failure("UPSTREAM_HTTP_FAILURE", NO_RESPONSE))
        if hop < most:
            failure = failure.when(F.col("moved") & F.col("next").isNull(), _failure("UPSTREAM_HTTP_FAILURE", BAD_TARGET))
            failure = failure.when(F.col("bad").isNotNull(), _failure(F.col("bad.code"), F.concat(F.lit("redirect blocked: "), F.col("bad.reason"))))
        else:
            failure = failure.when(F.col("moved"), _failure("REDIRECT_LIMIT", LIMIT_MESSAGE % most))
        again = F.col("loops") | F.coalesce((F.col("next") == F.col("first")) | F.array_contains("chain", F.col("next")), F.lit(False))
        met = written(met.select("__url", "first", "at", "chain", again.alias("loops"), failure.alias("failure"), "status", "moved", "next"), "hops")
        good = F.col("failure").isNull()
        done.append(met.filter(~good | ~F.col("moved")).select("__url", "chain", "loops", "failure", F.when(good, F.col("status")).alias("status"), F.when(good, F.col("at")).alias("final")))
        active = met.filter(good & F.col("moved")).select("__url", "first", F.col("next").alias("at"), F.concat("chain", F.array("next")).alias("chain"), "loops")
    found = done[0]
    for rows in done[1:]:
        found = found.unionByName(rows)
    rows = asked.join(found.withColumnRenamed("__url", "__asked"), F.col(url).eqNullSafe(F.col("__asked")), "left").drop("__asked")
    named = {"final": "final_url", "chain": "redirect_chain"}
    columns = [F.col(c) for c in asked.columns]
    return rows.select(*columns, *[F.col(c).alias(named.get(c, c)) for c in ("final", "status", "chain", "loops")], F.col("failure.code").alias("code"), F.col("failure.message").alias("message"))
