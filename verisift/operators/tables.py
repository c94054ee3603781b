"""Keyed tables, usage reports, admission control, catalogue demand, payers and listing checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions import wire as W
from verisift.functions.common import written

# Fixed values.
PRICE_BANDS = [("<$0.003", None, 0.003), ("$0.003-0.01", 0.003, 0.01), ("$0.01-0.03", 0.01, 0.03), ("$0.03-0.10", 0.03, 0.1), (">=$0.10", 0.1, None)]
HTTP_STATUS = {
    "INVALID_REQUEST": 400, "INVALID_URL": 400, "BLOCKED_URL": 400, "SSRF_ATTEMPT": 400, "TIMEOUT": 504, "REDIRECT_LIMIT": 502,
    "UNSUPPORTED_CONTENT": 415, "RESPONSE_TOO_LARGE": 502, "UPSTREAM_HTTP_FAILURE": 502, "PREVIEW_LIMIT": 429,
    "NO_SOURCES_RETRIEVED": 502, "EXTRACTION_FAILURE": 500, "PAYMENT_REQUIRED": 402, "PAYMENT_INVALID": 402, "PAYMENT_EXPIRED": 402,
    "RATE_LIMIT": 429, "INTERNAL_ERROR": 500, "NOT_FOUND": 404, "UNAUTHORIZED": 401, "BACKEND_UNREACHABLE": 502, "NOT_CONFIGURED": 503,
}
ERROR_MESSAGES = {
    "INVALID_REQUEST": "The request body is invalid or missing required fields.",
    "INVALID_URL": "The supplied URL is invalid or unsupported.",
    "BLOCKED_URL": "The supplied URL resolves to a destination that is not allowed.",
    "SSRF_ATTEMPT": "The supplied URL is not permitted.",
    "TIMEOUT": "The source did not respond within the allowed time.",
    "REDIRECT_LIMIT": "The source exceeded the maximum number of redirects.",
    "UNSUPPORTED_CONTENT": "The source returned a content type that is not supported.",
    "RESPONSE_TOO_LARGE": "The source response exceeded the maximum allowed size.",
    "UPSTREAM_HTTP_FAILURE": "The source returned an error status.",
    "PREVIEW_LIMIT": "The free preview has reached its daily limit.",
    "NO_SOURCES_RETRIEVED": "None of the requested sources could be retrieved, so no evidence was produced and no payment was taken.",
    "EXTRACTION_FAILURE": "The source could not be processed.",
    "PAYMENT_REQUIRED": "Payment is required to access this resource.",
    "PAYMENT_INVALID": "The supplied payment could not be verified.",
    "PAYMENT_EXPIRED": "The supplied payment has expired.",
    "RATE_LIMIT": "Too many requests. Please retry shortly.",
    "INTERNAL_ERROR": "An internal error occurred.",
    "NOT_FOUND": "No such endpoint.",
    "UNAUTHORIZED": "Authentication is required.",
    "BACKEND_UNREACHABLE": "The evidence service is temporarily unavailable.",
    "NOT_CONFIGURED": "The service is not fully configured.",
}


def error_envelope(code: Column, request_id: Column, message: Column | None = None) -> Column:
    """Status and JSON body of an error code; the code's own message unless another is given."""
    status = F.create_map(*[x for k, v in HTTP_STATUS.items() for x in (F.lit(k), F.lit(v))])
    usual = F.create_map(*[x for k, v in ERROR_MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    said = F.coalesce(message, usual[code]) if message is not None else usual[code]
    return F.struct(status[code].alias("status"), F.to_json(F.struct(F.struct(code.alias("code"), said.alias("message"), request_id.alias("request_id")).alias("error"))).alias("body"))


# --- keyed table with a time to live --------------------------------------------------------------------------


def cache_upsert(writes: DataFrame, key: str = "key", at: str = "stored_at", tie: str = "seq") -> DataFrame:
    """Latest row of each key: one aggregate by key, so hot keys are combined before the shuffle."""
    rest = [c for c in writes.columns if c != key]
    latest = writes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r"))
    return latest.select(key, "r.*")


def cache_point_read(wanted: DataFrame, table: DataFrame, now: Column, key: str = "key") -> DataFrame:
    """wanted (key) with the live row of each key, if there is one, and hit: a left join by key."""
    live = cache_live(table, now).withColumn("hit", F.lit(True))
    return wanted.join(live, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_delete(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The table without the rows of some keys; a key that isn't there changes nothing."""
    return table.join(keys.select(key), key, "left_anti")


def cache_live(table: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return table.filter(F.col(expires) > now)


def cache_retain(table: DataFrame, n: int, at: str = "stored_at", key: str = "key") -> DataFrame:
    """The n newest rows (then the larger key): a top-n, never a full sort."""
    return table.orderBy(F.col(at).desc(), F.col(key).desc()).limit(n)


def cache_stats(table: DataFrame, now: Column) -> DataFrame:
    live = F.col("expires_at") > now
    return table.agg(F.count_if(live).alias("live"), F.count_if(~live).alias("expired"), F.min("stored_at").alias("oldest"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


# --- usage ----------------------------------------------------------------------------------------------------


def usage_by_surface(events: DataFrame, surface: str, client: str, error: Column) -> DataFrame:
    return events.groupBy(F.col(surface).alias("surface")).agg(F.count("*").alias("calls"), F.count_distinct(client).alias("clients"), F.count_if(error).alias("errors"))


def usage_percentiles(events: DataFrame, key: str, value: str, quantiles=(0.5, 0.95, 0.99), buckets: int = 64) -> DataFrame:
    """Exact latency quantiles by position. Values are counted, then dealt into buckets that hold about as many distinct values
    each, whatever the values are (an outlier moves no bound); only the buckets that hold a quantile are looked into, by a
    window over their distinct values. The bounds are approximate and differ from one run to another, so they are written
    once (a row a key): worked out twice in one plan, the places in a bucket would not be those of its values."""
    counts = events.groupBy(key, value).agg(F.count("*").alias("c"))
    marks = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    span = counts.groupBy(key).agg(F.array_distinct(F.percentile_approx(value, marks, buckets * 20)).alias("bounds"), F.sum("c").alias("n"))
    counts = counts.join(written(span, "bounds"), key).withColumn("bucket", F.array_position(F.sort_array(F.array_append("bounds", F.col(value))), F.col(value))).drop("bounds")
    want = F.array(*[F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q))).cast("long") for q in quantiles])
    sums = counts.groupBy(key, "bucket", "n").agg(F.sum("c").alias("c"))  # at most `buckets` rows for each key
    sums = sums.withColumn("upto", F.sum("c").over(Window.partitionBy(key).orderBy("bucket"))).withColumn("below", F.col("upto") - F.col("c"))
    held = sums.withColumn("at", F.filter(F.transform(want, lambda p, i: F.struct(i.alias("i"), (p - F.col("below")).alias("p"))), lambda x: (x["p"] >= 0) & (x["p"] < F.col("c")))).filter(F.size("at") > 0)
    inside = counts.drop("n").join(held.select(key, "bucket", "at", "n"), [key, "bucket"])
    inside = inside.withColumn("upto", F.sum("c").over(Window.partitionBy(key, "bucket").orderBy(value)))
    found = inside.select(key, value, "n", "c", "upto", F.explode("at").alias("x")).filter((F.col("x.p") < F.col("upto")) & (F.col("x.p") >= F.col("upto") - F.col("c")))
    return found.groupBy(key).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("x.i") == i, F.col(value))).alias(f"p{int(q * 100)}") for i, q in enumerate(quantiles)])


def preview_quota(calls: DataFrame, per_client: int, overall: int, client: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Calls with day, nth and allowed: at most per_client for each client and day, and overall for each day.

    Of a day only its first `overall` calls within the clients' quotas are gathered, by a limited window; they are matched by
    client and place, so that repeated ids count as calls of their own."""
    day = F.date_trunc("day", F.col(at)).alias("day")
    order = [F.col(at), F.col(tie)]
    rows = calls.select("*", day).withColumn("nth", F.row_number().over(Window.partitionBy("day", client).orderBy(*order)))
    first = rows.filter(F.col("nth") <= per_client).select("day", F.col(client).alias("who"), F.col("nth").alias("place"), *order).withColumn("nth_all", F.row_number().over(Window.partitionBy("day").orderBy(*order)))
    first = first.filter(F.col("nth_all") <= overall).select(F.col("day").alias("__day"), "who", "place")
    one = (F.col("day") == F.col("__day")) & F.col(client).eqNullSafe(F.col("who")) & (F.col("nth") == F.col("place"))
    return rows.join(first, one, "left").select(*rows.columns, F.col("place").isNotNull().alias("allowed"))


def valid_quota(calls: DataFrame, valid: Column, overall: int, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The calls that are served: of each UTC day the first `overall` valid ones (others use nothing up)."""
    rows = calls.filter(valid).withColumn("day", F.date_trunc("day", F.col(at)))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("day").orderBy(at, tie))).filter(F.col("nth") <= overall)


def token_bucket(calls: DataFrame, per_minute: float, burst: float, key: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """tie column, key, allowed, tokens left and seconds to wait: a bucket of per_minute + burst tokens, refilled all the time,
    one a call. per_minute of 0 or less, or not finite, lets all calls pass (left is null).

    The refill is clamped, so it is a fold over a key's calls in time order. Calls are dealt out and sorted by key, and the
    fold runs over them as they stream by, holding one number of tokens at a time, however many calls a key has."""
    names = calls.select(tie, key)
    shape = T.StructType([*names.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("left", T.DoubleType()), T.StructField("retry_seconds", T.LongType())])
    if not 0 < per_minute < math.inf:
        return names.select(tie, key, F.lit(True).alias("allowed"), F.lit(None).cast("double").alias("left"), F.lit(0).cast("long").alias("retry_seconds"))
    full, rate = float(per_minute + burst), per_minute / 60.0

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, left, last = object(), full, 0.0
        for batch in batches:
            allowed, tokens, wait = [], [], []
            for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != who:
                    who, left = k, full
                else:
                    left = min(full, left + max(0.0, t - last) * rate)
                last = t
                allowed.append(left >= 1)
                wait.append(0 if left >= 1 else max(1, math.ceil((1 - left) / rate)))
                left -= left >= 1
                tokens.append(round(left, 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_()), pa.array(tokens, pa.float64()), pa.array(wait, pa.int64())], names=[tie, key, "allowed", "left", "retry_seconds"])

    rows = calls.select(tie, key, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"))
    return rows.repartition(key).sortWithinPartitions(key, "t", tie).mapInArrow(fold, shape)


def usage_report(events: DataFrame) -> DataFrame:
    """surface, calls, previews, paid and failed of usage rows (tool, preview, payment_provided, outcome): free calls by tool or
    as `preview (rest)`, others by tool or as `http paid route`. A null outcome counts as failed."""
    free = F.coalesce("preview", F.lit(False)) | (F.coalesce("tool", F.lit("")) == "preview_evidence")
    tool = F.when(F.col("tool") != "", F.col("tool"))
    surface = F.when(free, F.coalesce(tool, F.lit("preview (rest)"))).otherwise(F.coalesce(tool, F.lit("http paid route")))
    return events.groupBy(surface.alias("surface")).agg(F.count("*").alias("calls"), F.count_if(free).alias("previews"), F.count_if(F.coalesce("payment_provided", F.lit(False))).alias("paid"), F.count_if(F.coalesce("outcome", F.lit("")) != "ok").alias("failed")).orderBy(F.col("calls").desc(), "surface")


def status_histogram(rows: DataFrame, status: str = "status") -> DataFrame:
    """n of each status, and whether it is a server error, no connection (0) or a success."""
    s = F.col(status)
    return rows.groupBy(s.alias("status")).agg(F.count("*").alias("n")).withColumn("kind", F.when(F.col("status") >= 500, "5xx").when(F.col("status") == 0, "connection").when(F.col("status") == 200, "ok").otherwise("other"))


# --- catalogue and payers -------------------------------------------------------------------------------------


def by_category(items: DataFrame) -> DataFrame:
    calls, payers = F.sum(F.coalesce("calls", F.lit(0))), F.sum(F.coalesce("payers", F.lit(0)))
    g = items.groupBy("category").agg(F.count("*").alias("services"), calls.alias("calls"), payers.alias("payers"))
    return g.withColumns({"calls_per_service": F.round(F.col("calls") / F.col("services"), 4), "calls_per_payer": F.round(F.col("calls") / F.greatest("payers", F.lit(1)), 4)})


def categories_by_size(items: DataFrame) -> DataFrame:
    """place, category, services: categories with most items first, then by name. There are as many rows as categories."""
    g = items.groupBy("category").agg(F.count("*").alias("services"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.col("services").desc(), "category")))  # a row for each category


def payer_thresholds(items: DataFrame, *least: int) -> DataFrame:
    """Items, how many have at least so many payers, and how many no calls."""
    return items.agg(F.count("*").alias("services"), *[F.count_if(F.coalesce("payers", F.lit(0)) >= n).alias(f"at_least_{n}") for n in least], F.count_if(F.col("calls") == 0).alias("unused"))


def by_price_band(items: DataFrame) -> DataFrame:
    """Half-open price bands; empty bands are listed too."""
    spark = items.sparkSession
    bands = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(PRICE_BANDS)], "band_no int, band string")
    number = None
    for i, (_, lo, hi) in enumerate(PRICE_BANDS):
        hit = (F.col("price") >= lo if lo is not None else F.lit(True)) & (F.col("price") < hi if hi is not None else F.lit(True))
        number = F.when(hit, i) if number is None else number.when(hit, i)
    g = items.filter("price IS NOT NULL").groupBy(number.alias("band_no")).agg(F.count("*").alias("services"), F.sum("calls").alias("calls"))
    return F.broadcast(bands).join(g, "band_no", "left").select("band", F.coalesce("services", F.lit(0)).alias("services"), F.coalesce("calls", F.lit(0)).alias("calls"))


def concentration(items: DataFrame, tops=(1, 10, 50, 100)) -> DataFrame:
    """Share of all calls that the busiest n items have: a top-n below one aggregate."""
    total = items.agg(F.sum("calls").alias("total"))
    best = items.select("calls", "item").orderBy(F.col("calls").desc(), "item").limit(max(tops))
    ranked = best.withColumn("r", F.row_number().over(Window.orderBy(F.col("calls").desc(), "item")))  # at most max(tops) rows
    g = ranked.agg(*[F.sum(F.when(F.col("r") <= n, F.col("calls"))).alias(f"top{n}") for n in tops])
    return g.crossJoin(total).select("total", *[F.round(F.col(f"top{n}") / F.col("total"), 6).alias(f"top{n}_share") for n in tops])  # one row each


def payer_counts(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy("recipient").agg(F.count("*").alias("transfers"), F.count_distinct("tx").alias("txs"), F.count_distinct("sender").alias("senders"))


def sender_counts(transfers: DataFrame) -> DataFrame:
    """Transfers of each sender."""
    return transfers.groupBy("sender").agg(F.count("*").alias("n"))


def payer_distribution(transfers: DataFrame) -> DataFrame:
    per = transfers.groupBy("sender").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("senders"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") >= 100).alias("at_least_100"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))


def catalogue_totals(items: DataFrame) -> DataFrame:
    """Totals of catalogue items with calls and payers, both null where no usage is published."""
    known = F.col("calls").isNotNull()
    g = items.agg(F.count("*").alias("resources"), F.count_if(known).alias("with_usage"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum(F.when(known, F.col("payers"))), F.lit(0)).alias("payers"), F.count_if(F.col("calls") == 0).alias("no_calls"), F.count_if(known & (F.coalesce("payers", F.lit(0)) == 0)).alias("no_payers"))
    return g.withColumns({"usage_share": W.percent(F.col("with_usage"), F.col("resources")), "no_calls_share": W.percent(F.col("no_calls"), F.col("with_usage")), "no_payers_share": W.percent(F.col("no_payers"), F.col("with_usage"))})


def widest(items: DataFrame, n: int = 10, item: str = "item") -> DataFrame:
    """The n items with most payers: a top-n."""
    return items.orderBy(F.coalesce("payers", F.lit(0)).desc(), item).limit(n)


def top_payouts(items: DataFrame, n: int = 40, item: str = "item") -> DataFrame:
    """The n items with most payers, of those with any."""
    return widest(items.filter(F.coalesce("payers", F.lit(0)) > 0), n, item)


def top_senders(transfers: DataFrame, n: int = 5) -> DataFrame:
    """sender, n of the senders with most transfers, and the share of all transfers that the listed ones make up together."""
    per = transfers.groupBy("sender").agg(F.count("*").alias("n"))
    best = per.orderBy(F.col("n").desc(), "sender").limit(n)
    total = per.agg(F.sum("n").alias("total"))
    upto = F.sum("n").over(Window.orderBy(F.col("n").desc(), "sender"))  # at most n rows
    return best.withColumn("upto", upto).crossJoin(total).select("sender", "n", F.round(F.col("upto") / F.col("total"), 6).alias("share_so_far"))  # one row beside n


# --- listing checks -------------------------------------------------------------------------------------------


def failed_checks(checks: Column) -> Column:
    """Number of an array of checks (severity, passed) that are required and did not pass."""
    return F.size(F.filter(checks, lambda c: (c["severity"] == "required") & ~F.coalesce(c["passed"], F.lit(False))))


def tool_list(body: Column) -> Column:
    """names (sorted, joined by commas) and untyped (names whose output schema is no object) of a JSON list of tools."""
    tools = F.try_variant_get(F.try_parse_json(body), "$.tools", "array<variant>")
    name = lambda t: F.try_variant_get(t, "$.name", "string")
    typed = lambda t: F.coalesce(F.try_variant_get(t, "$.outputSchema.type", "string") == "object", F.lit(False))
    return F.struct(F.array_join(F.array_sort(F.transform(tools, name)), ",").alias("names"), F.transform(F.filter(tools, lambda t: ~typed(t)), name).alias("untyped"))


def manifest_differs(manifest: Column, challenge: Column, fields: list[str]) -> Column:
    """Names of the fields in which two JSON documents differ; absent in both is equal."""
    at = lambda x, f: F.get_json_object(x, f"$.{f}")
    return F.array_compact(F.array(*[F.when(~at(manifest, f).eqNullSafe(at(challenge, f)), f) for f in fields]))


def names_seen(names: Column) -> Column:
    """Distinct names in the order first seen, joined by commas; `none` for none."""
    return F.coalesce(F.nullif(F.array_join(F.array_distinct(names), ","), F.lit("")), F.lit("none"))


def page_links(html: Column, base: str) -> Column:
    """Distinct links of a page, sorted; relative ones are made absolute, other schemes left out."""
    found = F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))
    whole = F.transform(found, lambda x: F.when(x.rlike("^https?://"), x).when(x.startswith("/"), F.concat(F.lit(base.rstrip("/")), x)))
    return F.array_sort(F.array_distinct(F.array_compact(whole)))


def matching_lines(text: Column, needle: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.contains(needle)))
