"""Requests: validation, limits, gates on fetched sources, and the assembled response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions import urls as U
from verisift.functions import wire as W
from verisift.functions.common import let

# Fixed values.
QUESTION_CHARS, MOST_URLS, MOST_SOURCES, LANGUAGE_CHARS, MODES = 2000, 25, 25, 35, ["evidence"]
URL_LIMIT, PREVIEW_CHARS, MS_PER_CANDIDATE, MOST_REASONS = 5, 8, 800, 5
LEXICAL_NOTICE = "Assessment is derived from deterministic lexical matching, not semantic reasoning. A configured reasoning provider may refine it, but never replaces source evidence."
SILENT_NOTICE = "%d source(s) contributed no directly matching passage and were not used to reach the assessment."
MULTI_PART_NOTICE = "A multi-part question was answered from a single source, which deterministic lexical matching cannot verify."
FAILED_NOTICE = "%d of %d source(s) could not be retrieved; see per-source warnings."
REFINED_NOTICE = "Evidence ordering was refined by %s. The model reorders candidate passages only; every excerpt, source and hash is unchanged."
CACHE_NOTICE = "Some sources were served from cache. Each source reports its actual retrieval time."
ROBOTS_REFUSED = 'robots.txt disallows this path for our user agent (rule: "%s").'
ROBOTS_WARNING = ROBOTS_REFUSED + " Retrieved because ROBOTS_POLICY=warn; set ROBOTS_POLICY=enforce to refuse."
TYPE_REFUSED = "The source returned %s, which this service does not process."
HTTP_WARNING, CACHE_WARNING = "The source returned HTTP %d.", "Served from cache; originally retrieved at %s."
PREVIEW_EXCERPTS = 3
PREVIEW_NOTE = "Preview: one source, three excerpts, no assessment. The paid call takes up to five sources and returns the supported/contradicted/mixed/inconclusive verdict with full provenance."
LEVELS = ["debug", "info", "warn", "error"]


def request_issues(question: Column, urls: Column, max_sources: Column, language: Column, mode: Column) -> Column:
    """Names of the request's fields that break their shape; only the question is required."""
    q, tag = F.trim(question), F.trim(language)
    wrong = [
        ("question", ~F.coalesce(F.length(q).between(1, QUESTION_CHARS), F.lit(False))),
        ("urls", F.coalesce((F.size(urls) > MOST_URLS) | F.exists(urls, lambda u: u.isNull()), F.lit(False))),
        ("max_sources", F.coalesce(~max_sources.between(1, MOST_SOURCES), F.lit(False))),
        ("language", F.coalesce(~F.length(tag).between(1, LANGUAGE_CHARS), F.lit(False))),
        ("mode", F.coalesce(~mode.isin(MODES), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in wrong]))


def edge_shape(question: Column, urls: Column) -> Column:
    """A non-empty question and a list of strings: the first check, at the edge."""
    return F.coalesce((F.trim(question) != "") & ~F.exists(urls, lambda u: u.isNull()), F.lit(False))


def unique_urls(urls: Column) -> Column:
    """URLs trimmed, without empty ones and repeats (by their canonical key, else their text), in order, first spelling kept."""
    trimmed = F.filter(F.transform(urls, lambda u: F.trim(u)), lambda u: u != "")
    keyed = F.transform(trimmed, lambda u: F.struct(F.coalesce(U.cache_key(u), u).alias("key"), u.alias("url")))
    return let(keyed, lambda k: F.transform(F.filter(k, lambda x, i: F.array_position(k["key"], x["key"]) == i + 1), lambda x: x["url"]))


def policy_error(distinct: Column, limit: int = URL_LIMIT) -> Column:
    """Why a request with these distinct URLs is refused, or null."""
    n = F.size(distinct)
    return F.when(n == 0, "At least one source URL is required. Version 0.1.0 supports agent-supplied URLs only.").when(n > limit, F.format_string("Too many URLs: %d supplied, limit is %d.", n, F.lit(limit)))


def targets(distinct: Column, max_sources: Column, limit: int = URL_LIMIT) -> Column:
    """The URLs that are fetched: as many as asked for, there are and are allowed."""
    n = F.size(distinct)
    return F.slice(distinct, F.lit(1), F.least(F.coalesce(max_sources, n), n, F.lit(limit), F.lit(MOST_SOURCES)))


def preview_error(question: Column, url: Column) -> Column:
    return F.when(~F.coalesce(F.length(F.trim(question)) >= PREVIEW_CHARS, F.lit(False)), "question must be at least 8 characters.").when(~F.coalesce(url.rlike("^https?://"), F.lit(False)), "url must be one absolute http(s) URL.")


def place_valid(state: Column | None = None, lat: Column | None = None, lon: Column | None = None) -> Column:
    """Whether a two-letter state, or a latitude and longitude, can be asked for; nulls and NaN can't."""
    if state is not None:
        return F.coalesce(state.rlike("^[A-Za-z]{2}$"), F.lit(False))
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def source_gate(content_type: Column, size: Column, wire_size: Column, allowed: Column, rule: Column, *, policy: str = "warn", most: int = 2 << 20) -> Column:
    """code and message of the first gate that refuses a fetched source, or null: robots (policy ignore, warn, enforce),
    size, content type. allowed null counts as allowed."""
    no = lambda code, message: F.struct(F.lit(code).alias("code"), message.alias("message"))
    large = W.too_large(size, wire_size, most)
    out = F.when(~F.coalesce(allowed, F.lit(True)) & F.lit(policy == "enforce"), no("BLOCKED_URL", F.format_string(ROBOTS_REFUSED, rule)))
    out = out.when(large.isNotNull(), no("RESPONSE_TOO_LARGE", large))
    return out.when(~W.is_supported_type(content_type), no("UNSUPPORTED_CONTENT", F.format_string(TYPE_REFUSED, F.coalesce(content_type, F.lit("no content type")))))


def robots_warning(allowed: Column, rule: Column, policy: str = "warn") -> Column:
    return F.when(~F.coalesce(allowed, F.lit(True)) & F.lit(policy == "warn"), F.struct(F.lit("ROBOTS_DISALLOWED").alias("code"), F.format_string(ROBOTS_WARNING, rule).alias("message")))


def payload_usable(payload: Column) -> Column:
    """Whether a cached JSON payload has a document, a list of candidates, a final URL and a status; text that is no JSON
    hasn't."""
    v = F.try_parse_json(payload)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.coalesce(kind("$.doc").rlike("^(OBJECT|ARRAY)") & kind("$.candidates").startswith("ARRAY") & (kind("$.finalUrl") == "STRING") & kind("$.status").rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.lit(False))


def budget_gate(candidates: Column, remaining_ms: Column) -> Column:
    """Whether a source is sent to the scoring model: two candidates or more, and budget for all of them."""
    return (candidates >= 2) & (candidates * MS_PER_CANDIDATE <= remaining_ms)


def with_budget(sources: DataFrame, budget_ms: int, *keys: str, pos: str = "pos", candidates: str = "n_candidates") -> DataFrame:
    """sources with `scored`: each source of a request, in order, reserves its cost if the budget left covers it. A request has
    at most MOST_SOURCES sources, so that a fold over them is one small array; others are refused with an error."""
    per = sources.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(candidates).alias("c")))).alias("all"))
    per = per.withColumn("all", F.when(F.size("all") <= MOST_SOURCES, F.col("all")).otherwise(F.raise_error(F.lit(f"more than {MOST_SOURCES} sources in a request")).cast("array<struct<p:int,c:int>>")))

    def step(a: Column, x: Column) -> Column:
        ok = budget_gate(x["c"], a["left"])
        return F.struct((a["left"] - F.when(ok, x["c"] * MS_PER_CANDIDATE).otherwise(0)).cast("long").alias("left"), F.concat(a["ok"], F.array(ok)).alias("ok"))

    start = F.struct(F.lit(budget_ms).cast("long").alias("left"), F.array().cast("array<boolean>").alias("ok"))
    done = per.withColumn("ok", F.aggregate("all", start, step)["ok"]).select(*keys, F.explode(F.arrays_zip(F.col("all.p").alias("p"), F.col("ok").alias("ok"))).alias("x"))
    return sources.join(done.select(*keys, F.col("x.p").alias(pos), F.col("x.ok").alias("scored")), [*keys, pos])


def limitations(n_sources: Column, n_silent: Column, abstains: Column, n_failed: Column, refined_by: Column, any_cached: Column) -> Column:
    """The notices of a response in their order."""
    return F.array_compact(
        F.array(
            F.lit(LEXICAL_NOTICE),
            F.when(n_silent > 0, F.format_string(SILENT_NOTICE, n_silent)),
            F.when(abstains, MULTI_PART_NOTICE),
            F.when(n_failed > 0, F.format_string(FAILED_NOTICE, n_failed, n_sources)),
            F.when(refined_by.isNotNull(), F.format_string(REFINED_NOTICE, refined_by)),
            F.when(any_cached, CACHE_NOTICE),
        )
    )


def request_totals(sources: DataFrame, *keys: str) -> DataFrame:
    """Counts of each request over sources with status (null: failed), from_cache, refined and n_candidates, and its outcome:
    NO_SOURCES_RETRIEVED, with the first distinct warning codes, unless a source has status 200."""
    cached, lost = F.coalesce("from_cache", F.lit(False)), F.col("status").isNull()
    codes = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "codes"))), lambda x: x["codes"])))
    g = sources.groupBy(*keys).agg(
        F.count("*").alias("sources"), F.count_if(~lost).alias("fetch_ok"), F.count_if(lost).alias("fetch_failed"), F.count_if(cached).alias("cache_hits"), F.count_if(~cached).alias("cache_misses"),
        F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("candidates"), F.bool_or(F.coalesce("refined", F.lit(False))).alias("any_refined"), F.bool_or(cached).alias("any_cached"),
        F.count_if(F.col("status") == 200).alias("retrieved"), F.slice(codes, 1, MOST_REASONS).alias("reasons"),
    )
    said = F.concat(F.format_string("None of the %d requested source(s) could be retrieved, so no evidence was produced and no payment will be taken.", "sources"), F.when(F.size("reasons") > 0, F.concat(F.lit(" Reasons: "), F.array_join("reasons", ", "), F.lit("."))).otherwise(""))
    none = F.col("retrieved") == 0
    return g.withColumns({"code": F.when(none, "NO_SOURCES_RETRIEVED"), "message": F.when(none, said)})


def responses(requests: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """key and response: each request with its sources (a struct column `source`, ordered by pos) as one JSON document. A
    request holds at most MOST_SOURCES sources, so a group is small."""
    nested = sources.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("sources"))
    return requests.join(nested, key, "left").select(key, F.to_json(F.struct(*[c for c in requests.columns if c != key], "sources")).alias("response"))


# --- sources as they are answered -----------------------------------------------------------------------------

_WARNINGS = "array<struct<code:string,message:string>>"


def source_warnings(warnings: Column, status: Column, from_cache: Column, retrieved_at: Column) -> Column:
    """Warnings of a source: those it came with, then one for an error status, then one if it came from the cache."""
    one = lambda cond, code, message: F.when(cond, F.struct(F.lit(code).alias("code"), message.alias("message")))
    own = F.coalesce(warnings.cast(_WARNINGS), F.array().cast(_WARNINGS))
    more = F.array(one(status >= 400, "UPSTREAM_HTTP_FAILURE", F.format_string(HTTP_WARNING, status)), one(F.coalesce(from_cache, F.lit(False)), "SERVED_FROM_CACHE", F.format_string(CACHE_WARNING, retrieved_at)))
    return F.concat(own, F.array_compact(more))


def answered_source(row: Column, language: Column, now: Column) -> Column:
    """The answer's struct of a fetched source. row: requested_url, final_url, status, content_type, doc (fields of extraction),
    candidates, warnings, from_cache, retrieved_at (text), redirect_chain. `language` is what the request asked for (null or
    `auto`: the document's own); a source that is not from the cache was retrieved `now`."""
    doc = row["doc"]
    of = lambda *names: [doc[n].alias(n) for n in names]
    cached = F.coalesce(row["from_cache"], F.lit(False))
    at = F.when(cached, F.coalesce(row["retrieved_at"], now)).otherwise(now)
    evidence = F.transform(F.coalesce(row["candidates"], F.array()), lambda c: F.struct(c["excerpt"].alias("excerpt"), c["context"].alias("context"), c["relevance"].alias("relevance")))
    return F.struct(
        row["requested_url"].alias("requested_url"), row["final_url"].alias("final_url"), row["status"].alias("status"), row["content_type"].alias("content_type"), *of("title", "canonical_url", "description", "publisher"),
        F.when(F.coalesce(language, F.lit("auto")) != "auto", language).otherwise(doc["language"]).alias("language"), at.alias("retrieved_at"), *of("word_count"), doc["content_hash"].alias("content_hash_sha256"), evidence.alias("evidence"),
        source_warnings(row["warnings"], row["status"], cached, F.coalesce(row["retrieved_at"], doc["content_hash"])).alias("warnings"), cached.alias("from_cache"), F.coalesce(row["redirect_chain"], F.array().cast("array<string>")).alias("redirect_chain"),
    )


def failed_source(url: Column, code: Column, message: Column, now: Column) -> Column:
    """What is answered for a source that could not be retrieved: no status, no evidence, one warning."""
    said = F.when(message != "", message).otherwise("The source could not be retrieved.")
    return F.struct(url.alias("requested_url"), F.lit(None).cast("int").alias("status"), now.alias("retrieved_at"), F.array().cast("array<string>").alias("evidence"), F.array(F.struct(F.coalesce(code, F.lit("INTERNAL_ERROR")).alias("code"), F.coalesce(said, F.lit("The source could not be retrieved.")).alias("message"))).alias("warnings"), F.lit(False).alias("from_cache"))


def preview(question: Column, source: Column, remaining: Column) -> Column:
    """A preview of an answered source: its provenance and first three excerpts, no assessment."""
    kept = F.transform(F.slice(source["evidence"], 1, PREVIEW_EXCERPTS), lambda e: F.struct(e["excerpt"].alias("excerpt"), e["relevance"].alias("relevance"), F.when(e["context"] != "", e["context"]).alias("context")))
    provenance = F.struct(*[source[n].alias(n) for n in ("requested_url", "final_url", "status", "retrieved_at", "content_hash_sha256")])
    return F.struct(F.lit(True).alias("preview"), question.alias("question"), provenance.alias("source"), kept.alias("excerpts"), F.size(source["evidence"]).alias("excerpt_count_total"), F.lit(PREVIEW_NOTE).alias("note"), remaining.alias("previews_remaining_today"))


def log_lines(rows: DataFrame, level: str, message: str, *fields: str, at: str = "ts", least: str = "info") -> DataFrame:
    """rows as JSON log lines (a column `line`), those below the `least` level left out. An unknown level counts as debug.
    Nulls are left out; values under secret-looking names are hidden."""
    rank = lambda x: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in LEVELS]), F.lower(x)).cast("int"), F.lit(0))
    body = F.struct(F.col(level).alias("level"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.col(message).alias("message"), *[F.col(f) for f in fields])
    return rows.filter(F.greatest(rank(F.col(level)), F.lit(1)) >= LEVELS.index(least) + 1).withColumn("line", W.redact(F.to_json(body)))
