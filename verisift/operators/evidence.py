"""Evidence ranking: segments of a document that answer a question, their labels, and the verdict over sources.

A document is one row, and so is its ranking: segments, matches, frequencies and scores are arrays within the row, so
that ranking needs no shuffle. Only the verdict groups, by question.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisift.functions import text as T
from verisift.functions.common import let
from verisift.operators import requests as R

# Fixed values.
ADJACENCY_BONUS, ENOUGH_COVERAGE, DIRECT_FROM, SUPPORTING_FROM = 0.5, 0.75, 0.75, 0.35
#: Hosts that a basis sentence names, for each side: as many as a request can have sources.
MOST_HOSTS = 25


def round6(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def build_segments(text: Column, headings: Column | None = None) -> Column:
    """Segments in order: a heading line, or a sentence of another line, with its breadcrumb. `headings` holds structs of
    level and text; a line that equals one is a heading (the first of several counts). Null texts have no segments."""
    sentences = lambda line, number, where: F.transform(T.split_sentences(line), lambda s: F.struct(s.alias("text"), number.cast("int").alias("paragraph"), where.alias("context"), F.lit(False).alias("is_heading")))
    place = lambda number: F.concat(F.lit("p["), number.cast("string"), F.lit("]"))
    if headings is None:
        return F.flatten(F.transform(T.normalize_lines(text), lambda x, i: sentences(x, i + 1, place(i + 1))))

    def of(p: Column) -> Column:
        heads = p["heads"]
        label = lambda line: F.get(F.transform(F.filter(heads, lambda h: h["text"] == line), lambda h: F.concat(F.lit("h"), h["level"].cast("string"), F.lit(":"), h["text"])), F.lit(0))
        #: Line numbers of headings; the lines after each, up to the next, are one stretch.
        at = F.filter(F.transform(p["lines"], lambda x, i: F.when(F.array_contains(heads["text"], x), i + 1)), lambda i: i.isNotNull())

        def stretches(c: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(c, k + 1), F.size(p["lines"]) + 1)
                name = label(F.get(p["lines"], start - 1))

                def told(above: Column) -> Column:
                    head = F.when(start > 0, F.array(F.struct(F.get(p["lines"], start - 1).alias("text"), (start - k).cast("int").alias("paragraph"), above["label"].alias("context"), F.lit(True).alias("is_heading"))))
                    number = lambda i: start + i + 1 - k
                    where = lambda i: F.when(start > 0, F.concat(above["label"], F.lit(" > "), place(number(i)))).otherwise(place(number(i)))
                    rest = F.flatten(F.transform(F.slice(p["lines"], start + 1, F.greatest(end - start - 1, F.lit(0))), lambda x, i: sentences(x, number(i), where(i))))
                    return F.when(start > 0, F.concat(head, rest)).otherwise(rest)

                return let(F.struct(name.alias("label")), told)

            return F.flatten(F.transform(c, one))

        return let(F.concat(F.array(F.lit(0)), at), stretches)

    known = F.coalesce(headings, F.array().cast("array<struct<level:int,text:string>>"))
    return let(F.struct(T.normalize_lines(text).alias("lines"), known.alias("heads")), of)


def _matched(segments: Column, terms: list[str]) -> Column:
    """Of the segments that match any term: their number, the distinct terms and the count of adjacent pairs of different
    terms. Two compiled patterns find the matches: most segments hold none and are let go by the first."""
    forms = T.term_forms(terms)
    quoted = "|".join(re.escape(f) for f in sorted(forms, key=len, reverse=True))
    edge = "\\p{L}\\p{N}'"
    maybe = f"(?<![{edge}‘’ʼ`])(?:" + "|".join(re.escape(t).replace("'", "['‘’ʼ`]") for t in terms) + ")"
    token, run = f"(?<![{edge}])({quoted})(?![{edge}])", f"(?<![{edge}])((?:{quoted})(?:\\s+(?:{quoted}))+)(?![{edge}])"
    name = {f: terms.index(t) for f, t in forms.items()}
    #: A form as the number of its term.
    number = lambda f: F.element_at(F.create_map(*[x for f_, i in name.items() for x in (F.lit(f_), F.lit(i))]), f)

    def pairs(text: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(1)), lambda r: F.transform(F.split(r, "\\s+"), number))
        count = lambda m: F.size(F.filter(F.arrays_zip(F.slice(m, 1, F.size(m) - 1).alias("a"), F.slice(m, 2, F.size(m)).alias("b")), lambda p: p["a"] != p["b"]))
        return F.aggregate(runs, F.lit(0), lambda a, r: a + count(r))

    def one(s: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(s["plain"], F.lit(token), F.lit(1)), number)
        return let(hits, lambda h: F.struct(s["s"].alias("s"), s["i"].alias("i"), F.array_distinct(h).alias("terms"), F.when(F.size(h) > 1, pairs(s["plain"])).otherwise(0).alias("adjacent")))

    numbered = F.filter(F.transform(segments, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: F.lower(x["s"]["text"]).rlike(maybe))
    plain = F.transform(numbered, lambda x: F.struct(x["s"].alias("s"), x["i"].alias("i"), T.plain(x["s"]["text"]).alias("plain")))
    return F.filter(F.transform(plain, one), lambda x: F.size(x["terms"]) > 0)


def rank(docs: DataFrame, question: str, k: int = 5, max_chars: int = 600, headings: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with `candidates`: array of (rank, excerpt, context, relevance, score, coverage, segment), best k first.

    Score: sum of idf of matched terms, plus a bonus for adjacent pairs, rounded to 1e-6; ties in document order. idf is
    ln(1 + segments / (1 + segments with the term)) within the document. Null or empty texts have no candidates."""
    terms, groups = T.question_terms(question)
    shape = "array<struct<rank:int,excerpt:string,context:string,relevance:string,score:double,coverage:double,segment:int>>"
    if not terms or k <= 0:
        return docs.withColumn("candidates", F.array().cast(shape))
    at = {t: i for i, t in enumerate(terms)}

    def scored(p: Column) -> Column:
        n, m = p["n"], p["m"]
        counted = F.aggregate(m, F.array(*[F.lit(0) for _ in terms]), lambda a, s: F.transform(a, lambda c, i: c + F.array_contains(s["terms"], i).cast("int")))
        idf = F.transform(counted, lambda d: F.log(1 + n / (1 + d)))

        def with_idf(w: Column) -> Column:
            weight = [F.array_max(F.array(*[F.get(w, F.lit(at[v])) for v in vs])) for _, vs in groups]
            total = sum(weight[1:], weight[0])

            def one(s: Column) -> Column:
                hit = [F.when(F.arrays_overlap(s["terms"], F.array(*[F.lit(at[v]) for v in vs])), x).otherwise(0.0) for x, (_, vs) in zip(weight, groups, strict=True)]
                mass = F.aggregate(s["terms"], F.lit(0.0), lambda a, t: a + F.get(w, t))
                return F.struct((-round6(mass + s["adjacent"] * ADJACENCY_BONUS)).alias("minus"), s["i"].alias("segment"), (sum(hit[1:], hit[0]) / total).alias("coverage"), s["s"]["text"].alias("text"), s["s"]["context"].alias("context"))

            return F.array_sort(F.transform(m, one))

        return let(idf, with_idf)

    def labelled(best: Column) -> Column:
        top = -F.get(best, F.lit(0))["minus"]

        def one(s: Column, i: Column) -> Column:
            score = -s["minus"]
            label = F.when(s["coverage"] < ENOUGH_COVERAGE, "context").when(T.has_negation_cue(s["text"]), "contradictory").when(score >= DIRECT_FROM * top, "direct").when(score >= SUPPORTING_FROM * top, "supporting").otherwise("context")
            return F.struct((i + 1).cast("int").alias("rank"), T.truncate(s["text"], max_chars).alias("excerpt"), s["context"].alias("context"), label.alias("relevance"), score.alias("score"), s["coverage"].alias("coverage"), s["segment"].cast("int").alias("segment"))

        return F.transform(F.slice(best, 1, k), one)

    segments = build_segments(F.col(text_col), F.col(headings) if headings else None)
    found = let(segments, lambda s: F.struct(F.size(s).alias("n"), _matched(s, terms).alias("m")))
    return docs.withColumn("candidates", let(let(found, scored), labelled))


def candidates(ranked: DataFrame, *keys: str) -> DataFrame:
    """One row per candidate. An outer explode: an inner one would make the optimizer work the candidates out once more, in
    a filter on their number that it moves below every shuffle."""
    return ranked.select(*keys, F.explode_outer("candidates").alias("c")).filter("c IS NOT NULL").select(*keys, "c.*")


def stance(found: Column) -> Column:
    """Stance of a source: that of its first candidate that isn't context; null without one."""
    first = F.get(F.filter(found, lambda c: c["relevance"] != "context"), F.lit(0))["relevance"]
    return F.when(first == "contradictory", "contradicts").when(first.isNotNull(), "supports")


def rerank(ranked: DataFrame, scores: str, k: int) -> DataFrame:
    """Candidates in the order of a model's scores (array column, one in [0, 1] for each candidate), best k kept; those of
    0.5 or more become direct, but for the first lexical one and contradictory ones. Unusable scores change nothing."""
    c, s = F.col("candidates"), F.col(scores)
    usable = s.isNotNull() & (F.size(s) == F.size(c)) & ~F.exists(s, lambda x: F.coalesce(F.isnan(x) | (x < 0) | (x > 1), F.lit(True)))
    order = F.array_sort(F.transform(F.arrays_zip(c.alias("c"), s.alias("s")), lambda x, i: F.struct((-x["s"]).alias("m"), i.alias("i"), x["c"].alias("c"))))
    raised = F.transform(order, lambda x: x["c"].withField("relevance", F.when((x["m"] <= -0.5) & (x["i"] > 0) & (x["c"]["relevance"] != "contradictory"), "direct").otherwise(x["c"]["relevance"])))
    return ranked.withColumn("candidates", F.when(usable, F.slice(raised, 1, k)).otherwise(F.slice(c, 1, k)))


def assess(sources: DataFrame, question_wh_words: int, *keys: str, host: str = "host", pos: str = "pos", refined_by: str | None = None) -> DataFrame:
    """Verdict for each key over sources with columns stance, host and position: counts, status, basis, limitations.

    Two or more wh-words with a single contributing source abstain. If the sources have them, status (null: failed),
    from_cache and refined add their notices. The basis names the first MOST_HOSTS hosts of either side."""
    is_for, against = F.col("stance") == "supports", F.col("stance") == "contradicts"
    has = lambda c: c in sources.columns
    nth = F.row_number().over(Window.partitionBy(*keys, "stance").orderBy(pos, host))
    hosts = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond & (F.col("__nth") <= MOST_HOSTS), F.struct("__nth", F.col(host).alias("h"))))), lambda x: x["h"]), ", ")
    lost, cached, refined = (F.count_if(F.col("status").isNull()) if has("status") else F.lit(0)), (F.bool_or(F.coalesce("from_cache", F.lit(False))) if has("from_cache") else F.lit(False)), (F.bool_or(F.coalesce("refined", F.lit(False))) if has("refined") else F.lit(False))
    g = sources.withColumn("__nth", nth).groupBy(*keys).agg(F.count("*").alias("n_sources"), F.count_if(is_for).alias("n_support"), F.count_if(against).alias("n_contradict"), hosts(is_for).alias("for_hosts"), hosts(against).alias("against_hosts"), lost.alias("n_failed"), cached.alias("any_cached"), refined.alias("any_refined"))
    s, c = F.col("n_support"), F.col("n_contradict")
    status = F.when((s == 0) & (c == 0), "inconclusive").when(c == 0, "supported").when(s == 0, "contradicted").otherwise("mixed")
    abstains = (s + c == 1) if question_wh_words >= 2 else F.lit(False)
    # The sentences of a verdict.
    basis = (
        F.when(abstains, "The question asks more than one thing and only one source contributed a matching passage, so the passages cannot be shown to answer the part they appear to match. No verdict is claimed.")
        .when(status == "inconclusive", F.format_string("No passage in the %d retrieved source(s) matched the question closely enough to support or contradict it.", "n_sources"))
        .when(status == "supported", F.format_string("%d source(s) contained passages matching the question (%s) with no contradicting passages found.", "n_support", "for_hosts"))
        .when(status == "contradicted", F.format_string("%d source(s) contained passages that negate the question (%s) with no supporting passages found.", "n_contradict", "against_hosts"))
        .otherwise(F.format_string("Sources disagreed: %d leaning to support (%s) and %d leaning against (%s).", "n_support", "for_hosts", "n_contradict", "against_hosts"))
    )
    notes = R.limitations(F.col("n_sources"), F.col("n_sources") - s - c, abstains, F.col("n_failed"), F.when(F.col("any_refined"), refined_by or "a reasoning provider"), F.col("any_cached"))
    return g.select(*keys, "n_sources", "n_support", "n_contradict", F.when(abstains, "inconclusive").otherwise(status).alias("status"), basis.alias("basis"), notes.alias("limitations"))
