"""Benchmark decontamination by template windows; DataFrame functions only.

A text is brought to template form: names (capitalised words within a sentence), numbers and units become typed
placeholders, everything else is lower-cased words without punctuation. Windows of consecutive template words are
hashed and joined with those of the benchmark. For windows that meet, the words behind the placeholders are compared:
within one alignment of a document and an item, the same benchmark value must always stand for the same document value.
Thin windows, which are mostly placeholders, would meet too much by template; they are hashed and joined by their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import let, materialise

WINDOW = 8
#: Words that must not be placeholders in a window met by template (others need equal values); windows that must meet in
#: one alignment (or all, if the item has fewer).
LEAST_PLAIN, LEAST_WINDOWS = 4, 2
#: Benchmark windows, and hit documents, up to which they are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_HITS = 500_000, 500_000
UNITS = "km|cm|mm|kg|mg|lb|oz|ml|min|sec|hours|hour|days|day|years|year|miles|mile|feet|foot|meters|meter|dollars|dollar|euros|euro|cents|cent|percent"
MARK, NAME, UNIT, NUM = "", "", "", ""  # private-use characters, so that they are no one's words
_GAP = f"[^\\p{{L}}\\p{{N}}{MARK}-{NUM}]+"


_NAMES = "(?<=[\\p{L}\\p{N},;:] )(\\p{Lu}\\p{Ll}+\\p{L}*)"


def _cut_units(text: Column) -> Column:
    return F.regexp_replace(text, "([0-9])(?=\\p{L})", "$1 ")


def _by_digits(text: Column, with_digits, without) -> Column:
    """Texts without a digit skip the passes for numbers and units."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike("[0-9]"), with_digits(t)).otherwise(without(t)))


def value_words(text: Column) -> Column:
    """Lower-cased words, numbers cut from units and names marked."""
    marked = lambda t: F.lower(F.regexp_replace(t, _NAMES, f"{MARK}$1"))
    return F.array_remove(F.split(_by_digits(text, lambda t: marked(_cut_units(t)), marked), _GAP), "")


def bare_words(text: Column) -> Column:
    """The words of value_words() without marks: a word may stand as a name in one place and not in another."""
    return F.array_remove(F.split(_by_digits(text, lambda t: F.lower(_cut_units(t)), F.lower), _GAP), "")


def template_words(text: Column) -> Column:
    """Template words; one for each of value_words()."""
    named = lambda t: F.lower(F.regexp_replace(t, _NAMES, NAME))

    def full(t: Column) -> Column:
        t = F.regexp_replace(named(_cut_units(t)), f"(?<=[0-9] )(?:{UNITS})(?![\\p{{L}}\\p{{N}}])", UNIT)
        return F.regexp_replace(t, "[0-9]+", NUM)

    return F.array_remove(F.split(_by_digits(text, full, named), _GAP), "")


def _windows(words: Column, size: int) -> Column:
    """All runs of `size` words as an array of structs (runs past the end have nulls). Zipped shifts, not a lambda for each
    word: the words are cut out once and what follows the explode is compiled code."""
    shifts = lambda w: F.arrays_zip(*[(w if k == 0 else F.slice(w, k + 1, F.greatest(F.size(w), F.lit(1)))).alias(f"w{k}") for k in range(size)])
    return let(words, shifts)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, item_at, thin, h of all windows; an item shorter than a window is one. A window with too few plain
    words is thin: its h is made of its values, not of its template."""
    size = lambda w: F.least(F.size(w), F.lit(window))
    plain = lambda x: F.size(F.filter(x, lambda t: ~t.isin(NAME, UNIT, NUM)))
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", template_words(F.col("text")).alias("kinds"), bare_words(F.col("text")).alias("values"))
    cut = lambda c, i: F.slice(c, i + 1, size("kinds"))
    at = F.transform(F.sequence(F.lit(0), F.size("kinds") - size("kinds")), lambda i: F.struct(i.alias("item_at"), cut("kinds", i).alias("words"), cut("values", i).alias("values")))
    rows = items.select("item_id", F.explode(at).alias("x")).withColumn("size", F.size("x.words")).filter("size > 0")
    rows = rows.withColumn("thin", plain(F.col("x.words")) < F.least(F.lit(LEAST_PLAIN), F.col("size")))
    return rows.select("item_id", "size", "x.item_at", "thin", F.when(F.col("thin"), F.xxhash64("x.values")).otherwise(F.xxhash64("x.words")).alias("h"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, shift (place in the document less place in the item), n_windows met, n_same (with equal values),
    consistent (slots of windows met by template map one value to one value), item_windows, contaminated.

    Documents with a null id count as one document. Null or empty texts and items meet nothing; repeated documents or
    items of one id count as one; an item shorter than the window counts as a single window of all its words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    bench = materialise(benchmark_windows(items, window), "bench")
    n, sizes = bench.count(), sorted((r["size"], r["thin"]) for r in bench.select("size", "thin").distinct().collect())
    small = F.broadcast if n <= BROADCAST_WINDOWS else lambda x: x
    use = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = None
    for size, thin in sizes:
        words = (bare_words if thin else template_words)(F.col("text"))
        rows = use.select("doc_id", F.posexplode(_windows(words, size)).alias("doc_at", "w"))
        rows = rows.filter(F.col(f"w.w{size - 1}").isNotNull()).select("doc_id", "doc_at", F.xxhash64(*[F.col(f"w.w{k}") for k in range(size)]).alias("h"))
        one = rows.join(small(bench.filter((F.col("size") == size) & (F.col("thin") == thin))), "h").select("doc_id", "doc_at", "item_id", "item_at", "size", "thin")
        met = one if met is None else met.unionByName(one)
    if met is None:
        met = use.limit(0).select("doc_id", F.lit(0).alias("doc_at"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("item_at"), F.lit(0).alias("size"), F.lit(False).alias("thin"))
    met = materialise(met.distinct(), "met")
    ids = met.select("doc_id").distinct()
    ids = F.broadcast(ids) if met.count() <= BROADCAST_HITS else ids
    texts = use.join(ids.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    words = texts.select(F.col("doc_id").alias("d"), value_words(F.col("text")).alias("words"), template_words(F.col("text")).alias("kinds"))
    whole = items.select(F.col("item_id").alias("i"), value_words(F.col("text")).alias("item_words"))
    both = met.join(words, F.col("doc_id").eqNullSafe(F.col("d"))).join(whole, F.col("item_id") == F.col("i"))
    cut = lambda c, at: F.slice(c, F.col(at) + 1, F.col("size"))
    bare = lambda w: F.transform(w, lambda x: F.translate(x, MARK, ""))
    kinds, mine, its = cut("kinds", "doc_at"), cut("words", "doc_at"), cut("item_words", "item_at")
    slots = F.filter(F.arrays_zip(kinds.alias("k"), mine.alias("m"), its.alias("t")), lambda x: x["k"].isin(NAME, UNIT, NUM) | x["k"].contains(NUM))
    rows = both.select("doc_id", "item_id", "doc_at", (F.col("doc_at") - F.col("item_at")).alias("shift"), F.when(F.col("thin"), bare(mine) == bare(its)).otherwise(mine == its).alias("same"), "thin", slots.alias("slots"))
    rows = rows.groupBy("doc_id", "item_id", "shift").agg(
        F.countDistinct("doc_at").alias("n_windows"),
        F.countDistinct(F.when(F.col("same"), F.col("doc_at"))).alias("n_same"),
        F.countDistinct(F.when(~F.col("thin"), F.col("doc_at"))).alias("n_plain"),
        F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("thin"), F.col("slots"))))).alias("slots"),
    )
    pair = F.array_distinct(F.transform("slots", lambda x: F.concat_ws(MARK, x["t"], x["m"])))
    consistent = F.size(F.array_distinct(F.transform("slots", lambda x: x["t"]))) == F.size(pair)
    total = bench.groupBy("item_id").agg(F.countDistinct("item_at").alias("item_windows"), F.countDistinct(F.when(~F.col("thin"), F.col("item_at"))).alias("item_plain"))
    rows = rows.select("doc_id", "item_id", "shift", "n_windows", "n_same", "n_plain", consistent.alias("consistent")).join(total, "item_id")
    enough = lambda c: F.least(F.lit(LEAST_WINDOWS), F.col(c))
    by_template = F.col("consistent") & (F.col("n_plain") > 0) & (F.col("n_plain") >= enough("item_plain"))
    return rows.withColumn("contaminated", (F.col("n_same") >= enough("item_windows")) | by_template).drop("n_plain", "item_plain")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_items, item_ids (sorted) of contaminated documents only."""
    bad = find_hits(docs, benchmark, window).filter("contaminated")
    return bad.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated, all columns as they were. Each row is judged by itself, under a hash of its
    id and text: rows of one id, or without one, don't share a verdict unless their texts are equal."""
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(3))
    bad = materialise(judge(docs.select(own.alias("doc_id"), "text"), benchmark, window).select(F.col("doc_id").alias("__bad")), "bad")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_HITS else bad
    keyed = docs.withColumn("__own", own)
    return keyed.join(bad, keyed["__own"] == bad["__bad"], "left_anti").select(*docs.columns)
