"""Filter interaction audit: what each filter of a cleaning chain removes, in every order of the filters.

1. Duplicates by sorting: rows are range-partitioned by (fingerprint of the text, doc_id) and sorted within a partition by
   fingerprint, full text and doc_id; each row is compared with its predecessor. Many copies of one text spread over
   partitions, as doc_id is part of the range. A run that an earlier partition has begun is settled by summaries (SHA-256
   of the text, smallest doc_id), of which a partition has two, short of colliding fingerprints.
2. Every row becomes a mask of the filters that it fails; masks are counted for each part, good and toxic rows aside.
3. The counters of a part (at most 4 for each mask) give all orders and steps: they are sums over masks.

A row is a document. Null texts are empty. A null doc_id has no smaller one and is smaller than none: it neither fails
the duplicate filter nor makes another row fail, and it has no labels. Rows of equal doc_id and text don't fail because of each other. Of
several labels of a document, one is enough to make it good or toxic. An empty table has no parts, thus no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import lean, materialise, parts_for, text_bytes, words_of

#: Text bytes of a range, about.
PART_BYTES = 64 << 20
_NONE = (1 << 63) - 1
_ROW, _EDGE = 0, 1


def standard_filters() -> dict[str, Column | None]:
    """Failure conditions over `text` and `words`; None stands for "identical to the text of a smaller doc_id"."""
    n_words = F.size("words")
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * n_words,
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 3 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
        "E": None,
    }


def _digest(text: pa.Scalar) -> bytes:
    return hashlib.sha256(text.as_buffer()).digest()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (fp, text, doc_id) to rows with `copy` (the text occurs at a smaller doc_id of this partition), and
    `sha` of those whose fingerprint is the partition's first; at the end of the first and of the last fingerprint, a
    summary for each of its texts."""
    names = ["kind", "doc_id", "part", "mask", "copy", "sha"]
    first_fp = fp = text = least = None  # of the partition; of the row before and its run of equal texts
    firsts: dict[bytes, int] = {}  # smallest doc_id of each text of the fingerprint that is under way

    def summaries() -> pa.RecordBatch:
        n = len(firsts)
        return pa.RecordBatch.from_arrays([pa.array([_EDGE] * n, pa.int32()), pa.array(firsts.values(), pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.array(firsts.keys(), pa.binary())], names=names)

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        texts = batch.column("text")
        fps, known = batch.column("fp").to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").fill_null(_NONE).to_numpy()
        new = np.ones(n, bool)
        near = np.flatnonzero(fps[1:] == fps[:-1]) + 1
        if len(near):
            new[near] = ~pc.equal(texts.take(pa.array(near)), texts.take(pa.array(near - 1))).to_numpy(zero_copy_only=False)
        if fp is not None and fps[0] == fp:
            new[0] = not texts[0].equals(text)
        starts = np.flatnonzero(new)
        begin = starts if new[0] else np.concatenate([[0], starts])
        end = np.append(begin[1:], n)
        runs = np.minimum.reduceat(ids, begin)
        if not new[0]:
            runs[0] = min(int(runs[0]), least)
        copy = known & (ids > np.repeat(runs, end - begin))
        shas: list[bytes | None] = [None] * n
        last = int(fps[-1])
        for a, b, smallest in zip(begin.tolist(), end.tolist(), runs.tolist(), strict=True):
            of = int(fps[a])
            if of != fp:  # a fingerprint ends
                if fp is not None and fp == first_fp:
                    yield summaries()
                first_fp, fp, firsts = of if fp is None else first_fp, of, {}
            if of == first_fp or of == last:
                sha = _digest(texts[a])
                firsts[sha] = min(smallest, firsts.get(sha, _NONE))
                if of == first_fp:
                    shas[a:b] = [sha] * (b - a)
        text, least = texts[n - 1], int(runs[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("doc_id"), batch.column("part"), batch.column("mask"), pa.array(copy), pa.array(shas, pa.binary())], names=names)
    if fp is not None:
        yield summaries()


def failure_masks(docs: DataFrame, filters: dict[str, Column | None] | None = None, part: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, part and mask (bit i: fails the i-th filter) of every row, written to the shared folder.

    A filter is a condition over `text` (never null) and `words`, or None for the duplicate filter."""
    filters = filters or standard_filters()
    spark = docs.sparkSession
    parts = parts_for(text_bytes(docs, text), PART_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"), F.xxhash64(body).alias("fp"))
    ranged = rows.repartitionByRange(parts, "fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        if fails is not None:
            mask = mask + F.when(fails, 1 << i).otherwise(0)
    masked = ranged.withColumn("words", words_of(F.col("text"))).select("doc_id", "part", "text", "fp", mask.alias("mask"))
    judged = materialise(masked.mapInArrow(lean(_compare), "kind int, doc_id long, part string, mask int, copy boolean, sha binary"), "filter_masks")
    #: Two for each partition, but for texts whose fingerprints collide.
    firsts = judged.filter(f"kind = {_EDGE}").groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    copies = sum(1 << i for i, fails in enumerate(filters.values()) if fails is None)
    again = F.col("copy") | F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return judged.filter(f"kind = {_ROW}").join(F.broadcast(firsts), "sha", "left").select("doc_id", "part", F.when(again, F.col("mask") + copies).otherwise(F.col("mask")).alias("mask"))


def count_masks(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Counters of each part: n, n_good and n_toxic of every mask that occurs. Counters of several tables add up."""
    yes = lambda c: F.coalesce(F.max(F.col(c).cast("long") == 1), F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    named = masks.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    unnamed = masks.filter("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return named.unionByName(unnamed).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))


def _all_orders(letters: list[str]):
    """For each order and step: its name, step and filter, and 0/1 rows over all masks: kept, removed, redundant, unique."""
    masks = np.arange(1 << len(letters))
    names, steps, which, rows = [], [], [], []
    for order in itertools.permutations(range(len(letters))):
        before = np.zeros(len(masks), bool)
        for step, i in enumerate(order):
            fails = (masks >> i & 1).astype(bool)
            names.append("".join(letters[j] for j in order))
            steps.append(step + 1)
            which.append(i)
            rows.append((~(before | fails), fails & ~before, fails & before, masks == 1 << i))
            before |= fails
    kept, removed, redundant, unique = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    return names, np.array(steps, np.int32), np.array(which), kept, removed, redundant, unique


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None] | None = None, part: str = "lang", text: str = "text") -> DataFrame:
    """A row for each part, order of all filters (named by the letters) and step, zeros included: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley (the filter's removals summed over all orders)."""
    filters = filters or standard_filters()
    letters = list(filters)
    counted = count_masks(failure_masks(docs, filters, part, text), labels)
    each = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("counts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, steps, which, kept, removed, redundant, unique = _all_orders(letters)
        for frame in frames:
            for name, counts in zip(frame["part"], frame["counts"], strict=True):
                n = np.zeros((3, 1 << len(letters)), np.int64)
                for c in counts:
                    n[:, c["mask"]] = c["n"], c["n_good"], c["n_toxic"]
                gone = removed @ n[0]
                shapley = np.array([gone[which == i].sum() for i in range(len(letters))])
                yield pd.DataFrame({"part": name, "filter_order": names, "step": steps, "kept": kept @ n[0], "removed": gone, "redundant": redundant @ n[0], "unique_fails": unique @ n[0], "good_lost": removed @ n[1], "toxic_lost": removed @ n[2], "shapley": shapley[which]})

    counters = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return each.mapInPandas(run, f"part string, filter_order string, step int, {counters}")
