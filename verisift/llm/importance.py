"""Importance resampling towards a target distribution, over hashed n-gram counts.

1. Every text becomes a row of a sparse matrix of documents by buckets: counts of its runs of 1 to `longest` words, each in
   bucket crc32(run) mod `buckets`. The matrix is written once, as blocks in compressed sparse row form.
2. Column sums of the matrices of the documents and of the target give both distributions, and a gain for each bucket.
3. A product of matrix and gains gives each document's weight; weights and noise that depends on the seed and the doc_id
   only give scores (Gumbel top-k, thus a draw without replacement).
4. The highest scores are ranked by a range sort: a row's rank is its place in its partition and the sizes of those before.

Words are ASCII digits and letters and all characters beyond ASCII, A-Z lower-cased. Null and empty texts have no
features and weight 0. A null doc_id has the noise of an empty id and comes last among equal scores; rows of equal
doc_id each take part, ties among them going by features and weight. An empty table gives no rows; an empty target counts
as zero in each bucket.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import lean, materialise, pack, parts_for, unpack

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Text bytes of a block of the matrix, about; longer texts are taken apart in pieces of as many. Distinct words kept at hand.
BLOCK_BYTES, LEXICON = 1 << 18, 1 << 19
#: Bytes of a row and of a partition in the range sort of scores, about.
ROW_BYTES, PART_BYTES = 64, 64 << 20

_BLOCKS = "doc_ids array<bigint>, n_words array<bigint>, starts binary, buckets binary, counts binary"

#: Bytes of words, A-Z lower-cased; all others become blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


class _Shift:
    """What n further bytes do to a CRC: crc(a + b) = shift(crc(a), len(b)) ^ crc(b). A table of four bytes' images per length."""

    LONGEST = 64

    def __init__(self):
        table, x = _crc_table(), np.arange(256, dtype=np.uint32)
        made = [np.stack([x << np.uint32(8 * i) for i in range(4)])]
        for _ in range(self.LONGEST):
            made.append((made[-1] >> np.uint32(8)) ^ table[made[-1] & np.uint32(255)])
        self.table = np.stack(made).reshape(-1)

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = n.astype(np.int64) * 1024
        parts = ((crc >> np.uint32(8 * i)) & np.uint32(255) for i in range(4))
        a, b, c, d = (self.table[at + 256 * i + p] for i, p in enumerate(parts))
        return a ^ b ^ c ^ d


class _Lexicon(dict):
    """Numbers of words, with the CRC of the word, of the word after a blank, and the word's length."""

    def __init__(self):
        self.crc, self.after, self.size = array("I"), array("I"), array("q")

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.crc)
        self.crc.append(zlib.crc32(word))
        self.after.append(zlib.crc32(b" " + word))
        self.size.append(len(word) + 1)
        return n


def _pieces(folded: bytes) -> Iterator[bytes]:
    """The text in pieces of about BLOCK_BYTES, cut at blanks."""
    at = 0
    while at < len(folded):
        to = len(folded)
        if at + BLOCK_BYTES < to:
            to = folded.rfind(b" ", at, at + BLOCK_BYTES)
            to = to if to > at else folded.find(b" ", at + BLOCK_BYTES)
            to = to if to > at else len(folded)
        yield folded[at:to]
        at = to


class FeatureCounter:
    """Buckets of the runs of 1 to `longest` words of a text."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest, self.shift, self.lexicon = buckets, longest, _Shift(), _Lexicon()

    def _crcs(self, words: list[bytes], fresh: int) -> Iterator[np.ndarray]:
        """CRCs of all runs that end in a word from number `fresh` on."""
        if len(self.lexicon) > LEXICON:
            self.lexicon = _Lexicon()
        lexicon = self.lexicon
        at = np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words))
        crc, after, size = (np.frombuffer(of, kind)[at] for of, kind in ((lexicon.crc, np.uint32), (lexicon.after, np.uint32), (lexicon.size, np.int64)))
        yield crc[fresh:]
        if size.size and size.max() > _Shift.LONGEST:  # words beyond the tables
            for n in range(2, self.longest + 1):
                yield np.array([zlib.crc32(b" ".join(words[i - n + 1 : i + 1])) for i in range(max(fresh, n - 1), len(words))], np.uint32)
            return
        run = crc
        for n in range(2, self.longest + 1):
            run = self.shift(run[:-1], size[n - 1 :]) ^ after[n - 1 :]
            yield run[max(0, fresh - n + 1) :]

    def count(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words, buckets in order, counts."""
        folded, n_words, before = text.translate(_FOLD), 0, []
        total = None  # dense counts of a long text
        found = np.zeros(0, np.uint32)
        for piece in _pieces(folded):
            words = before + piece.split()
            fresh = len(before)
            if len(words) == fresh:
                continue
            n_words += len(words) - fresh
            found = np.concatenate(list(self._crcs(words, fresh))) % np.uint32(self.buckets)
            before = words[len(words) - self.longest + 1 :] if self.longest > 1 else []
            if len(piece) < len(folded):
                total = np.bincount(found, minlength=self.buckets) + (0 if total is None else total)
        if total is None:
            at, n = np.unique(found, return_counts=True)
            return n_words, at, n
        at = np.flatnonzero(total)
        return n_words, at, total[at]


def _to_blocks(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = FeatureCounter(buckets, longest)

        def block(ids, words, at, n) -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, at)])
            cells = (pack(starts), pack(np.concatenate(at).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)), pack(np.concatenate(n).astype(np.int64 if max(map(len, n)) and max(int(x.max(initial=0)) for x in n) >= 1 << 31 else np.int32)))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), *(pa.array([c], pa.binary()) for c in cells)], names=["doc_ids", "n_words", "starts", "buckets", "counts"])

        held, size = ([], [], [], []), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                for x, y in zip(held, (doc_id, *counter.count(text)), strict=True):
                    x.append(y)
                size += len(text) + 64
                if size >= BLOCK_BYTES:
                    yield block(*held)
                    held, size = ([], [], [], []), 0
        if held[0]:
            yield block(*held)

    return lean(run)


def count_matrix(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The sparse count matrix of a table's texts, in blocks of rows, written to the shared folder: doc_ids, n_words, and
    the packed starts (of rows), buckets and counts; see matrix_rows()."""
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("binary"))
    return materialise(rows.mapInArrow(_to_blocks(buckets, longest), _BLOCKS), "csr_blocks")


def matrix_rows(starts: bytes, buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's arrays: row i has cells starts[i] to starts[i + 1] of buckets and counts."""
    return unpack(starts), unpack(buckets), unpack(counts).astype(np.int64)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Sums of all buckets. What comes to the driver is one number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(total, unpack(at), unpack(n).astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    sums = np.zeros(buckets, np.int64)
    for r in matrix.select("buckets", "counts").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[r["bucket"]] = r["n"]
    return sums


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the target's share over the source's, each smoothed by 1, rounded down."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(matrix: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                starts, at, n = matrix_rows(block["starts"], block["buckets"], block["counts"])
                sums, sizes = (np.concatenate([[0], np.cumsum(x)]) for x in (gains[at] * n, n))
                weight, size = (x[starts[1:]] - x[starts[:-1]] for x in (sums, sizes))
                weight = np.where(size > 0, weight // np.maximum(size, 1), 0)
                score = weight + np.array([_noise(seed, d) for d in block["doc_ids"]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block["doc_ids"], pa.int64()), pa.array(block["n_words"], pa.int64()), pa.array(size, pa.int64()), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return matrix.mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long, score long")


def rank_first(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """rows with `rank` 1, 2, 3... of the first `most` in an order; null for the others. No task sees all rows."""
    spark = rows.sparkSession
    parts = parts_for(rows.count() * ROW_BYTES, PART_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    #: The number that Spark gives holds the partition above 33 bits of the place within it.
    placed = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.cast("int").alias("part")).count().collect())  # a row for each partition
    before = [0, *itertools.accumulate(n for _, n in sizes)]
    offsets = spark.createDataFrame([(p, n) for (p, _), n in zip(sizes, before, strict=False)], "_part int, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("_part", part.cast("int")).join(F.broadcast(offsets), "_part", "left").select(*rows.columns, F.when(rank <= most, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, text: str = "text", target_key: str = "item_id") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document. Of those with at least `least_words` words, `percent`
    in a hundred are drawn (rounded down): those of the highest scores, ties to smaller doc_ids; only they have a rank."""
    matrix = count_matrix(docs, buckets, longest, text)
    gains = gains_of(column_sums(matrix, buckets), column_sums(count_matrix(target, buckets, longest, "text", target_key), buckets))
    scored = materialise(weigh(matrix, gains, seed), "scores")
    able = scored.filter(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranked = rank_first(able, order, percent * able.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    others = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(others)
