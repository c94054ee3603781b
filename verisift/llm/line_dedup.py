"""Line deduplication: lines that many documents share stay in one document and go from the others.

1. Every line of at least `least_chars` code points becomes a hash of 128 bits; a document sends one row for each
   distinct hash, with the line's places. Texts don't travel.
2. The rows are range-partitioned by (hash, document) and sorted within a partition, the document that keeps its lines
   first. A stream over a partition meets the keeper of a line as the first of its run, and drops the rest of the run
   once it has met `least_docs` documents; it holds fewer rows than that. A line that many documents share is spread
   over partitions, as the document is part of the range. Runs at a partition's edges are settled by summaries, of which
   a partition has two at most.
3. Dropped places become one compressed bitmap for each document that loses lines (bit set: the line stays).

A document is a row. Null texts are one empty line. Rows of equal doc_id each count as a document; all rows of the keeping
doc_id keep the line. A null doc_id counts as the smallest. A row's line verdicts depend on its doc_id and text only, so
rows equal in both share a bitmap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import discard, lean, materialise, parts_for

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Bytes of a row of (hash, document, places), about, and of a partition of them.
ROW_BYTES, PART_BYTES = 48, 64 << 20
#: Text bytes that a Python worker takes apart at a time.
PIECE_BYTES = 4 << 20
_NULL_ID = -(1 << 63)
_DROP, _OPEN, _EDGE = 0, 1, 2

_LINES = "h1 long, h2 long, doc long, text_hash long, places array<int>"
_JUDGED = "kind int, h1 long, h2 long, n long, doc long, text_hash long, places array<int>"


def line_key(line: bytes) -> bytes:
    """The line without blanks at both ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about PIECE_BYTES of a column each."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _hash_lines(least_chars: int):
    """A row for each document and distinct line hash."""
    types = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("places", pa.list_(pa.int32()))])

    def rows_of(digests: list[bytes], places: list[list[int]], docs: list[int], hashes: list[int]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        ends = np.cumsum([0, *map(len, places)], dtype=np.int32)
        flat = np.fromiter((p for of in places for p in of), np.int32, int(ends[-1]))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.ListArray.from_arrays(ends, flat)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole, 2)):
            digests, places, docs, hashes = [], [], [], []
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                at_of: dict[bytes, list[int]] = {}
                for at, line in enumerate((text.as_py() or b"").split(b"\n")):
                    if len(line) >= least_chars and _long_enough(key := line_key(line), least_chars):
                        at_of.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                digests += at_of
                places += at_of.values()
                docs += [doc] * len(at_of)
                hashes += [text_hash] * len(at_of)
            if digests:
                yield rows_of(digests, places, docs, hashes)

    return lean(run)


def _stream_runs(least_docs: int):
    """Verdicts on rows sorted by (hash, keeper first): dropped rows, rows left open at the edges, summaries of the edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = top = None  # of the run that is under way: its hash and the document that keeps the line
        seen, first, held = 0, True, None

        def rows(kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
            n = len(batch)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), batch.column(0), batch.column(1), pa.nulls(n, pa.int64()), *batch.columns[2:]], names=names)

        def edge() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_EDGE], pa.int32()), *(pa.array([x], pa.int64()) for x in (*key, seen, top)), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32()))], names=names)

        names = ["kind", "h1", "h2", "n", "doc", "text_hash", "places"]
        for batch in batches:
            if not len(batch):
                continue
            if held is not None and len(held):
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                seen -= len(held)
            held = None
            h1, h2, doc = (batch.column(i).to_numpy() for i in range(3))
            new = np.ones(len(batch), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = key != (h1[0], h2[0])
            starts = np.flatnonzero(new)
            begin = np.concatenate([[0], starts]) if not new[0] else starts
            end = np.append(begin[1:], len(batch))
            tops, counts = doc[begin].copy(), end - begin
            if not new[0]:
                if seen:
                    tops[0] = top
                counts[0] += seen
            elif key is not None and first:  # the partition's first run has ended
                yield edge()
                first = False
            if first and len(begin) > 1:  # it ends within this batch
                key, seen, top = (int(h1[0]), int(h2[0])), int(counts[0]), int(tops[0])
                yield edge()
                yield rows(_OPEN, batch.slice(0, int(end[0])))
                first, settled = False, int(end[0])
            elif first:
                yield rows(_OPEN, batch)
                settled = len(batch)
            else:
                settled = 0
            key, seen, top = (int(h1[-1]), int(h2[-1])), int(counts[-1]), int(tops[-1])
            drop = np.repeat(counts >= least_docs, end - begin) & (doc != np.repeat(tops, end - begin))
            drop[:settled] = False
            if drop.any():
                yield rows(_DROP, batch.filter(pa.array(drop)))
            if not first and seen < least_docs:
                held = batch.slice(int(begin[-1]))
        if key is not None:
            if held is not None:
                yield rows(_OPEN, held)
            yield edge()

    return lean(run)


def _pack_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the lines that stay, up to the last one dropped."""
    for batch in batches:
        keeps, n = [], []
        for of in batch.column(2):
            at = of.values.to_numpy()
            bits = np.ones((int(at.max()) // 8 + 1) * 8, bool)  # whole bytes
            bits[at] = False
            n.append(int(len(bits) - bits.sum()))
            keeps.append(zstandard.ZstdCompressor(level=3).compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keeps, pa.binary())], names=["doc", "text_hash", "n_dropped", "keep"])


def _keyed(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).cast("binary").alias("text"), *more)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, keeper: str = "largest", text: str = "text") -> DataFrame:
    """doc, text_hash, n_dropped and keep (compressed bitmap, see unpack_keep) of each document that loses lines.

    Lines found in at least `least_docs` documents stay in the one of the `keeper` ("largest" or "smallest") doc_id.
    Lines beyond a bitmap stay, and so do all lines of documents that have no bitmap. An empty table gives none. `doc` is
    the doc_id, or the smallest long in place of a null; `text_hash` is the xxhash64 of the text."""
    if keeper not in ("largest", "smallest") or least_docs < 2:
        raise ValueError("keeper is largest or smallest, least_docs at least 2")
    spark = docs.sparkSession
    lines = materialise(_keyed(docs, text).select("doc", "text_hash", "text").mapInArrow(_hash_lines(least_chars), _LINES), "lines")
    parts = parts_for(lines.count() * ROW_BYTES, PART_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("h1"), F.col("h2"), F.desc("doc") if keeper == "largest" else F.asc("doc"), F.col("text_hash")]
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("places")[0])
    judged = materialise(ranged.mapInArrow(_stream_runs(least_docs), _JUDGED), "line_runs")
    discard(lines)
    best = F.max("doc") if keeper == "largest" else F.min("doc")
    edges = judged.filter(f"kind = {_EDGE}").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), best.alias("top"))
    #: At most two summaries for each partition.
    late = judged.filter(f"kind = {_OPEN}").join(F.broadcast(edges), ["h1", "h2"]).filter((F.col("docs") >= least_docs) & (F.col("doc") != F.col("top")))
    columns = ["doc", "text_hash", "places"]
    dropped = judged.filter(f"kind = {_DROP}").select(columns).unionByName(late.select(columns))
    places = dropped.groupBy("doc", "text_hash").agg(F.flatten(F.collect_set("places")).alias("places"))
    return places.mapInArrow(lean(_pack_places), "doc long, text_hash long, n_dropped long, keep binary")


def unpack_keep(keep: bytes | None, n_lines: int) -> np.ndarray:
    """Whether each of n_lines lines stays."""
    stays = np.ones(n_lines, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(keep), np.uint8), bitorder="little")[:n_lines]
        stays[: len(bits)] = bits
    return stays


def _keep_lines(carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole, 1)):
            kept, n_lines, n_dropped = [], [], []
            for text, keep in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or b""
                n_lines.append(text.count(b"\n") + 1)
                if keep is not None:
                    stays = unpack_keep(keep, n_lines[-1])
                    text = b"\n".join(line for line, stay in zip(text.split(b"\n"), stays.tolist(), strict=True) if stay)
                    n_dropped.append(int(len(stays) - stays.sum()))
                else:
                    n_dropped.append(0)
                kept.append(text)
            made = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[3 : 3 + carried]], names=[f"c{i}" for i in range(4 + carried)])

    return lean(run)


def apply_bitmaps(docs: DataFrame, keeps: DataFrame, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the lines that stay, joined by line feeds) of every row of docs, and the
    `carry` columns, whatever their names."""
    carry = carry or []
    left = _keyed(docs, text, F.col("doc_id").cast("long").alias("id"), *[F.col(f"`{c}`").alias(f"carry{i}") for i, c in enumerate(carry)])
    #: Bitmaps have a bit for each line, so that those of a partition are far smaller than its texts: texts needn't be sorted.
    both = left.join(keeps.select("doc", "text_hash", "keep").hint("shuffle_hash"), ["doc", "text_hash"], "left").select("id", "text", "keep", *[f"carry{i}" for i in range(len(carry))])
    fields = ["doc_id long", "n_lines long", "n_dropped long", "kept string"]
    types = [f"c{i} {f.split()[1]}" for i, f in enumerate(fields)] + [f"c{i + 4} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    made = both.mapInArrow(_keep_lines(len(carry)), ", ".join(types))
    return made.select(*[F.col(f"c{i}").alias(f.split()[0]) for i, f in enumerate(fields)], *[F.col(f"c{i + 4}").alias(c) for i, c in enumerate(carry)])


def dedup_lines(docs: DataFrame, carry: list[str] | None = None, **options) -> DataFrame:
    """apply_bitmaps() with the bitmaps of docs itself; options as those of keep_bitmaps()."""
    return apply_bitmaps(docs, keep_bitmaps(docs, **options), carry, options.get("text", "text"))
