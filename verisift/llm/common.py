"""Helpers shared by the training-data operators: shared tables, word hashing and packed integer lists."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="verisift-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files of a query go when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps don't depend on executors that made it.

    The shuffle files of the write are let go once it has ended, as nothing reads them again."""
    spark = df.sparkSession
    path, before = new_path(spark, tag), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialise() that nothing reads any more: all made from them has been written."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df, marked for broadcast if its `rows` rows (of a few longs each) are at most `limit`."""
    return F.broadcast(df) if rows <= limit else df


def let(value: Column, then) -> Column:
    """then(value) with the value worked out once, even where `then` names it inside a lambda."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    """Array of words; null and empty texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Total UTF-8 bytes of a text column (0 for an empty table)."""
    return docs.agg(F.sum(F.octet_length(col)).alias("n")).first()["n"] or 0


def parts_for(total_bytes: int, each: int, least: int) -> int:
    """Number of parts so that one holds about `each` bytes."""
    return max(least, -(-total_bytes // each))


def give_back() -> None:
    """Hand freed memory of this Python worker back to the system; an idle worker otherwise holds on to it."""
    import ctypes

    import pyarrow as pa

    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """A mapInArrow function that gives its memory back when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


# --- word hashing over raw UTF-8 bytes -------------------------------------------------------------------------

_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = int(base)
    if key not in _powers or len(_powers[key]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        a = np.full(size, base, np.uint64)
        a[0] = 1
        made = np.cumprod(a, dtype=np.uint64)
        if size > 1 << 21:
            return made[:n]
        _powers[key] = made
    return _powers[key][:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in concatenated texts; counts of words for each text. Words don't cross texts."""
    solid = ~_SPACE[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    start[cut] = solid[cut]
    end[cut - 1] = solid[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.diff(np.searchsorted(s, offsets))


def hash_words(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, len(data)), out=total[1:])
    return mix((total[e] - total[s]) * _power(_inverse(_P), len(data) + 1)[s] + (e - s).astype(np.uint64))


def hash_runs(g: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """A hash of every run of k consecutive word hashes: len(g) - k + 1 of them. second: another, independent one."""
    if len(g) < k:
        return np.zeros(0, np.uint64)
    base = _R if second else _Q
    g = mix(g + np.uint64(0x51ED270B)) if second else g
    total = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(g * _power(base, len(g)), out=total[1:])
    return mix((total[k:] - total[:-k]) * _power(_inverse(base), len(g) + 1)[: len(g) - k + 1])


def text_blocks(batch_col, limit: int = 1 << 18):
    """Cut an Arrow string column into blocks of about `limit` bytes: (first row, bytes as numpy, offsets). Nulls count as empty."""
    import pyarrow as pa

    col = batch_col.cast(pa.large_binary()).fill_null(b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


# --- packed lists ----------------------------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """Any integer array, little-endian, by byte planes, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.copy() if len(a) else np.zeros(0, np.uint8)
    return a.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:3].decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[3:]), np.uint8)
    return raw.reshape(kind.itemsize, -1).T.copy().view(kind).ravel() if len(raw) else np.zeros(0, kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted array of uint64 as packed differences."""
    d = np.diff(a, prepend=np.uint64(0)) if len(a) else a
    return pack(d.astype(np.uint32) if len(d) and d.max() < 1 << 32 else d)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b).astype(np.uint64), dtype=np.uint64)
