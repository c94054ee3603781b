"""Encoded bodies, decoded while they are read: caps stop a decoder before what it makes is held."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a decoded body, times its size on the wire, and bytes from which that counts.
MOST_BYTES, MOST_RATIO, RATIO_FLOOR = 2 << 20, 200, 64 * 1024
KNOWN = {"gzip": 31, "x-gzip": 31, "deflate": 15}
TOO_MANY, TOO_DENSE = "response exceeded the maximum allowed size", "response expanded beyond the maximum allowed decompression ratio"
UNDECODED = "Content encoding %s is not supported; the body was left undecoded."
#: Bytes that a decoder is given, and makes, at a time. What follows a member within a slice is copied once for each member.
SLICE, STEP = 8 << 10, 64 << 10
_GZIP = b"\x1f\x8b"
#: Bytes of a column, about, that a worker takes out of a batch at a time.
HELD = 2 << 20


class TooLarge(Exception):
    pass


def inflate(slices: Iterator[bytes], window: int) -> Iterator[bytes]:
    """What a gzip or zlib stream holds, in pieces of at most STEP bytes; all members of a gzip stream one after another. What
    follows a zlib stream, or the members, is not read. A stream that ends early is an error."""
    decoder, ended, held = zlib.decompressobj(window), False, b""
    for data in slices:
        while data:
            if ended:  # between members: another one begins with two certain bytes
                held += data
                if len(held) < 2:
                    break
                if window != 31 or not held.startswith(_GZIP):
                    return
                decoder, ended, data, held = zlib.decompressobj(window), False, held, b""
            made = decoder.decompress(data, STEP)
            if made:
                yield made
            ended = decoder.eof
            data = decoder.unused_data if ended else decoder.unconsumed_tail
    while not ended:
        made = decoder.decompress(decoder.unconsumed_tail, STEP)
        if not made:
            break
        yield made
        ended = decoder.eof
    if not ended:
        raise zlib.error("unexpected end of file")


def decode(body: bytes, tokens: list[str], most: int = MOST_BYTES, ratio: int = MOST_RATIO, floor: int = RATIO_FLOOR, keep: bool = True) -> tuple[bytes | None, int]:
    """The body with its encodings undone from right to left, and its size. Raises TooLarge, as soon as more than `most` bytes
    are made, or more than `floor` and more than `ratio` for each byte read. keep: hold the body, not only count it."""
    read = 0

    def slices() -> Iterator[bytes]:
        nonlocal read
        view = memoryview(body)
        for at in range(0, len(view), SLICE):
            read = min(len(view), at + SLICE)
            yield bytes(view[at : at + SLICE])

    stream = slices()
    for token in reversed(tokens):
        stream = inflate(stream, KNOWN[token])
    size, pieces = 0, []
    for piece in stream:
        size += len(piece)
        if size > most:
            raise TooLarge(TOO_MANY)
        if size > floor and size > read * ratio:
            raise TooLarge(TOO_DENSE)
        if keep:
            pieces.append(piece)
    return (b"".join(pieces) if keep else None), size


def _outcome(raw: bytes | None, names: list[str] | None, most: int, ratio: int, floor: int) -> tuple[bytes | None, int | None, str | None, str | None]:
    """Body, bytes, code and message of decoded()."""
    names = [] if names is None else list(names)
    unknown = [t for t in names if t not in KNOWN]
    if raw is None:
        return None, 0, None, None
    try:
        made, size = decode(raw, [] if unknown else names, most, ratio, floor)
    except TooLarge as e:
        return None, None, "RESPONSE_TOO_LARGE", str(e)
    except zlib.error as e:
        return None, None, "UPSTREAM_HTTP_FAILURE", str(e)
    return (made, size, "UNSUPPORTED_CONTENT_ENCODING", UNDECODED % ", ".join(unknown)) if unknown else (made, size, None, None)


def decoded(body: Column, tokens: Column, most: int = MOST_BYTES, ratio: int = MOST_RATIO, floor: int = RATIO_FLOOR) -> Column:
    """Struct of body, bytes, code, message for a body on the wire and its encodings (wire.content_encodings).

    code is RESPONSE_TOO_LARGE, UPSTREAM_HTTP_FAILURE (a stream that can't be read) or, with the body as it came,
    UNSUPPORTED_CONTENT_ENCODING; null if all is well. A null body is null with 0 bytes, null tokens are none. A worker
    holds a whole batch of bodies, decoded; for tables of many or large ones there is decode_rows()."""

    @F.pandas_udf("body binary, bytes long, code string, message string")
    def run(bodies: pd.Series, encodings: pd.Series) -> pd.DataFrame:
        made = pd.DataFrame([_outcome(b, t, most, ratio, floor) for b, t in zip(bodies, encodings, strict=True)], columns=["body", "bytes", "code", "message"])
        return made.astype({"bytes": "Int64", "body": object, "code": object, "message": object})

    return run(body, tokens)


def slices(batch: pa.RecordBatch, column: str, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `held` bytes of a string or binary column, one row at least."""
    upto, at = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy(), 0
    while at < len(batch):
        to = max(at + 1, int(upto.searchsorted((upto[at - 1] if at else 0) + held, "right")))
        yield batch.slice(at, to - at)
        at = to


def decode_rows(rows: DataFrame, body: str, tokens: str, most: int = MOST_BYTES, ratio: int = MOST_RATIO, floor: int = RATIO_FLOOR) -> DataFrame:
    """rows without `body` and `tokens`, with body, bytes, code and message as decoded() has them. Beside a batch as it came, a
    worker holds HELD bytes of bodies and what they make, one body of at most `most` bytes at least."""
    kept = [f for f in rows.schema.fields if f.name not in (body, tokens)]
    given = rows.select(*[F.col(f"`{f.name}`") for f in kept], F.col(body).alias("__body"), F.col(tokens).alias("__tokens"))
    made = [("body", pa.binary()), ("bytes", pa.int64()), ("code", pa.string()), ("message", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__body"):
                found = [_outcome(b.as_py(), t.as_py(), most, ratio, floor) for b, t in zip(part.column("__body"), part.column("__tokens"), strict=True)]
                values = [pa.array([x[i] for x in found], kind) for i, (_, kind) in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *values], names=[*[f.name for f in kept], *[n for n, _ in made]])

    shape = T.StructType([*kept, *T.StructType.fromDDL("body binary, bytes long, code string, message string").fields])
    return given.mapInArrow(run, shape)


def encoder(token: str) -> Callable[[bytes], bytes]:
    """The encoder of a token, for tests and fixtures."""

    def run(data: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, KNOWN[token])
        return c.compress(data) + c.flush()

    return run
