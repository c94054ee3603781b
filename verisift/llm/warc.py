"""WARC archives: writing pages as request, response or revisit, and metadata records; reading and assembling captures.

Archives are written by Spark's own text writer (one line of output per page, "\\r\\n\\r\\n" after each record), so they
go wherever Spark can write; they are read back as binary files and cut into records by their Content-Length.
Request and metadata records name their capture with WARC-Concurrent-To; assemble() joins on it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages per archive file, and bytes, at most (unless one page has more): a file is read by one task.
RECORDS_PER_FILE, FILE_BYTES = 4000, 128 << 20
LEAST_SHARED = 100  # bytes a payload needs for a later copy to become a revisit
NO_PAGE = (1 << 63) - 1
#: Packed bytes that a decoder is given at a time.
SLICE = 4 << 10


def _uuid(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), key))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(*fields: tuple[str, Column | str], block: Column) -> Column:
    """A record without its closing blank lines; a header whose value is null is left out."""
    lines = [F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v, F.lit(CRLF)) for k, v in fields]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], size, block)


def _one_line(x: Column) -> Column:
    return F.regexp_replace(x, "[\\x00-\\x1F\\x7F]", " ")


def plan_records(pages: DataFrame) -> DataFrame:
    """Page rows with payload, digest, a row key and, for revisits, the page and row key of the response.

    Of rows with equal payloads of LEAST_SHARED bytes or more the smallest page_id (then the first row read) is the
    response; null page_ids count as largest. Smaller payloads are all responses. pages must read the same rows in the
    same order each time (files do), since row keys are numbered by position: repeated rows stay apart.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "size": F.octet_length("payload")})
    order = F.struct(F.coalesce("page_id", F.lit(NO_PAGE)).alias("p"), F.col("row").alias("r"))
    firsts = own.filter(F.col("size") >= LEAST_SHARED).groupBy(F.col("digest").alias("d")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    shared = firsts.filter("n > 1").select("d", "first")
    joined = own.join(shared, own["digest"] == shared["d"], "left")
    revisit = F.col("first").isNotNull() & (F.col("first.r") != F.col("row"))
    return joined.select("page_id", "url", "payload", "digest", "size", "row", F.when(revisit, F.col("first.r")).alias("of_row"), F.when(revisit & (F.col("first.p") != NO_PAGE), F.col("first.p")).alias("of_page"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", packed: bool = True) -> None:
    """Write WARC/1.1 files below path: for each page a response (or revisit), a request and a metadata record."""
    p = plan_records(pages)
    key = F.col("row").cast("string")
    url = F.coalesce(_one_line(F.col("url")), F.lit(""))
    main_id = _uuid("response", key)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("of_row").isNotNull()
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    main = _record(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", main_id),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, _uuid("response", F.col("of_row").cast("string")))),
        ("WARC-Refers-To-Page", F.when(revisit, F.coalesce(F.col("of_page").cast("string"), F.lit("")))),
        ("Content-Type", "application/http;msgtype=response"),
        block=F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    target = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    request = _record(
        ("WARC-Type", "request"),
        ("WARC-Record-ID", _uuid("request", key)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Concurrent-To", main_id),
        ("Content-Type", "application/http;msgtype=request"),
        block=F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)),
    )
    metadata = _record(
        ("WARC-Type", "metadata"),
        ("WARC-Record-ID", _uuid("metadata", key)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Concurrent-To", main_id),
        ("Content-Type", "application/warc-fields"),
        block=F.concat(F.lit("page-id: "), page, F.lit(CRLF)),
    )
    gap = F.lit(CRLF + CRLF)
    out = p.select(F.concat(main, gap, request, gap, metadata).alias("value"))
    longest = (pages.agg(F.max(F.octet_length("html")).alias("n")).first()["n"] or 0) + 4096
    writer = out.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", max(1, min(RECORDS_PER_FILE, FILE_BYTES // longest)))
    (writer.option("compression", "gzip") if packed else writer).text(path)


def unpacked(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive in pieces: of all gzip members, one after the other, if it is packed. Time is in proportion to
    the archive, however many members it has: a decoder is given slices, of which only what a member leaves is given again."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[at : at + step] for at in range(0, len(raw), step))
        return
    view, at, member = memoryview(raw), 0, None
    while at < len(view):
        data = view[at : at + SLICE]
        if member is None:
            zeros = len(data) - len(bytes(data).lstrip(b"\0"))  # they may fill up the end
            if zeros:
                at += zeros
                continue
            member = zlib.decompressobj(31)
        piece = member.decompress(data, step)
        at += len(data) - len(member.unused_data if member.eof else member.unconsumed_tail)
        if piece:
            yield piece
        if member.eof:
            member = None
    if member is not None:
        yield member.flush()
        if not member.eof:
            raise ValueError("a gzip member ends early")


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of one archive, given in pieces; no more than a record
    and a piece are held. What is no record, has no Content-Length or ends early is a ValueError."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while held.startswith(b"\r\n"):
            del held[:2]
        if len(held) < 3 and more():
            continue
        if not held:
            return
        while (head_end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a WARC header ends early")
        head = bytes(held[:head_end]).decode().split(CRLF)
        if not head[0].startswith("WARC/"):
            raise ValueError("no WARC record where one must begin")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        if not fields.get("content-length", "").isdigit():
            raise ValueError("a WARC record without a length")
        end = head_end + 4 + int(fields["content-length"])
        while len(held) < end:
            if not more():
                raise ValueError("a WARC block ends early")
        yield fields, bytes(held[head_end + 4 : end])
        del held[:end]


RECORD_SCHEMA = "record_id string, record_type string, concurrent_to string, target_uri string, date string, refers_to_id string, refers_to_page long, stated_digest string, payload_bytes long, payload_digest string, page_id long, payload string"


def read_records(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """One row per record. Payload size and digest of a response are measured from its bytes; those of a revisit come
    from its stored HTTP header and digest. payloads: also return the payload text. Packed archives may have any number of
    gzip members; one that is broken is a ValueError. A page-id that is no number is null. An archive is one binary value, so
    that one of 2 GB or more can't be read."""

    def number(x: str | None) -> int | None:
        return int(x) if x and x.strip().removeprefix("-").isdigit() else None

    def row(f: dict[str, str], block: bytes) -> tuple:
        kind = f["warc-type"]
        size = digest = page = text = None
        stated = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            size = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
            digest = stated
            if kind == "response":
                size, digest = len(body), hashlib.sha256(body).hexdigest()
                text = body.decode() if payloads else None
        elif kind == "metadata":
            page = number(block.decode().partition("page-id:")[2].split(CRLF)[0].strip())
        return (f["warc-record-id"], kind, f.get("warc-concurrent-to"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-refers-to"), number(f.get("warc-refers-to-page")), stated, size, digest, page, text)

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw, rows = data.as_py(), []
                for f, block in parse_records(unpacked(raw)):
                    rows.append(row(f, block))
                    if len(rows) == 500 or payloads:  # a batch with payloads is one record
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata records concurrent to it.

    Records meet on the record id of their response; a request or metadata record whose response is missing gives a
    row with a null response, a response without them null request and metadata."""
    key = F.coalesce("concurrent_to", "record_id")
    one = lambda *kinds: F.max(F.when(F.col("record_type").isin(*kinds), F.struct(*[c for c in records.columns if c != "concurrent_to"])))
    return records.groupBy(key.alias("capture_id")).agg(one("response", "revisit").alias("response"), one("request").alias("request"), one("metadata").alias("metadata"))


def captures(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write pages to archives below path, read them back and assemble the captures.

    A null html is an empty payload, a null url an empty target; an empty table writes no record and gives no row;
    columns beyond page_id, url and html are ignored."""
    write_archives(pages, path)
    return assemble(read_records(pages.sparkSession, path, **options))
