"""Packed archives of many members: linear time; fill, broken members and odd records."""

import time
import zlib

import pytest

from verisift.llm import warc


def member(data):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(i, size=40):
    block = (f"page-id: {i}\r\n".encode() + b"x" * size)[:size]
    return b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(block), block)


def test_time_grows_with_the_archive():
    took = []
    for n in (12_500, 50_000):
        raw = b"".join(member(record(i)) for i in range(n))
        began = time.time()
        assert sum(1 for _ in warc.parse_records(warc.unpacked(raw))) == n
        took.append(time.time() - began)
    assert took[1] < 10 and took[1] < 12 * max(took[0], 0.05)


def test_members_of_any_size():
    parts = [b"", b"a", b"b" * 5_000_000, b"", b"c" * 4096]
    packed = b"".join(map(member, parts))
    assert b"".join(warc.unpacked(packed)) == b"".join(parts) and b"".join(warc.unpacked(packed + bytes(10_000))) == b"".join(parts)
    assert max(map(len, warc.unpacked(packed, 1 << 16))) <= 1 << 16
    for broken in (packed[:-3], packed + b"x", member(b"a" * 100)[:20]):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.unpacked(broken))
    assert b"".join(warc.unpacked(b"plain")) == b"plain" and list(warc.unpacked(b"")) == []


def test_odd_records():
    for raw in (b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", b"WARC/1.1\r\nContent-Length: ten\r\n\r\n", b"HTTP/1.1\r\n\r\n", record(1)[:-30]):
        with pytest.raises(ValueError, match=r"."):
            list(warc.parse_records(iter([raw])))
    assert list(warc.parse_records(iter([]))) == []
