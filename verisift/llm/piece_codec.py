"""SentencePiece encoding and decoding with byte offsets.

The text is normalised by our own longest-prefix walk through the model's compiled character map, which records for
every byte of the normalised text where it came from; pieces are then found in the normalised text and projected
through that alignment to byte spans of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import lean, text_blocks

SPACE = "▁".encode()  # the visible stand-in for a space
_CACHE_WORDS = 150_000


class CharMap:
    """The compiled map: a double-array trie (32-bit units) over source bytes, then zero-ended replacement strings."""

    def __init__(self, blob: bytes):
        self.units, self.texts = np.zeros(0, np.uint32), b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest source that starts at `at`, and its replacement."""
        units, found = self.units, None
        if not len(units):
            return None
        step = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node = step(int(units[0]))
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            u = int(units[node])
            if (u & ((1 << 31) | 0xFF)) != data[i]:
                break
            node ^= step(u)
            if (u >> 8) & 1:
                value = int(units[node]) & ((1 << 31) - 1)
                found = (i + 1 - at, self.texts[value : self.texts.index(b"\0", value)])
        return found


class Numbered(dict):
    """Numbers keys in the order of their first look-up; new: those not yet dealt with."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class PieceCodec:
    """Encoder and decoder of one model. encode() gives ids and byte spans; equal to the library's own ids."""

    def __init__(self, model: str | bytes):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        raw = model if isinstance(model, bytes) else open(model, "rb").read()
        proto = pb.ModelProto()
        proto.ParseFromString(raw)
        self.spec = pb.NormalizerSpec()
        self.spec.CopyFrom(proto.normalizer_spec)
        self.suffix_space = proto.trainer_spec.treat_whitespace_as_suffix
        self.map = CharMap(self.spec.precompiled_charsmap)
        self.full = spm.SentencePieceProcessor(model_proto=raw)
        n = proto.normalizer_spec
        n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = b"", False, False, False
        self.bare = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
        pieces = [p.piece for p in proto.pieces]
        self.size = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = self.full.unk_id()
        own = [p.piece for p in proto.pieces if p.type in (1, 4)]
        #: No piece goes on with a space mark after another character, or holds a line end: such text can be cut there.
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in own) and proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback
        self.begin, self.end, self.pieces = self.full.bos_id(), self.full.eos_id(), pieces
        #: Stretches seen so far; the ids of stretch i are flat[edge[i]:edge[i + 1]].
        self.known = Numbered()
        self.flat, self.edge = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def normalise(self, text: str, align: bool = True) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes (and its end) the byte of the original it came from."""
        src, s = text.encode(), self.spec
        if not len(self.map.units) and not s.remove_extra_whitespaces and s.escape_whitespaces and not self.suffix_space:
            if not src:
                return "", np.zeros(1, np.int64)
            head = 3 * bool(s.add_dummy_prefix)
            normal = "▁" * bool(head) + text.replace(" ", "▁")
            if not align:
                return normal, np.zeros(0, np.int64)
            a = np.frombuffer(src, np.uint8)
            at = np.repeat(np.arange(len(a)), np.where(a == 32, 3, 1))
            return normal, np.concatenate([np.zeros(head, np.int64), at, [len(a)]])
        out, where, at = bytearray(), [], 0
        units: list[tuple[bytes, int]] = []
        while at < len(src):
            hit = self.map.longest(src, at)
            if hit is None:
                lead = src[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = (n, src[at : at + n])
            units.append((hit[1], at))
            at += hit[0]
        end = len(src)
        if s.remove_extra_whitespaces:
            while units and not units[0][0].strip(b" "):
                units.pop(0)
            while units and units[-1][0].endswith(b" "):
                end = units[-1][1]
                units[-1] = (units[-1][0].rstrip(b" "), end)
                if not units[-1][0]:
                    units.pop()
        mark = SPACE if s.escape_whitespaces else b" "
        if units and s.add_dummy_prefix and not self.suffix_space:
            out += mark
            where += [units[0][1]] * len(mark)
        gap = bool(s.remove_extra_whitespaces)
        for piece, at in units:
            if gap and s.remove_extra_whitespaces:
                piece = piece.lstrip(b" ")
            if piece:
                made = piece.replace(b" ", mark)
                out += made
                where += [at] * len(made)
                gap = piece.endswith(b" ")
        if units and s.add_dummy_prefix and self.suffix_space:
            out += mark
            where += [end] * len(mark)
        return out.decode(), np.array([*where, end], np.int64)

    def _stretches(self, normal: str) -> list[str]:
        """Normalised text cut before every run of space marks and around line ends."""
        if "▁▁" in normal or "\x01" in normal:
            return re.findall("▁+[^▁\n]*|[^▁\n]+|\n", normal)
        return normal.replace("\n", "\x01\n\x01").replace("▁", "\x01▁").split("\x01")

    def _find(self, normals: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts. A model whose pieces can't cross a space start is run once for each distinct stretch."""
        if not self.cuts:
            return [np.array(ids, np.int32) for ids in self.bare.encode(normals, num_threads=1)]
        parts = [self._stretches(x) for x in normals]
        if len(self.known) > _CACHE_WORDS:
            self.known, self.flat, self.edge = Numbered(), np.zeros(0, np.int32), np.zeros(1, np.int64)
        flat = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        if new := self.known.new:
            made = self.bare.encode(new, num_threads=1)
            self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(list(map(len, made)))])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), np.int32)])
            new.clear()
        first, size = self.edge[at], self.edge[at + 1] - self.edge[at]
        edge = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(first - edge[:-1], size) + np.arange(edge[-1])]
        return np.split(ids, edge[np.cumsum([len(x) for x in parts])[:-1]])

    def encode_many(self, texts: list[str | None], spans: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: ids with begin and end; for each id its byte span in the original (empty for begin and end)."""
        normals = [self.normalise(x or "", spans) for x in texts]
        return [self._project(t or "", *x, ids, spans) for t, x, ids in zip(texts, normals, self._find([x[0] for x in normals]), strict=True)] if texts else []

    def encode(self, text: str | None, spans: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_many([text], spans)[0]

    def _project(self, text: str, normal: str, where: np.ndarray, ids: np.ndarray, spans: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        all_ids = np.concatenate([[self.begin], ids, [self.end]]).astype(np.uint32)
        if not spans:
            return all_ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.size[ids]
        if (ids == self.unknown).any():  # an unknown stretch has no fixed size; the library says how much each piece covers
            size = np.array([len(p.surface.encode()) for p in self.bare.encode(normal, return_type="proto").pieces], np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        b, e = where[edge[:-1]], where[edge[1:]]
        n = len(text.encode())
        return all_ids, np.concatenate([[0], b, [n]]), np.concatenate([[0], e, [n]])

    def decode(self, ids: np.ndarray) -> str:
        return self.full.decode(ids.tolist())


SCHEMA = "doc_id long, n_tokens long, ids_le binary, span_begin_le binary, span_end_le binary, decoded string"


def encode_documents(docs: DataFrame, model_path: str, *, spans: bool = True, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ids (unsigned 32-bit little-endian), byte spans (signed 64-bit little-endian; empty unless
    asked for) and the decoded text. A null text counts as empty: begin and end only, decoded to ''. Rows aren't joined
    or grouped, so repeated and null ids, ties and extra columns make no difference; an empty table gives none.
    The model file is read once on the driver and shipped with the function.
    """
    blob = open(model_path, "rb").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(blob)
        for batch in batches:
            for at, _, offsets in text_blocks(batch.column(1)):
                rows = batch.slice(at, len(offsets) - 1)
                made = codec.encode_many(rows.column(1).to_pylist(), spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).cast(pa.int64()),
                        pa.array([len(m[0]) for m in made], pa.int64()),
                        pa.array([m[0].astype("<u4").tobytes() for m in made], pa.binary()),
                        pa.array([m[1].astype("<i8").tobytes() for m in made], pa.binary()),
                        pa.array([m[2].astype("<i8").tobytes() for m in made], pa.binary()),
                        pa.array([codec.decode(m[0]) for m in made], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_le", "span_begin_le", "span_end_le", "decoded"],
                )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), SCHEMA)


def spans_digest() -> Column:
    """SHA-256 of a row's span begins, followed by its span ends."""
    return F.sha2(F.concat("span_begin_le", "span_end_le"), 256)
