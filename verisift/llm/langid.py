"""Language identification by nearest centroids.

A text becomes a vector of hashed byte n-grams (1 to 3 bytes, A-Z lower-cased, ASCII signs and digits left out), weighted by log-scaled counts and
inverse document frequency and scaled to length one. Each language has several centroids from spherical k-means; the
centroid with the largest cosine wins. A text whose best cosine is below the limit of its language and length is marked
as rejected (too far from everything known), as is one without any letter. The limits come from texts, whole and cut
short, that the centroids measuring them were not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.llm.common import _LOWER, _SPACE, lean, text_blocks

DIM = 1 << 12
#: Labelled texts per language that the centroids are fitted on, at most (about: drawn by a hash of the row).
FIT_TEXTS = 600
CENTROIDS = 4
#: A limit is this share of this quantile of held-out cosines, over LEAST_COSINES of about the same length (if there are).
MARGIN, QUANTILE, LEAST_COSINES = 0.8, 0.01, 100
#: Words that held-out texts are cut to, besides whole texts; limits are kept by the binary logarithm of the n-gram count.
CUTS, LENGTHS = (1, 2, 4, 8, 16, 32, 64), 24
#: Bytes as they count: A-Z lower-cased, white space as one space, other ASCII signs and digits left out (0).
_SHOWN = np.where(np.arange(256) >= 128, _LOWER, 0).astype(np.uint8)
_SHOWN[97:123] = np.arange(97, 123)
_SHOWN[65:91] = np.arange(97, 123)
_SHOWN[_SPACE] = 32
_LETTER = regex.compile(r"\p{L}")


def count_vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts of each text: float32 rows of DIM."""
    n, d = len(offsets) - 1, _SHOWN[data]
    text = np.repeat(np.arange(n), np.diff(offsets))
    use = d != 0
    d, text = d[use], text[use]
    use = np.ones(len(d), bool)
    use[1:] = (d[1:] != 32) | (d[:-1] != 32)
    d, text = d[use].astype(np.uint32), text[use]
    out = np.zeros(n * DIM, np.float32)
    code = d.copy()
    for k in (1, 2, 3):
        if k > 1:
            if len(d) < k:
                break
            code = code[:-1] * np.uint32(257) + d[k - 1 :] + np.uint32(1)
        same = text[: len(code)] == text[k - 1 :]
        slot = (code * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(text[: len(code)][same] * DIM + slot[same], minlength=n * DIM).astype(np.float32)
    return out.reshape(n, DIM)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # DIM
    centroids: np.ndarray  # len(langs) * CENTROIDS rows of DIM, empty clusters are zero
    limits: np.ndarray  # a row for each language, a column for each length

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def best(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and cosine of each row."""
        cos = self.vectors(counts) @ self.centroids.T
        at = cos.argmax(axis=1) if cos.shape[1] else np.zeros(len(cos), int)
        return at // CENTROIDS, cos[np.arange(len(cos)), at] if cos.shape[1] else np.zeros(len(cos))


def _length(counts: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(counts.sum(axis=1), 1)), 0, LENGTHS - 1).astype(int)


def _k_means(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with farthest-first starts; k rows, zero rows where there are fewer distinct texts."""
    c = np.zeros((k, v.shape[1]), np.float32)
    c[0] = v.mean(axis=0)
    c[0] /= max(np.linalg.norm(c[0]), 1e-9)
    for j in range(1, k):
        near = (v @ c[:j].T).max(axis=1)
        c[j] = v[near.argmin()]
    for _ in range(8):
        at = (v @ c.T).argmax(axis=1)
        for j in range(k):
            m = v[at == j].sum(axis=0) if (at == j).any() else np.zeros(v.shape[1], np.float32)
            c[j] = m / max(np.linalg.norm(m), 1e-9)
    return c


def _learn(langs: list[str], names: np.ndarray, counts: np.ndarray) -> Model:
    model = Model(langs, np.log(1 + len(counts) / (1 + (counts > 0).sum(axis=0))).astype(np.float32), np.zeros((0, DIM), np.float32), np.zeros((len(langs), LENGTHS)))
    v = model.vectors(counts)
    model.centroids = np.concatenate([_k_means(v[names == x], CENTROIDS) if (names == x).any() else np.zeros((CENTROIDS, DIM), np.float32) for x in langs])
    return model


def _limits(langs: list[str], seen: list[tuple[str, int, float]]) -> np.ndarray:
    """Limit of each language and length from (language, length, cosine) of held-out texts; 0 for a language without any."""
    out = np.zeros((len(langs), LENGTHS))
    for i, lang in enumerate(langs):
        at, cos = (np.array([x[k] for x in seen if x[0] == lang]) for k in (1, 2))
        for j in range(LENGTHS if len(at) else 0):
            away = np.abs(at - j)
            near = away <= np.sort(away)[min(LEAST_COSINES, len(at)) - 1]
            out[i, j] = MARGIN * np.quantile(cos[near], QUANTILE)
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_TEXTS) -> Model:
    """Learn centroids from rows with a non-null language and text. At most about `per_language` whole texts of each
    language are gathered (as count vectors), drawn by a hash of the text, copies once; the bound is this parameter."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros((0, LENGTHS)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    drawn = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    drawn = drawn.dropDuplicates(["lang", "text"])  # copies of a drawn text are one
    drawn = drawn.withColumn("half", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2)).cast("int"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_blocks(batch.column(0)):
                c = count_vectors(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(c)), batch.column(2).slice(at, len(c)), pa.array([np.minimum(x, 65535).astype("<u2").tobytes() for x in c], pa.binary())], names=["lang", "half", "counts"])

    got = sorted((r["lang"], bytes(r["counts"]), r["half"]) for r in drawn.mapInArrow(lean(vectors), "lang string, half int, counts binary").collect())
    langs = sorted({x for x, _, _ in got})
    counts = np.array([np.frombuffer(b, "<u2") for _, b, _ in got], np.float32)
    names, half = np.array([x for x, _, _ in got]), np.array([x for _, _, x in got])
    others = [_learn(langs, names[half != h], counts[half != h]) for h in (0, 1)]  # what texts of half h are measured by

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, h, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 0)), strict=True):
                words = text.split()
                cut = [text, *[" ".join(words[:n]) for n in CUTS if n < len(words)]]
                for _, data, offsets in text_blocks(pa.array([x for x in cut if _LETTER.search(x)], pa.string())):
                    c = count_vectors(data, offsets)
                    told, cos = others[h].best(c)
                    right = told == langs.index(lang)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * int(right.sum()), pa.string()), pa.array(_length(c)[right], pa.int32()), pa.array(cos[right].astype(float))], names=["lang", "length", "cos"])

    model = _learn(langs, names, counts)
    model.limits = _limits(langs, [tuple(r) for r in drawn.mapInArrow(lean(measure), "lang string, length int, cos double").collect()])
    return model


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns with lang_pred, score (best cosine, 0 to 1) and rejected for every row; only the text is looked at.

    Null texts and texts without a letter get `und`, score 0 and are rejected; so does everything if nothing was
    learned. Texts that are too far from every centroid keep their nearest language and are marked as rejected. Repeated and null ids are rows of
    their own, an empty table gives no rows, and a kept column named like a result is a ValueError."""
    if taken := {"lang_pred", "score", "rejected"} & set(keep):
        raise ValueError(f"columns to keep have names of results: {sorted(taken)}")
    use = docs.select(F.col(text_col).cast("string").alias("__text"), *[docs[c] for c in keep])
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = T.StructType([*use.schema.fields[1:], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_blocks(batch.column(0)):
                n = len(offsets) - 1
                texts = batch.column(0).slice(at, n).to_pylist()
                letter = np.array([bool(t) and bool(_LETTER.search(t)) for t in texts], bool)
                counts = count_vectors(data, offsets)
                lang, cos = model.best(counts)
                cos = np.clip(cos.astype(float), 0, 1) * letter
                known = letter & (len(model.langs) > 0)
                limit = model.limits[lang, _length(counts)] if model.langs else 0.0
                made = [
                    pa.array([model.langs[i] if ok else "und" for i, ok in zip(lang, known, strict=True)], pa.string()),
                    pa.array(np.where(known, cos, 0.0)),
                    pa.array(~known | (cos < limit)),
                ]
                yield pa.RecordBatch.from_arrays([*[batch.column(i + 1).slice(at, n) for i in range(len(keep))], *made], names=[*keep, "lang_pred", "score", "rejected"])

    return use.mapInArrow(lean(run), schema)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def identify(docs: DataFrame, per_language: int = FIT_TEXTS) -> DataFrame:
    """Fit on documents outside the held-out fold and predict every document: doc_id, held_out, lang_pred, score, rejected."""
    marked = docs.select("doc_id", "text", "lang", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    return predict(marked, fit(marked.filter("NOT held_out"), per_language=per_language), ["doc_id", "held_out"])
