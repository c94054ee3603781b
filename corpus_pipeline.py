"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents; the last one
returns their tokens. run() writes each stage's result as Parquet to the shared folder and reads it for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm import decontam, jaccard_join, langid, piece_codec, substring_dedup
from verisift.llm.common import materialise
from verisift.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those without a letter, or too far from every learned language, go."""
    model = langid.fit(docs)
    numbered = docs.select(*[F.col(c).alias(c) for c in COLUMNS])
    return langid.predict(numbered, model, COLUMNS).filter("NOT rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8: the smallest doc_id."""
    return jaccard_join.keep_one(docs.select(*COLUMNS), 5, 80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of windows that occur elsewhere; n_chars follows. Texts that lose nothing stay as they are."""
    made = substring_dedup.remove_repeats(docs, carry=["lang", "source", "n_chars"], whole=True)
    changed = F.col("n_removed") > 0
    return made.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark table."""
    return decontam.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (unsigned 32-bit little-endian) and digests of ids, byte spans and decoded text."""
    made = piece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))
    return made.select("doc_id", "n_tokens", "ids_le", F.sha2("ids_le", 256).alias("ids_sha256"), piece_codec.spans_digest().alias("spans_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Language ID, among others, is learned; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
