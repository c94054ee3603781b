"""Small building blocks for column expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once per row even where a lambda names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strings(values: list[str]) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def spread(df: DataFrame) -> DataFrame:
    """A scan that is too small to give every core a split of its own, dealt out over the cores: a file of one row group is
    one task, however large. At most a split's bytes for each core are moved; larger scans, whose splits keep the cores busy,
    stay as they are. Sizes are those that the planner has anyway: no file is listed for this."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size <= cores * split else df


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a local master without one gets a temporary
    folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="verisift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: worked out once, however often it is used."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
