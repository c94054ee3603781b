"""A keyed table on files that is kept up to date: writes rewrite only the key buckets they touch.

Rows lie in folders by a hash of the key. A change reads the buckets it touches, writes their new rows to the shared folder
and then overwrites just these partitions, which Spark commits once all tasks have ended. The same change can be made
again without harm. One change at a time: there is no lock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions.common import written
from verisift.operators import tables

#: Folders of a table: at most so many are named on the driver.
BUCKETS = 64


class KeyedTable:
    """Rows by key: the latest write of a key counts (largest `at`, then `tie`). Rows without a key are not kept."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key", at: str = "stored_at", tie: str = "seq", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.at, self.tie, self.buckets = spark, path, key, at, tie, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.names = self.schema.names

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def rows(self, touched: list[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets: others are not read."""
        if not self._there():
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)
        read = read if touched is None else read.filter(F.col("bucket").isin(touched))
        return read.filter(F.col(self.key).isNotNull()).select(*self.names)

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _touched(self, keys: DataFrame, key: str) -> list[int]:
        return [r[0] for r in keys.filter(F.col(key).isNotNull()).select(self._bucket(key)).distinct().collect()]

    def _overwrite(self, rows: DataFrame, touched: list[int]) -> None:
        """Replace buckets. A row without a key marks each of them, so that an emptied one is replaced as well."""
        if not touched:
            return
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
        marks = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], "bucket")
        made = written(rows.select(*self.names, self._bucket(self.key).alias("bucket")).unionByName(marks), "merged")
        made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def put(self, writes: DataFrame) -> list[int]:
        """Insert or replace rows; gives the buckets that were rewritten. A write older than the row that is there is lost."""
        writes = writes.select(*self.names).filter(F.col(self.key).isNotNull())
        touched = self._touched(writes, self.key)
        self._overwrite(tables.cache_upsert(self.rows(touched).unionByName(writes), self.key, self.at, self.tie).select(*self.names), touched)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Remove the rows of some keys (a column of the key's name); only buckets that hold one are rewritten."""
        held = self.rows(self._touched(keys, self.key)).join(keys.select(self.key).distinct(), self.key, "left_semi")
        touched = self._touched(held, self.key)
        self._overwrite(tables.cache_delete(self.rows(touched), keys, self.key).select(*self.names), touched)
        return touched

    def _drop(self, gone: Column) -> list[int]:
        touched = self._touched(self.rows().filter(gone), self.key)
        self._overwrite(self.rows(touched).filter(~F.coalesce(gone, F.lit(False))), touched)
        return touched

    def purge(self, now: Column, expires: str = "expires_at") -> list[int]:
        """Remove rows that have expired."""
        return self._drop(F.col(expires) <= now)

    def retain(self, n: int) -> list[int]:
        """Keep the n newest rows (then the larger key): the n-th newest is found by a top-n, all before it go."""
        order = F.struct(self.at, self.key)
        edge = self.rows().select(order.alias("o")).orderBy(F.col("o").desc()).limit(n).agg(F.min("o").alias("o"), F.count("*").alias("n")).first()
        if edge["n"] < n:
            return []
        if n <= 0:
            return self._drop(F.lit(True))
        last = F.struct(F.lit(edge["o"][0]).cast(self.schema[self.at].dataType).alias(self.at), F.lit(edge["o"][1]).cast(self.schema[self.key].dataType).alias(self.key))
        return self._drop(order < last)

    def get(self, wanted: DataFrame, now: Column) -> DataFrame:
        """wanted (its key column) with the live row of each key, and hit; only the buckets of the keys are read."""
        return tables.cache_point_read(wanted, self.rows(self._touched(wanted, self.key)), now, self.key)

    def stats(self, now: Column) -> DataFrame:
        return tables.cache_stats(self.rows(), now)
