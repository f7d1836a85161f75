"""Tables that are rewritten by key: a change rewrites the buckets of its keys and no others.

A table lies in folders ``bucket=<hash of the key>``.  What changes is read from the touched folders only, and
written back over them by dynamic partition overwrite: new files are staged first and moved in when all
tasks have succeeded.  A job that is stopped between two folders and runs again ends in the same table, as
every change here can be applied twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .incremental import upsert as merged

BUCKETS = 32


def file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Keyed:
    """The table at ``path`` whose rows belong to ``key``; its columns are those of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType | str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; none where nothing was written yet."""
        place, system = file_system(self.spark, self.path)
        if not system.exists(place):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema]).add("bucket", "integer")).parquet(self.path)
        rows = rows if touched is None else rows.where(F.col("bucket").isin(touched))
        return rows.drop("bucket")

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def touched(self, *frames: DataFrame) -> list[int]:
        """Buckets of the keys of the frames; a number a bucket reaches the driver."""
        found: set[int] = set()
        for df in frames:
            found |= {r[0] for r in df.select(self.bucket()).distinct().collect()}
        return sorted(found)

    def put(self, rows: DataFrame, touched: list[int]) -> None:
        """``rows`` as all that the touched buckets hold."""
        if not touched:
            return
        dealt = rows.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition(len(touched), "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def upsert(self, batch: DataFrame, hashed: str, order: str | None = None) -> list[int]:
        """Rows of ``batch`` by hash and order, as ``incremental.upsert`` has it; the buckets that were rewritten."""
        batch = batch.where(F.col(self.key).isNotNull())
        touched = self.touched(batch)
        self.put(merged(self.read(touched), batch, self.key, hashed, order), touched)
        return touched

    def replace(self, rows: DataFrame, keys: DataFrame) -> list[int]:
        """All rows of ``keys`` (the key column) go, and ``rows`` come; a key may have many rows, or none any more."""
        keys = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        touched = self.touched(keys, rows)
        kept = self.read(touched).join(keys, self.key, "left_anti").select(*self.schema.names)
        self._swap(kept.unionByName(rows.select(*self.schema.names)), touched)
        return touched

    def remove(self, condition: Column) -> list[int]:
        """Rows that meet ``condition`` go; only buckets that had one are rewritten."""
        rows = self.read()
        touched = self.touched(rows.where(condition))
        self._swap(self.read(touched).where(~F.coalesce(condition, F.lit(False))), touched)
        return touched

    def _swap(self, rows: DataFrame, touched: list[int]) -> None:
        """As ``put``, where rows may also have gone: a bucket of which nothing is left loses its folder."""
        left = set(self.touched(rows))
        self.put(rows, [b for b in touched if b in left])
        for b in touched:
            if b not in left:
                place, system = file_system(self.spark, f"{self.path}/bucket={b}")
                system.delete(place, True)


def stream_upsert(stream: DataFrame, table: Keyed, hashed: str, order: str, checkpoint: str):
    """Apply a stream of rows to ``table`` until no input is left; returns the finished query.

    A row counts if its ``order`` is not below that of the row in the table, whatever batch it comes in, so a batch
    that runs again changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table.upsert(batch, hashed, order)

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
