"""One row per key over the batches of a stream, kept in buckets of keys.

A batch reads the buckets its own keys fall into, not all history. Rows are
folders of stream, batch and bucket, so Spark prunes by bucket before it reads, a
repeated batch overwrites what it wrote, and no key is bound to one task as it
would be in keyed operator state, where a key with a third of all rows is one group.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import col

STREAM, BATCH, BUCKET = "ingest_stream", "ingest_batch", "key_bucket"


def stream_id(spark: SparkSession) -> str:
    """Id of the running stream; it lives in the stream's checkpoint and survives restarts."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def folder(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = folder(spark, path)
    return files.exists(where)


class KeyedTable:
    """Rows of ``schema`` keyed by ``keys`` below ``path``; one stream writes at a time.

    ``newest`` orders rows of one key: only the last stays when the table is
    compacted. Without it rows of a key are alike and one of them stays.
    """

    def __init__(self, path: str, schema: T.StructType, keys: Sequence[str], newest: Sequence[str] = (), buckets: int = 64):
        self.path, self.schema, self.keys = path, schema, list(keys)
        self.newest, self.buckets = list(newest), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of the keys of a batch: at most ``buckets`` numbers."""
        return sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())

    def _all(self, spark: SparkSession, before: int | None) -> DataFrame:
        marks = [T.StructField(STREAM, T.StringType()), T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())]
        fields = [*self.schema.fields, *marks]
        if not exists(spark, self.path):
            return spark.createDataFrame([], T.StructType(fields))
        rows = spark.read.schema(T.StructType(fields)).parquet(self.path)
        if before is None:
            return rows
        return rows.where(~((F.col(STREAM) == F.lit(stream_id(spark))) & (F.col(BATCH) >= before)))

    def read(self, spark: SparkSession, before: int | None = None, touched: Sequence[int] | None = None) -> DataFrame:
        """One row per key, as known before a batch; only the buckets in ``touched`` are read."""
        rows = self._all(spark, before)
        if touched is not None:
            rows = rows.where(F.col(BUCKET).isin([int(b) for b in touched]))
        return self.latest(rows.drop(BUCKET, STREAM, BATCH))

    def latest(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key, by a partial aggregate before its shuffle."""
        rest = [c for c in self.schema.names if c not in self.keys]
        if not rest:
            return rows.select(*[col(c) for c in self.schema.names]).distinct()
        order = F.struct(*[col(c) for c in [*self.newest, *[c for c in rest if c not in self.newest]]])
        picked = rows.groupBy(*[col(k) for k in self.keys]).agg(F.max_by(F.struct(*[col(c) for c in rest]), order).alias("_row"))
        return picked.select(*[col(c) if c in self.keys else F.col("_row").getField(c).alias(c) for c in self.schema.names])

    def _write(self, rows: DataFrame, stream: str, batch_id: int) -> None:
        marked = rows.select(*[col(c) for c in self.schema.names], self.bucket().alias(BUCKET))
        spread = marked.repartition(F.col(BUCKET))  # rows are one a key, so buckets are even
        spread.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{STREAM}={stream}/{BATCH}={batch_id}")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Store the keys of a batch; a repeated batch overwrites its own folders."""
        self._write(self.latest(rows), stream_id(rows.sparkSession), batch_id)

    def compact(self, spark: SparkSession, before: int, source: DataFrame | None = None) -> None:
        """Replace all that earlier batches wrote by one row per key, from ``source`` if given.

        The new folders are complete before the old ones go. After a failure in between
        both are there, which the readers fold to one row per key.
        """
        old = self._folders(spark)
        rows = self.latest(source.select(*[col(c) for c in self.schema.names])) if source is not None else self.read(spark, before)
        self._write(rows, f"compacted-{uuid.uuid4().hex}", 0)
        for place in old:
            where, files = folder(spark, place)
            files.delete(where, True)

    def _folders(self, spark: SparkSession) -> list[str]:
        """Names of all batch folders: metadata, as many as batches since the last compaction."""
        if not exists(spark, self.path):
            return []
        where, files = folder(spark, f"{self.path}/{STREAM}=*/{BATCH}=*")
        return [s.getPath().toString() for s in files.globStatus(where)]
