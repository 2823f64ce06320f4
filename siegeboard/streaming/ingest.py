"""Incremental ingest of landing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import new_matches
from ..sources.landing import MATCH_LIST_SCHEMA, root_rows
from .keyed import BATCH, STREAM, KeyedTable, exists, stream_id

#: Batches between two compactions of a key table.
COMPACT_EVERY = 64


def batch_path(spark: SparkSession, table: str, batch_id: int) -> str:
    """The part of a table that one batch of one stream owns."""
    return f"{table}/{STREAM}={stream_id(spark)}/{BATCH}={batch_id}"


def stored_rows(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """Rows of an ingested table, without what this or a later run of a batch wrote.

    ``before`` is the number of the batch at hand. Stream and batch are
    partitions, so a batch that runs again does not see its own first run.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    table = spark.read.parquet(path)
    if before is not None:
        own = (F.col(STREAM) == stream_id(spark)) & (F.col(BATCH) >= before)
        table = table.where(~own)
    return table.drop(STREAM, BATCH)


def key_table(table: str, schema: T.StructType, key: str, buckets: int = 64) -> KeyedTable:
    """The keys of an ingested table, in a folder beside it."""
    return KeyedTable(f"{table.rstrip('/')}_keys", T.StructType([schema[key]]), [key], buckets=buckets)


def append_new(table: str, key: str = "id", compact_every: int = COMPACT_EVERY, buckets: int = 64):
    """Batch handler that stores rows with unseen keys; a null key is never known.

    Each batch owns one partition and overwrites it, so a repeated batch leaves
    the table as it was. Known keys are read from the buckets of the batch's own
    keys. A fresh stream numbers the keys of the whole table anew, so that it
    relies on nothing a given-up stream may have left half done; later batches never
    read the table.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = key_table(table, batch.schema, key, buckets)
        fresh = batch_id == 0 or not exists(spark, keys.path)
        if fresh and (exists(spark, table) or exists(spark, keys.path)):
            keys.compact(spark, batch_id, stored_rows(spark, table, batch.schema, batch_id).select(key))
        elif not fresh and batch_id % compact_every == 0:
            keys.compact(spark, batch_id)
        known = keys.read(spark, batch_id, keys.touched(batch.select(key)))
        own = batch_path(spark, table, batch_id)
        new_matches(batch, known, key).write.mode("overwrite").parquet(own)
        keys.write(spark.read.schema(batch.schema).parquet(own).select(key), batch_id)

    return handle


def ingest_stream(
    spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Append unseen matches of a JSON landing folder to a table, then stop when caught up."""
    listed = (
        spark.readStream.schema(MATCH_LIST_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )
    return (
        root_rows(listed)
        .writeStream.foreachBatch(append_new(table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_rows(stream: DataFrame, table: str, checkpoint: str, key: str, buckets: int = 64) -> StreamingQuery:
    """The same append for any streaming rows with a key column."""
    return (
        stream.writeStream.foreachBatch(append_new(table, key, buckets=buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
