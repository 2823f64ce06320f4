"""Live lobby scoring when the settings of a lobby change."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import col, fingerprint
from ..operators.ranking import previous_value
from ..plans.joins import join_skewed
from .ingest import COMPACT_EVERY, batch_path
from .keyed import KeyedTable


def changed_lobbies(batch: DataFrame, last: DataFrame, settings: Sequence[str], lobby: str = "lobby", at: str = "at") -> DataFrame:
    """Rows whose settings differ from the lobby's row before.

    ``last`` holds ``lobby, at, state`` of earlier batches, of which the newest counts. Rows
    that repeat the previous settings are dropped, and so are late rows: those not after
    the newest row of their lobby in an earlier batch.
    """
    marked = batch.withColumn("state", fingerprint(settings))
    known = last.groupBy(col(lobby)).agg(F.max(col(at)).alias("_known_at"), F.max_by("state", F.struct(col(at), F.col("state"))).alias("last_state"))
    on_time = join_skewed(marked, known, [lobby], "left").where(F.col("_known_at").isNull() | (col(at) > F.col("_known_at")))
    seen = previous_value(on_time.drop("_known_at"), [lobby], [col(at), F.col("state")], F.col("state"), "_seen")
    return (
        seen.withColumn("_before", F.coalesce("_seen", "last_state"))
        .where(F.col("_before").isNull() | (F.col("_before") != F.col("state")))
        .drop("_before", "_seen", "last_state")
    )


def score_lobby_stream(
    stream: DataFrame,
    settings: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    table: str,
    state_table: str,
    checkpoint: str,
    lobby: str = "lobby",
    at: str = "at",
    buckets: int = 64,
) -> StreamingQuery:
    """Score changed lobbies with ``score`` and store the result per batch.

    The newest settings of each lobby are one row of a keyed table; a batch reads
    the buckets its lobbies fall into, and a repeated batch only what came before it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(col(lobby), col(at), fingerprint(settings).alias("state"))
        kept = KeyedTable(state_table, rows.schema, [lobby], [at], buckets)
        if batch_id and batch_id % COMPACT_EVERY == 0:
            kept.compact(spark, batch_id)
        last = kept.read(spark, batch_id, kept.touched(batch))
        changed = changed_lobbies(batch, last, settings, lobby, at)
        score(changed).write.mode("overwrite").parquet(batch_path(spark, table, batch_id))
        kept.write(rows, batch_id)

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
