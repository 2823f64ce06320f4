"""Ingest job: new match-list records, then details for matches without them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import col
from ..operators.clean import derive_ai_flags
from ..operators.columns import align_columns, append_rows
from ..operators.filters import eligible_matches
from ..operators.joins import fill_nested, join_one_to_one, new_matches, update
from ..operators.settings import INTEGER_COLUMNS, ONE_DECIMAL_COLUMNS, SPAWN_COLUMNS, TEXT_COLUMNS
from ..operators.tiers import fetch_queue

MONTH = "month"
#: Columns that keep the type they come with.
KEPT = ("id", "durationMs")


def append_root(root: DataFrame, listed: DataFrame, refresh: bool = False) -> DataFrame:
    """Root table after a batch of list records.

    Unseen ids are appended; with ``refresh`` known ids get new map names instead.
    """
    root, _ = align_columns(root, listed)
    if refresh:
        return update(root, listed.select("id", "Map Name"), ["id"])
    return append_rows(root, new_matches(listed, root))


def attach_details(root: DataFrame, details: DataFrame) -> DataFrame:
    """Eligible root rows with flags, joined one to one with the stored details."""
    flagged = derive_ai_flags(eligible_matches(root)).withColumnRenamed("AllyTeams", "AllyTeamsList")
    joined = join_one_to_one(flagged, details, ["id"])
    return update(joined, details.select("id", "Map Name"), ["id"])


def declared(df: DataFrame) -> DataFrame:
    """Raw values under the types of the stored table, the same for every batch and month.

    Texts are strings and all numbers outside of ids and times are doubles, which
    hold whole settings and fractions alike. A text that is no number
    raises. Narrow types and the turned spawn multipliers are made once, by
    ``cast_matches``, when the stored rows are published.
    """
    numbers = {*INTEGER_COLUMNS, *SPAWN_COLUMNS, *ONE_DECIMAL_COLUMNS} - {*TEXT_COLUMNS, *KEPT}
    changes = {}
    for field in df.schema.fields:
        if field.name in TEXT_COLUMNS:
            changes[field.name] = col(field.name).cast("string")
        elif field.name in numbers or (isinstance(field.dataType, T.NumericType) and field.name not in KEPT):
            changes[field.name] = col(field.name).cast("double")
    return df.withColumns(changes) if changes else df


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with the columns of all its months."""
    return spark.read.option("mergeSchema", True).parquet(path)


def apply_fetched(table: DataFrame, fetched: DataFrame) -> DataFrame:
    """Write fetched details into the table: nested parts where missing, raw settings where given."""
    table, typed = declared(table), declared(fetched).drop("startTime")
    filled = fill_nested(table, typed.select("id", "awards", "Map"))
    widened, _ = align_columns(filled, typed.drop("awards", "Map"))
    return update(widened, typed.drop("awards", "Map"), ["id"])


def pending(table: DataFrame, limit: int | None = None) -> DataFrame:
    return fetch_queue(table, limit)


def store_by_month(df: DataFrame, path: str, start: str = "startTime") -> None:
    """Write a table in month partitions, replacing only the months that ``df`` holds."""
    months = declared(df).withColumn(MONTH, F.date_format(col(start), "yyyy-MM"))
    months.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def touched_months(spark: SparkSession, path: str, ids: DataFrame) -> list[str]:
    """Months that hold any of ``ids``; one short text per month."""
    found = spark.read.parquet(path).select("id", MONTH).join(ids.select("id"), "id", "left_semi")
    return [r[0] for r in found.select(MONTH).distinct().collect()]


def merge_details(spark: SparkSession, path: str, fetched: DataFrame) -> Sequence[str]:
    """Apply fetched details to a stored table, rewriting only the months it touches.

    Running it again with the same details changes nothing.
    """
    months = touched_months(spark, path, fetched)
    if months:
        part = read_details(spark, path).where(F.col(MONTH).isin(months)).drop(MONTH)
        store_by_month(apply_fetched(part, fetched), path)
    return months
