"""Counts that describe a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import matches as mx
from ..functions.keys import col


def _as_rows(values: dict[str, Column], df: DataFrame, name: str, value: str) -> DataFrame:
    """One aggregate over all columns, turned into one row per column."""
    wide = df.agg(*[v.cast("bigint").alias(f"v{i}") for i, v in enumerate(values.values())])
    packed = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(f"v{i}").alias(value)) for i, c in enumerate(values)]
    )
    return wide.select(F.inline(packed))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that hold nulls with the number of them."""
    names = columns or df.columns
    rows = _as_rows({c: F.count_if(col(c).isNull()) for c in names}, df, "setting", "value")
    return rows.where(F.col("value") > 0)


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of distinct values per column, null counted as a value.

    Values are counted as (column, value) pairs, so every column is spread over all tasks.
    """
    names = columns or df.columns
    packed = F.array(
        *[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in names]
    )
    pairs = df.select(F.inline(packed)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_rows"))
    return pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))


# Bytes of a value in memory.
FIXED_WIDTHS = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4, "bigint": 8, "double": 8, "timestamp": 8,
}


def column_sizes(df: DataFrame) -> DataFrame:
    """Bytes held per column, largest first: fixed widths, or the text length."""

    def width(field: T.StructField) -> Column:
        kind = field.dataType.simpleString()
        value = col(field.name)
        if kind in FIXED_WIDTHS:
            return F.count(value) * FIXED_WIDTHS[kind]
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.sum(F.octet_length(value)), F.lit(0))
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.sum(F.octet_length(F.to_json(value))), F.lit(0))
        return F.coalesce(F.sum(F.octet_length(value.cast("string"))), F.lit(0))

    rows = _as_rows({f.name: width(f) for f in df.schema.fields}, df, "column", "bytes")
    return rows.orderBy(F.desc("bytes"), "column")


def completeness(df: DataFrame) -> DataFrame:
    """Counters of missing awards, maps, map names and failed fetches, in one pass."""
    tests = {"matches": F.lit(True)}
    if "awards" in df.columns:
        tests["missing_awards"] = mx.first_award_value(F.col("awards")).isNull()
    if "Map" in df.columns:
        tests["missing_map"] = F.col("Map.scriptName").isNull()
    if "Map Name" in df.columns:
        tests["missing_map_name"] = col("Map Name").isNull()
    if "fetch_success" in df.columns:
        tests["failed_fetch"] = F.coalesce(~F.col("fetch_success"), F.lit(False))
        tests["unfetched"] = F.col("fetch_success").isNull()
    return count_tests(df, tests)


def count_tests(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


def last_player_win(df: DataFrame, start: str, ai_wins: dict[str, str]) -> DataFrame:
    """Latest start of a match the players won; ``ai_wins`` maps a flag to its win column."""
    won = F.lit(False)
    for flag, win in ai_wins.items():
        won = won | (col(flag) & ~col(win))
    return df.where(won).agg(F.max(col(start)).alias("last_player_win"))


def prefix_counts(df: DataFrame, name: str, separator: str = "_") -> DataFrame:
    """How many names share the part before the first separator."""
    return df.groupBy(F.split(col(name), separator).getItem(0).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
