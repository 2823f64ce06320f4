"""Difficulty tiers and bounded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import col
from ..plans.joins import join_lookup


def tier_of(value: Column, low: Column, high: Column) -> Column:
    """Tiers of a difficulty as an array: hardest, easiest, or between.

    With one difficulty only, a row is both in ``unbeaten`` and in ``cheese``.
    """
    return F.array_compact(
        F.array(
            F.when(value == high, "unbeaten"),
            F.when((value > low) & (value < high), "regular"),
            F.when(value == low, "cheese"),
        )
    )


def with_ends(groups: DataFrame, by: Sequence[str], value: str = "Difficulty") -> DataFrame:
    """Add the smallest and largest value of each ``by`` group as ``low`` and ``high``."""
    sides = [F.min(col(value)).alias("low"), F.max(col(value)).alias("high")]
    if not by:
        ends = groups.agg(*sides).first()
        return groups.withColumns({name: F.lit(ends[name]).cast("float") for name in ("low", "high")})
    return join_lookup(groups, groups.groupBy(*[col(b) for b in by]).agg(*sides), list(by))


def tiered(groups: DataFrame, by: Sequence[str], value: str = "Difficulty", with_all: bool = False) -> DataFrame:
    """One row per group and tier it belongs to."""
    tiers = tier_of(col(value), F.col("low"), F.col("high"))
    tiers = F.concat(F.array(F.lit("all")), tiers) if with_all else tiers
    return with_ends(groups, by, value).withColumn("tier", F.explode(tiers)).drop("low", "high")


def link_tier(value: Column) -> Column:
    """Tier name used in links, by the fixed ends 0 and 1."""
    return F.when(value == 1, "unbeaten").when(value == 0, "easy").otherwise("regular")


def tiered_sample(groups: DataFrame, ties: Sequence[Column], hard: int, easy: int) -> DataFrame:
    """The ``hard`` most played unbeaten groups, all between, and the ``easy`` most played easiest."""
    d = F.col("Difficulty")
    most_played = [F.col("#Players").desc(), *ties]
    lowest = groups.agg(F.min("Difficulty")).first()[0]
    easiest = groups.where(d == F.lit(lowest).cast("float"))
    return (
        groups.where(d == 1).orderBy(*most_played).limit(hard)
        .unionByName(groups.where((d > 0) & (d < 1)))
        .unionByName(easiest.orderBy(*most_played).limit(easy))
    )


def fetch_queue(df: DataFrame, n: int | None = None, start: str = "startTime", key: str = "id") -> DataFrame:
    """Ids without fetched details, newest first; with ``n`` the newest ``n``."""
    waiting = df.where(F.col("fetch_success").isNull()).orderBy(col(start).desc(), col(key).desc())
    return (waiting if n is None else waiting.limit(n)).select(col(key))


def first_rows(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)
