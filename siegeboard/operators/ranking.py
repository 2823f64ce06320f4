"""Ranks, row numbers and ratings without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import col
from ..plans.joins import join_lookup
from ..session import materialize


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], amount: Column, out: str
) -> DataFrame:
    """Sum of ``amount`` over the rows before each row of its ``by`` group.

    Rows are range-sorted over all tasks and stored; each task's range is
    summed on its own, and the totals of the ranges (one row per range and
    group) give the offsets. ``order`` must be total within a group.
    """
    keys = [col(b) for b in by]
    ranged = (
        df.withColumn("_amount", amount)
        .repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    stored = materialize(ranged)
    inside = W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = stored.groupBy("_range", *keys).agg(F.sum("_amount").alias("_total"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    return (
        stored.withColumn(out, F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .join(offsets, ["_range", *by])
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop("_range", "_amount", "_offset")
    )


def previous_value(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """``value`` of the row before within ``by``, null for the first row.

    Rows are range-sorted over all tasks and stored; inside a range the row before
    is near, and the first row of a range takes the last value of the range
    before. A key with a third of all rows is spread over many ranges. ``order`` must
    be total within a group and ``value`` not null.
    """
    keys = [col(b) for b in by]
    ranged = (
        df.withColumn("_value", value)
        .repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = materialize(ranged)
    inside = W.partitionBy("_range", *keys).orderBy("_place")
    ends = stored.groupBy("_range", *keys).agg(F.max_by("_value", "_place").alias("_last"))
    before = W.partitionBy(*keys).orderBy("_range")
    carried = ends.withColumn("_carried", F.lag("_last").over(before)).drop("_last")
    return (
        stored.withColumn(out, F.lag("_value").over(inside))
        .join(carried, ["_range", *by])
        .withColumn(out, F.coalesce(out, "_carried"))
        .drop("_range", "_place", "_value", "_carried")
    )


def with_row_index(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "index"
) -> DataFrame:
    """Zero-based row number in ``order`` within ``by``; ``order`` must be total."""
    return running_total(df, by, order, F.lit(1).cast("long"), name)


def average_ranks(
    df: DataFrame, key: Sequence[str], columns: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Rank of each value among its ``by`` group, ties sharing their mean place.

    ``columns`` maps a source column to its rank column. Values are counted
    first, so a value held by a third of the rows is one row afterwards; ranks
    come from running totals over distinct values. Nulls get no rank.
    """
    names = list(columns)
    keep = [*by, *key]
    packed = F.array(
        *[
            F.struct(F.lit(i).alias("metric"), col(c).cast("double").alias("value"))
            for i, c in enumerate(names)
        ]
    )
    long = df.select(*[col(k) for k in keep], F.inline(packed)).where(F.col("value").isNotNull())
    counted = long.groupBy(*by, "metric", "value").agg(F.count(F.lit(1)).alias("held"))
    before = running_total(counted, [*by, "metric"], [F.col("value")], F.col("held"), "before")
    places = before.select(
        *[col(b) for b in by], "metric", "value", (F.col("before") + (F.col("held") + 1) / 2).alias("place")
    )
    ranked = join_lookup(long, places, [*by, "metric", "value"], "inner")
    wide = ranked.groupBy(*[col(k) for k in keep]).agg(
        *[F.max(F.when(F.col("metric") == i, F.col("place"))).alias(columns[c]) for i, c in enumerate(names)]
    )
    return df.join(wide, keep, "left")


# Weight of each rank in the combined rank.
RANK_WEIGHTS = {
    "Weighted Award Rate Rank": 1.0,
    "Difficulty Losers Sum Rank": 0.4,
    "Difficulty Score Rank": 0.25,
    "Setting Combinations Rank": 0.01,
    "#Games Rank": 0.5,
    "Win Rate Rank": 0.005,
}


def weighted_sum(weights: Mapping[str, float]) -> Column:
    parts = [col(c) * F.lit(w) for c, w in weights.items()]
    return sum(parts[1:], parts[0])


def combined_rank(
    df: DataFrame, key: Sequence[str], by: Sequence[str], weights: Mapping[str, float] = RANK_WEIGHTS
) -> DataFrame:
    """Rank of the weighted sum of ranks; all ranks are then cut to whole numbers."""
    blended = df.withColumn("_blend", weighted_sum(weights))
    ranked = average_ranks(blended, key, {"_blend": "Combined Rank"}, by).drop("_blend")
    whole = {c: col(c).cast("int") for c in [*weights, "Combined Rank"]}
    return ranked.withColumns(whole)


def min_max_rating(df: DataFrame, by: Sequence[str], source: str, out: str, top: float = 30.0) -> DataFrame:
    """``source`` stretched to 0..``top`` per group, 2 decimals; null for a single value."""
    ends = df.groupBy(*[col(b) for b in by]).agg(F.min(col(source)).alias("_low"), F.max(col(source)).alias("_high"))
    spread = F.try_divide((col(source) - F.col("_low")).cast("double"), (F.col("_high") - F.col("_low")).cast("double"))
    joined = join_lookup(df, ends, list(by), "left")
    return joined.withColumn(out, F.round(spread * top, 2).cast("float")).drop("_low", "_high")


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key; Spark trims to ``k`` per task before the shuffle."""
    place = W.partitionBy(*[col(c) for c in keys]).orderBy(*order)
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


#: Values that a task of ``smallest_per`` holds before it drops all but the smallest of each key.
HELD_VALUES = 1 << 20


def _smallest(columns: Sequence[np.ndarray], k: int) -> list[np.ndarray]:
    """The ``k`` smallest different values (last column) of each key (the columns before)."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    columns = [c[fresh] for c in columns]
    first = np.ones(len(columns[0]), dtype=bool)
    first[1:] = np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)
    at = np.arange(len(first))
    kept = at - np.maximum.accumulate(np.where(first, at, 0)) < k
    return [c[kept] for c in columns]


def smallest_per(df: DataFrame, keys: Sequence[str], lists: str, k: int, held: int = HELD_VALUES) -> DataFrame:
    """The ``k`` smallest different values in the lists of each key as rows ``keys``, ``value``; keys and values are bigint, not null.

    Rows are dealt by the last key. Every task first drops what is not among the smallest that it has met for the key, so that hardly more than
    ``k`` values a key and task are shuffled. A task holds at most about ``held`` values; if dropping does not
    help, it hands on what it has and goes on.
    """
    names = [*keys, "value"]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            listed = batch.column(lists)
            times = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = listed.flatten().to_numpy(zero_copy_only=False)
            parts.append([*[np.repeat(batch.column(c).to_numpy(zero_copy_only=False), times) for c in keys], values])
            size += len(values)
            if size >= held:
                columns = _smallest([np.concatenate(c) for c in zip(*parts, strict=True)], k)
                parts, size = [columns], len(columns[0])
                if 2 * size >= held:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
                    parts, size = [], 0
        if size:
            columns = _smallest([np.concatenate(c) for c in zip(*parts, strict=True)], k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    dropped = df.select(*keys, lists).mapInArrow(drop, ", ".join(f"{c} bigint" for c in names)).repartition(keys[-1]).distinct()
    return top_k_per(dropped, keys, [F.col("value").asc()], k).drop("place")


def games_label(n_games: Column, cap: int = 20) -> Column:
    return F.when(n_games > cap, F.lit(f">{cap}")).otherwise(F.least(n_games, F.lit(cap)).cast("string"))
