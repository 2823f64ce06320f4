"""Join plans that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import col
from ..session import store

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 2_000_000


def row_bytes(df: DataFrame) -> Column:
    """About the bytes a row takes: 8 for a plain value, the UTF-8 or binary length of a text, the JSON length of nested values."""
    total = F.lit(8 * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        value = col(field.name)
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
    return total


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows of at most ``max_bytes`` bytes together.

    Only the sizes of that many rows and one are gathered, never the rows themselves.
    """
    sizes = df.select(row_bytes(df).alias("size")).limit(max_rows + 1)
    found = sizes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= max_rows and found["bytes"] <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when it has been measured small, else as it is."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def join_skewed(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join whose hot keys are spread over several salts, on both sides.

    A key with more than ``hot_rows`` rows on a side has that side cut into
    ``ceil(rows / hot_rows)`` parts, and each part meets each part of the other side in a
    task of its own: a key that is hot on both sides becomes as many tasks as the product of its parts. The right
    side of a left or semi join stays whole, so that no left row is judged by a part
    of its partners. There can be at most ``rows / hot_rows`` such keys, so the table of them stays small; it is
    still only broadcast after a count. ``how`` is inner, left or left_semi.
    """
    on = list(on)

    def hot_keys(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(*on).count().where(F.col("count") > hot_rows)
        return counts.select(*on, F.ceil(F.col("count") / hot_rows).cast("int").alias(name))

    hot = hot_keys(left, "_cuts_l")
    if how == "inner":
        hot = hot.join(hot_keys(right, "_cuts_r"), on, "full")
    else:
        hot = hot.withColumn("_cuts_r", F.lit(1))
    hot = store(hot)
    if hot.isEmpty():
        return left.join(right, on, how)
    hot_side = broadcast_if_small(hot)

    def salted(df: DataFrame, own: str, other: str, salt: str, copies: str) -> DataFrame:
        spread = F.xxhash64(*([c for c in df.columns if c not in on] or on))
        cuts = [F.coalesce(c, F.lit(1)) for c in (own, other)]
        placed = df.join(hot_side, on, "left").withColumn(salt, F.pmod(spread, cuts[0]).cast("int"))
        return placed.withColumn(copies, F.explode(F.sequence(F.lit(0), cuts[1] - 1))).drop("_cuts_l", "_cuts_r")

    salted_left = salted(left, "_cuts_l", "_cuts_r", "_salt_l", "_salt_r")
    salted_right = salted(right, "_cuts_r", "_cuts_l", "_salt_r", "_salt_l")
    return salted_left.join(salted_right, [*on, "_salt_l", "_salt_r"], how).drop("_salt_l", "_salt_r")


def join_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join to a lookup table: broadcast when measured small, else a salted shuffle."""
    if fits_broadcast(right, max_rows, max_bytes):
        return left.join(F.broadcast(right), list(on), how)
    return join_skewed(left, right, on, how, hot_rows)
