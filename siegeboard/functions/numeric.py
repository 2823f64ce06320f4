"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least-squares quadratic through lobby size -> teammates
# (1, 1), (2, 4), (5, 11), (16, 40).
TEAMMATES_A = 0.010523765015405669
TEAMMATES_B = 2.4052341883892385
TEAMMATES_C = -1.1838543289368846

# Fixed value: the day after which stored spawn multipliers are no longer inverted.
SPAWN_CHANGE_DATE = "2024-06-05"


def quantize_1dp(value: Column) -> Column:
    """Round to one decimal and go on as double."""
    return value.cast("decimal(38,1)").cast("double")


def interpolate(value: Column, in_min: float, in_max: float, out_min: float, out_max: float) -> Column:
    """Linear map of ``value`` from the input to the output range, clamped to it."""
    held = F.greatest(F.lit(float(in_min)), F.least(value.cast("double"), F.lit(float(in_max))))
    return F.lit(float(out_min)) + (held - in_min) / float(in_max - in_min) * float(out_max - out_min)


def required_teammates(lobby_size: Column) -> Column:
    """Teammates that make a full completion for a lobby of this size."""
    n = lobby_size.cast("double")
    return F.greatest(F.lit(1.0), TEAMMATES_A * (n * n) + TEAMMATES_B * n + TEAMMATES_C)


def normalize_spawn_mult(value: Column, start: Column) -> Column:
    """Spawn multiplier in today's meaning: older matches stored the inverse.

    Missing counts as 1, and the inverse of 0 counts as 1.
    """
    known = F.coalesce(value.cast("double"), F.lit(1.0))
    inverse = F.coalesce(F.try_divide(F.lit(1.0), known), F.lit(1.0))
    recent = F.to_date(start) > F.lit(SPAWN_CHANGE_DATE).cast("date")
    return F.when(recent, known).otherwise(inverse)


def pack_label(difficulty: Column, index: Column) -> Column:
    """One integer label holding a difficulty with 8 decimals, made unique by an index."""
    return F.round(difficulty.cast("double") * 1e8, 0).cast("long") + index.cast("long")


def unpack_label(label: Column) -> Column:
    """Difficulty in percent from a packed label."""
    return label.cast("double") / 1e6


def f_score(correlation: Column, n: Column) -> Column:
    """Univariate regression F statistic of a correlation over ``n`` rows."""
    r2 = correlation * correlation
    return F.try_divide(r2, 1 - r2) * (n - 2)
