"""Ordered text levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordinal(value: Column, levels: Sequence[str]) -> Column:
    """Place of ``value`` in ``levels``; null stays null, an unknown level raises."""
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), value).cast("int") - 1
    bad = F.raise_error(F.concat(F.lit("unknown level: "), value.cast("string"))).cast("int")
    return F.when(value.isNull(), F.lit(None).cast("int")).when(place >= 0, place).otherwise(bad)
