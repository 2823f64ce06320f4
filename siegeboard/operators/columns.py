"""Column management: casts, defaults, order, drift and selection."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import col
from .settings import TWEAK_COLUMNS


def cast_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    have = [c for c in columns if c in df.columns]
    return df.withColumns({c: col(c).cast("string") for c in have}) if have else df


INTEGER_LADDER = (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63))


def narrow_integers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast each column to the narrowest type that holds all its values.

    One pass finds the ends of all columns. Columns with fractions become
    double, columns with text that is no number stay as they are.
    """
    have = [c for c in columns if c in df.columns]
    if not have:
        return df
    checks = []
    for i, name in enumerate(have):
        text = col(name).cast("string")
        number = text.try_cast("double")
        whole = text.try_cast("decimal(38,6)")
        checks += [
            F.min(whole).alias(f"low{i}"),
            F.max(whole).alias(f"high{i}"),
            F.count_if(col(name).isNotNull() & number.isNull()).alias(f"bad{i}"),
            F.count_if(number != F.floor(number)).alias(f"part{i}"),
        ]
    seen = df.agg(*checks).first()
    casts = {}
    for i, name in enumerate(have):
        if seen[f"bad{i}"]:
            continue
        low, high = seen[f"low{i}"], seen[f"high{i}"]
        fits = [t for t, bits in INTEGER_LADDER if low is None or (-(2**bits) <= low and high < 2**bits)]
        target = "double" if seen[f"part{i}"] or not fits else fits[0]
        source = col(name).cast("string").cast("decimal(38,6)") if target != "double" else col(name).cast("string")
        casts[name] = source.cast(target)
    return df.withColumns(casts) if casts else df


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace nulls per column; columns that are not there are ignored."""
    have = {c: v for c, v in defaults.items() if c in df.columns}
    return df.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in have.items()}) if have else df


def schema_drift(df: DataFrame, known: Sequence[str], mode: str = "report") -> DataFrame:
    """Columns nobody has accounted for, as rows; ``mode='fail'`` raises instead."""
    unknown = sorted(set(df.columns) - set(known))
    if unknown and mode == "fail":
        raise ValueError(f"columns not accounted for: {unknown}")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(c, types[c]) for c in unknown]
    return df.sparkSession.createDataFrame(rows, "column string, type string")


def moved(columns: Sequence[str], position: int, name: str) -> list[str]:
    if name not in columns:
        return list(columns)
    rest = [c for c in columns if c != name]
    return [*rest[:position], name, *rest[position:]]


def reorder_column(df: DataFrame, position: int, name: str) -> DataFrame:
    return df.select(*[col(c) for c in moved(df.columns, position, name)])


def tweaks_in_order(columns: Sequence[str]) -> list[str]:
    """Tweak columns follow ``tweakunits`` in their fixed order."""
    if "tweakunits" not in columns:
        return list(columns)
    tail = [c for c in TWEAK_COLUMNS if c in columns]
    rest = [c for c in columns if c not in tail]
    before = [c for c in columns[: list(columns).index("tweakunits")] if c in rest]
    return [*before, *tail, *rest[len(before) :]]


def reorder_tweaks(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in tweaks_in_order(df.columns)])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold only nulls or empty texts; one aggregate for all."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}

    def held(name: str):
        value = F.nullif(col(name), F.lit("")) if name in texts else col(name)
        return F.count(value)

    seen = df.agg(*[held(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if seen[f"c{i}"]]
    return df.select(*[col(c) for c in keep])


def drop_constant_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, object]]:
    """Drop columns with one distinct value (null counts as a value).

    Also returns the dropped values, without empty tweaks and multipliers of 1.
    """
    have = [c for c in columns if c in df.columns]
    if not have:
        return df, {}
    checks = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(have):
        checks += [
            F.min(col(name)).alias(f"low{i}"),
            F.max(col(name)).alias(f"high{i}"),
            F.count(col(name)).alias(f"held{i}"),
        ]
    seen = df.agg(*checks).first()
    constant = {
        c: seen[f"low{i}"]
        for i, c in enumerate(have)
        if seen[f"held{i}"] == 0 or (seen[f"held{i}"] == seen["n"] and seen[f"low{i}"] == seen[f"high{i}"])
    }
    told = {
        c: v
        for c, v in constant.items()
        if not ("tweak" in c and v == "") and not ("multiplier_" in c and v == 1)
    }
    return df.select(*[col(c) for c in df.columns if c not in constant]), told


def align_columns(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give both sides all columns of either, missing ones as null."""
    kinds = {f.name: f.dataType for df in (right, left) for f in df.schema.fields}
    order = [*left.columns, *[c for c in right.columns if c not in left.columns]]

    def widened(df: DataFrame) -> DataFrame:
        return df.select(
            *[col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in order]
        )

    return widened(left), widened(right)


def select_like(
    df: DataFrame, pattern: str | None = None, kind: str | None = None, drop: bool = False
) -> DataFrame:
    """Keep (or drop) columns whose name has ``pattern`` or whose type is ``kind``.

    ``kind`` is ``string`` or ``numeric``.
    """

    def picked(field: T.StructField) -> bool:
        if pattern is not None and not re.search(pattern, field.name):
            return False
        if kind == "string":
            return isinstance(field.dataType, T.StringType)
        if kind == "numeric":
            return isinstance(field.dataType, T.NumericType)
        return True

    keep = [f.name for f in df.schema.fields if picked(f) != drop]
    return df.select(*[col(c) for c in keep])


def unnest(df: DataFrame, column: str) -> DataFrame:
    """Replace a struct column by its fields."""
    rest = [col(c) for c in df.columns if c != column]
    return df.select(*rest, F.col(f"`{column}`.*"))


def append_rows(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Vertical append by name; numbers widen to the wider type of the two."""
    return table.unionByName(batch.select(*[col(c) for c in table.columns]))


def diagonal_union(*frames: DataFrame) -> DataFrame:
    """Union over all columns of all frames, missing ones null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
