"""Numbers and texts of settings as sparse cells: one row per key and column that is not zero.

No row grows with the number of categories, and no list of categories reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import col
from ..plans.joins import join_lookup
from .ranking import with_row_index


@dataclass(frozen=True)
class Scale:
    """Mean and population deviation of a column after its nulls took the mean."""

    mean: float
    spread: float


def fit_scales(df: DataFrame, numbers: Sequence[str]) -> dict[str, Scale]:
    """One aggregate over all columns; a column without values has mean 0, a constant one spread 0.

    A null that takes the mean adds nothing to the squares, so the deviation needs no second pass.
    """
    values = [col(c).cast("double") for c in numbers]
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(v).alias(f"{name}{i}") for i, v in enumerate(values) for name, f in (("m", F.avg), ("v", F.var_pop), ("c", F.count))],
    ).first()
    out = {}
    for i, name in enumerate(numbers):
        share = facts[f"c{i}"] / facts["n"] if facts["n"] else 0.0
        out[name] = Scale(facts[f"m{i}"] or 0.0, ((facts[f"v{i}"] or 0.0) * share) ** 0.5)
    return out


def scaled(name: str, scale: Scale) -> Column:
    """The column with nulls at the mean, centered, in deviations; a constant column is 0."""
    value = F.coalesce(col(name).cast("double"), F.lit(scale.mean)) - F.lit(scale.mean)
    return (value / F.lit(scale.spread or 1.0)) + F.lit(0.0)  # no negative zero


def number_cells(df: DataFrame, key: str, scales: dict[str, Scale]) -> DataFrame:
    """``key, column, value`` of the scaled numbers."""
    cells = [F.struct(F.lit(c).alias("column"), scaled(c, s).alias("value")) for c, s in scales.items()]
    return df.select(col(key), F.inline(F.array(*cells)))


def levels(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """The dictionary: ``column, level, index, common``; numbers from 0 per column by code point, ``common`` marks the mode.

    Levels are counted before they are numbered, and numbers come from range-sorted parts: a column
    with many millions of levels is spread over all tasks. Of equally frequent levels the smallest is the mode.
    """
    counted = text_rows(df, texts).where(F.col("level").isNotNull()).groupBy("column", "level").agg(F.count(F.lit(1)).alias("_n"))
    numbered = with_row_index(counted, [F.col("level").asc()], ["column"])
    best = numbered.groupBy("column").agg(F.min_by("level", F.struct(-F.col("_n"), "level")).alias("_best"))  # a row a column
    return numbered.join(F.broadcast(best), "column").select("column", "level", "index", (F.col("level") == F.col("_best")).alias("common"))


def text_rows(df: DataFrame, texts: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, column, level``: a row for each text column."""
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("level")) for c in texts]
    return df.select(*[col(k) for k in keys], F.inline(F.array(*cells)))


def level_cells(df: DataFrame, key: str, texts: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """``key, column, level, index, value``: the one 1 of each one-hot block.

    A null takes the column's mode. A text the dictionary does not hold has no row: its block is all zeros.
    """
    modes = dictionary.where("common").select("column", F.col("level").alias("_mode"))  # a row a column
    filled = text_rows(df, texts, [key]).join(F.broadcast(modes), "column", "left").withColumn("level", F.coalesce("level", "_mode")).drop("_mode")
    numbers = dictionary.select("column", "level", "index")
    return join_lookup(filled, numbers, ["column", "level"], "inner").select(
        col(key), "column", "level", "index", F.lit(1.0).alias("value")
    )


def components(df: DataFrame, scales: dict[str, Scale]) -> tuple[np.ndarray, np.ndarray]:
    """Variances (falling) and loadings (a row a component) of the scaled numbers.

    All products are summed in one aggregate; the driver gets a number per pair of
    columns. The largest loading of a component (the first of equals) is positive,
    so that a component is the same in every run.
    """
    names = list(scales)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    means = df.agg(*[F.avg(scaled(names[i], scales[names[i]]) * scaled(names[j], scales[names[j]])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    matrix = np.zeros((len(names), len(names)))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = means[f"p{i}_{j}"] or 0.0
    variance, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-variance, kind="stable")
    loadings = vectors.T[order]
    size = np.abs(loadings)
    lead = (size >= size.max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)
    return variance[order], loadings * np.where(loadings[np.arange(len(names)), lead] < 0, -1.0, 1.0)[:, None]


def rotated_cells(df: DataFrame, key: str, scales: dict[str, Scale], loadings: np.ndarray) -> DataFrame:
    """``key, column, value`` with a column ``PC1``, ``PC2``, ... per component."""
    cells = []
    for place, row in enumerate(loadings.tolist(), 1):
        parts = [scaled(c, s) * F.lit(w) for (c, s), w in zip(scales.items(), row, strict=True)]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        cells.append(F.struct(F.lit(f"PC{place}").alias("column"), total.alias("value")))
    return df.select(col(key), F.inline(F.array(*cells)))
