"""Nearest groups through an index of cells, with proof that nothing nearer was left out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .ranking import top_k_per

SAMPLE_ROWS = 20_000
MAX_CELLS = 1024
FOUND = "query_id bigint, base_id bigint, distance double"


@dataclass
class CellIndex:
    """Base rows stored by cell, and per cell its center, radius and number of rows (at most ``MAX_CELLS`` each)."""

    rows: DataFrame
    centers: np.ndarray
    radius: np.ndarray
    counts: np.ndarray


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _gaps(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = points - q
    return np.einsum("ij,ij->i", gap, gap)


def build_cells(base: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> CellIndex:
    """Put every row of ``base`` (``base_id, vector``) into the cell of its nearest center; rows without a vector stay out.

    Centers are fitted on the ``sample_rows`` rows whose ids hash lowest; the number of cells is the square
    root of the number of rows, ``MAX_CELLS`` at most. Every row is indexed.
    """
    rows = base.where(F.col("vector").isNotNull()).select("base_id", F.col("vector").cast("array<double>").alias("vector"))
    total = rows.count()
    if not total:
        none = np.zeros((0, 0))
        return CellIndex(store(rows.withColumn("cell", F.lit(0))), none, np.zeros(0), np.zeros(0, np.int64))
    cells = max(1, min(cells or round(total**0.5), MAX_CELLS, total, sample_rows))
    if cells > 1:
        sample = rows.orderBy(F.xxhash64("base_id"), "base_id").limit(sample_rows)
        points = store(sample).select(array_to_vector("vector").alias("features"))
        centers = np.array(KMeans(k=cells, seed=seed, initMode="random", maxIter=10).fit(points).clusterCenters())
    else:
        centers = _matrix(pd.Series([rows.first()["vector"]]))
    sent = base.sparkSession.sparkContext.broadcast(centers)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["vector"])
            cell = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            gap = x - c[cell]
            yield pdf.assign(cell=cell.astype("int32"), gap=np.sqrt(np.einsum("ij,ij->i", gap, gap)))

    placed = store(rows.mapInPandas(place, "base_id bigint, vector array<double>, cell int, gap double"))
    facts = placed.groupBy("cell").agg(F.max("gap").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    radius, counts = np.zeros(len(centers)), np.zeros(len(centers), dtype=np.int64)
    for f in facts:
        radius[f["cell"]], counts[f["cell"]] = f["r"], f["n"]
    return CellIndex(placed.drop("gap"), centers, radius, counts)


def _first_cells(away: np.ndarray, counts: np.ndarray, k: int, probes: int) -> np.ndarray:
    """The nearest filled cells that hold ``k`` rows together, and at least ``probes`` of them."""
    order = np.argsort(away, kind="stable")
    order = order[counts[order] > 0]
    enough = int(np.searchsorted(np.cumsum(counts[order]), k)) + 1
    return order[: max(enough, probes)]


def visits(index: CellIndex, queries: DataFrame, k: int, probes: int = 1) -> DataFrame:
    """``query_id, vector, cell`` of the cells to be read.

    Without a column ``bound`` these are the first cells of each query. With it (squared distance of the
    k-th row found there) they are all others that may hold a row as near: a cell whose center is further than
    its radius and the bound together cannot, by the triangle inequality.
    """
    second = "bound" in queries.columns
    sent = queries.sparkSession.sparkContext.broadcast((index.centers, index.radius, index.counts))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers, radius, counts = sent.value
        for pdf in batches:
            ids, vectors, cells = [], [], []
            bounds = pdf["bound"] if second else [None] * len(pdf)
            for q, vector, bound in zip(pdf["query_id"], pdf["vector"], bounds, strict=True):
                away = np.sqrt(_gaps(centers, np.asarray(vector, dtype=np.float64)))
                picked = _first_cells(away, counts, k, probes)
                if second:
                    low = np.maximum(away - radius, 0.0)
                    near = (low * low <= bound * (1 + 1e-9) + 1e-12) & (counts > 0)  # room for rounding
                    near[picked] = False
                    picked = np.flatnonzero(near)
                ids += [q] * len(picked)
                vectors += [vector] * len(picked)
                cells += picked.tolist()
            yield pd.DataFrame({"query_id": ids, "vector": vectors, "cell": cells})

    return queries.mapInPandas(choose, "query_id bigint, vector array<double>, cell int")


def _meet(index: CellIndex, pairs: DataFrame, k: int, block_rows: int, query_rows: int) -> DataFrame:
    """The ``k`` nearest rows of each visited block of a cell. A large cell is many blocks, a cell with many queries meets them in parts."""
    spark = pairs.sparkSession
    pairs = store(pairs)
    asked = {r["cell"]: r["count"] for r in pairs.groupBy("cell").count().collect()}
    sizes = [(c, -(-int(index.counts[c]) // block_rows), -(-n // query_rows)) for c, n in asked.items()]
    plan = F.broadcast(spark.createDataFrame(sizes, "cell int, blocks int, parts int"))  # a row a cell
    left = pairs.join(plan, "cell").select(
        "cell", "query_id", "vector", F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    right = index.rows.join(plan, "cell").select(
        "cell", "base_id", "vector", F.pmod(F.xxhash64("base_id"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )

    def nearest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(b):
            ids, points = b["base_id"].to_numpy(), _matrix(b["vector"])
            for query, vector in zip(q["query_id"], q["vector"], strict=True):
                distance = _gaps(points, np.asarray(vector, dtype=np.float64))
                best = np.lexsort((ids, distance))[:k]
                out.append(pd.DataFrame({"query_id": query, "base_id": ids[best], "distance": distance[best]}))
        if out:
            return pd.concat(out)
        return pd.DataFrame({"query_id": [], "base_id": [], "distance": []}).astype({"query_id": "int64", "base_id": "int64", "distance": "float64"})

    keys = ["cell", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, FOUND)


def search_cells(
    index: CellIndex, queries: DataFrame, k: int = 8, probes: int | None = None, block_rows: int = 10_000, query_rows: int = 2_000
) -> DataFrame:
    """The ``k`` nearest rows of each query (``query_id, vector``): ``query_id, place, base_id, distance`` (squared).

    Exact without ``probes``: the first cells give a k-th distance, and then every cell that could hold a nearer or
    equal row is read. With ``probes`` only that many cells are read (more, if they hold fewer than ``k`` rows): the result has
    ``k`` rows as long as the base has, but may miss some of the nearest. Ties go to the smaller id; queries without a
    vector and repeated query rows give none and one answer.
    """
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = asked.dropDuplicates(["query_id"])
    order = [F.col("distance").asc(), F.col("base_id").asc()]
    columns = ["query_id", "place", "base_id", "distance"]
    if not index.counts.sum():
        return asked.sparkSession.createDataFrame([], FOUND).withColumn("place", F.lit(0)).select(*columns)
    asked = store(asked)
    first = _meet(index, visits(index, asked, k, probes or 1), k, block_rows, query_rows)
    near = top_k_per(first, ["query_id"], order, k).select(*columns)
    if probes:
        return near
    near = store(near)
    bounds = near.where(F.col("place") == k).select("query_id", F.col("distance").alias("bound"))
    rest = _meet(index, visits(index, asked.join(bounds, "query_id"), k), k, block_rows, query_rows)
    return top_k_per(near.drop("place").unionByName(rest), ["query_id"], order, k).select(*columns)
