"""Nearest groups by squared distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import col
from .ranking import top_k_per

BROADCAST_QUERIES = 4096


def _nearest(queries: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` smallest squared distances per query row, ties included."""
    found_rows, found_cols = [], []
    for row, query in enumerate(queries):
        gap = base - query
        distance = np.einsum("ij,ij->i", gap, gap)
        if len(distance) > k:
            cut = np.partition(distance, k - 1)[k - 1]
            picked = np.flatnonzero(distance <= cut)
        else:
            picked = np.arange(len(distance))
        found_rows.append(np.full(len(picked), row))
        found_cols.append(picked)
    return np.concatenate(found_rows), np.concatenate(found_cols)


def _candidates(q_ids, q_vectors, base: pd.DataFrame, k: int) -> pd.DataFrame:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in base["vector"]])
    rows, cols = _nearest(q_vectors, matrix, k)
    gap = matrix[cols] - q_vectors[rows]
    return pd.DataFrame(
        {
            "query_id": np.asarray(q_ids)[rows],
            "base_id": base["base_id"].to_numpy()[cols],
            "distance": np.einsum("ij,ij->i", gap, gap),
        }
    )


CANDIDATES = "query_id bigint, base_id bigint, distance double"


def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int = 8,
    max_queries: int = BROADCAST_QUERIES,
    block_rows: int = 20_000,
) -> DataFrame:
    """Exact ``k`` nearest base rows per query: ``query_id, place, base_id, distance``.

    ``queries`` holds ``query_id, vector`` and ``base`` holds ``base_id, vector``. Up to
    ``max_queries`` queries are sent to every task, which keeps only its own best
    ``k`` per query. More queries are met block by block: both sides are cut
    into blocks and each pair of blocks is one group of a shuffle. Ties go to
    the smaller id.
    """
    if queries.limit(max_queries + 1).count() <= max_queries:
        held = queries.select("query_id", "vector").toPandas()
        ids = held["query_id"].to_numpy()
        if not len(ids):
            found = base.sparkSession.createDataFrame([], CANDIDATES)
        else:
            vectors = np.stack([np.asarray(v, dtype=np.float64) for v in held["vector"]])
            sent = base.sparkSession.sparkContext.broadcast((ids, vectors))

            def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                q_ids, q_vectors = sent.value
                for batch in batches:
                    if len(batch):
                        yield _candidates(q_ids, q_vectors, batch, k)

            found = base.select("base_id", "vector").mapInPandas(scan, CANDIDATES)
    else:
        found = _block_candidates(queries, base, k, max_queries, block_rows)
    order = [F.col("distance").asc(), F.col("base_id").asc()]
    return top_k_per(found, ["query_id"], order, k).select("query_id", "place", "base_id", "distance")


def _block_candidates(queries: DataFrame, base: DataFrame, k: int, query_rows: int, base_rows: int) -> DataFrame:
    q_blocks = max(1, -(-queries.count() // query_rows))
    b_blocks = max(1, -(-base.count() // base_rows))
    left = queries.select(
        "query_id",
        "vector",
        F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("q_block"),
        F.explode(F.sequence(F.lit(0), F.lit(b_blocks - 1))).alias("b_block"),
    )
    right = base.select(
        "base_id",
        "vector",
        F.pmod(F.xxhash64("base_id"), F.lit(b_blocks)).cast("int").alias("b_block"),
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"),
    )

    def meet(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"query_id": [], "base_id": [], "distance": []}).astype(
                {"query_id": "int64", "base_id": "int64", "distance": "float64"}
            )
        vectors = np.stack([np.asarray(v, dtype=np.float64) for v in q["vector"]])
        return _candidates(q["query_id"].to_numpy(), vectors, b, k)

    keys = ["q_block", "b_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, CANDIDATES)
