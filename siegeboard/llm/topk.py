"""Exact top-k inner products by an impact-ordered index, read score at a time.

Components are quantised to an impact: the number of times ``step`` goes into
their magnitude. A posting segment holds, for one impact, what every dimension
has at that impact: vector and value. Segments are read from the highest impact
down, adding to the scores of all vectors of the index. What is still unread of
a vector has a known norm, so by Cauchy and Schwarz no score can move by more
than |query| times that norm. A query stops when at most ``few`` vectors can
still be among its best k by these bounds, or when all segments are read. The
vectors that can still be members are then scored exactly.

Queries and vectors meet in blocks: each pair of a block of queries and a block
of vectors is a task of bounded size, and returns k rows a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored, table

K = 5
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 1024
STEP = 8
FEW = 64
PAIRS = "query_id bigint, vec_id bigint, score bigint"


class ImpactIndex:
    """Segments of one block of integer vectors, by descending impact."""

    def __init__(self, vectors: np.ndarray, step: int = STEP):
        self.vectors = vectors
        impact = np.abs(vectors) // step
        self.impacts = np.unique(impact)[::-1]
        squares = vectors.astype(np.float64) ** 2
        left = squares.sum(axis=1)
        self.segments, self.left = [], []
        for level in self.impacts:
            at = impact == level
            row, dim = np.nonzero(at & (vectors != 0))
            self.segments.append((row, dim, vectors[row, dim].astype(np.float64)))
            left = left - (squares * at).sum(axis=1)
            self.left.append(np.sqrt(np.maximum(left, 0)))

    def search(self, queries: np.ndarray, k: int, few: int = FEW) -> list[np.ndarray]:
        """For each query the vectors that can be among its best k, ties included."""
        n = len(self.vectors)
        members: list[np.ndarray] = [np.arange(n)] * len(queries)
        open_ = np.arange(len(queries))
        if n <= max(k, few):
            return members
        norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        partial = np.zeros((len(queries), n))
        for (row, dim, value), left in zip(self.segments, self.left, strict=True):
            # A segment as a matrix: its postings are laid out by vector and dimension and added to all open queries at once.
            laid = np.zeros(self.vectors.shape)
            laid[row, dim] = value
            partial[open_] += queries[open_].astype(np.float64) @ laid.T
            # One unit on top covers rounding; all sums here are whole numbers below 2^53.
            slack = norm[open_, None] * left[None, :] * (1 + 1e-9) + 1e-6 * (left > 0)
            sure = np.partition(partial[open_] - slack, n - k, axis=1)[:, n - k]
            can = partial[open_] + slack >= sure[:, None]
            count = can.sum(axis=1)
            done = (count <= few) | bool((left == 0).all())
            for i in np.flatnonzero(done):
                members[open_[i]] = np.flatnonzero(can[i])
            open_ = open_[~done]
            if not len(open_):
                break
        return members


def _unpack(blobs: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width), dtype=np.int64)
    for i, blob in enumerate(blobs):
        v = np.asarray(blob, dtype=np.int64)
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """The ``k`` best partners of every query row among all rows but those of its own ``vec_id``.

    ``vectors`` has ``vec_id`` and ``values`` (array of bigint, nothing null).
    Shorter vectors count as ending in zeros. Ranks start at 1, ties go to the
    smaller id; a query with fewer partners has them all. Rows that share an id
    are vectors of their own; each is a query if its id says so, and they are
    ranked together, the best k rows of an id.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select("vec_id", "values", F.coalesce(is_query, F.lit(False)).alias("is_query")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"), F.max(F.size("values")).alias("w")).first()
    if not size["n"] or not size["q"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = size["w"]
    v_blocks, q_blocks = -(-size["n"] // BLOCK_VECTORS), -(-size["q"] // BLOCK_QUERIES)
    key = F.xxhash64("vec_id", "values")
    base = rows.select(
        "vec_id", "values", F.pmod(key, F.lit(v_blocks)).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q")
    )
    asked = rows.where("is_query").select(
        F.col("vec_id").alias("query_id"), "values", F.pmod(key, F.lit(q_blocks)).cast("int").alias("q"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(v_blocks - 1).cast("long"))).alias("v"),
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(left) and len(right):
            left = left.sort_values("vec_id", ignore_index=True)
            ids, data = left["vec_id"].to_numpy(), _unpack(left["values"], width)
            index = ImpactIndex(data)
            for lo in range(0, len(right), 128):
                part = right.iloc[lo : lo + 128]
                queries = _unpack(part["values"], width)
                # Rows of the query's own id take up places: ask for as many more as the most frequent id has.
                extra = int(np.unique(ids, return_counts=True)[1].max())
                for own, q, some in zip(part["query_id"], queries, index.search(queries, k + extra), strict=True):
                    some = some[ids[some] != own]
                    score = data[some] @ q
                    best = np.lexsort((ids[some], -score))[:k]
                    found.append(pd.DataFrame({"query_id": own, "vec_id": ids[some][best], "score": score[best]}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    pairs = base.groupBy("v", "q").cogroup(asked.groupBy("v", "q")).applyInPandas(search, PAIRS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def integer_vectors(df: DataFrame, column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``values``: floor(scale * component); rows with a null id or vector, or a null or non-finite component, are left out."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & F.coalesce(sound, F.lit(False))).select(
        "vec_id", F.transform(x, lambda v: F.floor(F.lit(scale) * v)).alias("values")
    )


def op8_impact_topk(spark, sf_dir: str) -> DataFrame:
    """The five best partners of every vector whose id is divisible by 50, over all vectors."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
with v as (
    select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as vals from embeddings
    where vec_id is not null and embedding is not null
      and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
), s as (
    select a.vec_id as query_id, b.vec_id as vec_id,
           cast(list_inner_product(cast(a.vals as double[]), cast(b.vals as double[])) as bigint) as score
    from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), r as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select * from r where rank <= 5
"""
