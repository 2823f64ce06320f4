"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in source blocks. How many rows of a block go to a shard is drawn from
the multivariate hypergeometric law, so that all shards come out at their exact
size. Each block is permuted and cut by its row of the matrix, the pieces are
exchanged, and every shard is permuted again. The result has the law of one
uniform permutation of all rows.

Blocks and both permutations follow seeded hashes of the row, not of where it
happens to lie, so a task that runs again after a lost executor deals the same.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored, table, utf8

#: The matrix has at most so many rows, whatever the input: the driver draws it and it is broadcast.
MAX_BLOCKS = 4096
#: Pieces of a shard that are ranked by one task each.
MAX_PIECES = 1024
BLOCK_ROWS = 20_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` out of ``good + bad`` are good.

    Exact up to 10^9 rows. Beyond that the normal limit, cut to the possible range, stands for it.
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    share = good / n
    spread = math.sqrt(draws * share * (1 - share) * (n - draws) / max(1, n - 1))
    return int(min(max(round(rng.normal(draws * share, spread)), draws - bad, 0), draws, good))


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from block i to shard j; row sums are the blocks' sizes, column sums differ by at most one."""
    rng = np.random.default_rng(seed)
    total = sum(block_rows)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    rng.shuffle(room)
    matrix = np.zeros((len(block_rows), shards), dtype=np.int64)
    for i, rows in enumerate(block_rows):
        left, open_room = rows, sum(room)
        for j in range(shards):
            open_room -= room[j]
            matrix[i, j] = hypergeometric(rng, room[j], open_room, left)
            left -= int(matrix[i, j])
            room[j] -= int(matrix[i, j])
    return matrix


def shuffle_into_shards(df: DataFrame, identity: list[str], shards: int = 16, seed: int = 2024, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard) to every row.

    ``identity`` tells rows apart. Rows equal in it are interchangeable: the same
    multiset of places falls to them on every run. Nulls are values like others.
    An empty table gives an empty result.
    """
    spark = df.sparkSession
    total = df.count()
    blocks = min(MAX_BLOCKS, max(1, -(-total // block_rows)))
    pieces = min(MAX_PIECES, max(1, -(-total // (shards * block_rows))))

    def mixed(salt: int) -> Column:
        return F.xxhash64(F.lit(seed * 8 + salt), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in identity])

    rows = df.withColumn("_block", F.pmod(mixed(0), F.lit(blocks)).cast("int"))
    # At most MAX_BLOCKS counts reach the driver.
    counts = {r["_block"]: r["count"] for r in rows.groupBy("_block").count().collect()}
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], shards, seed)
    cuts = spark.createDataFrame(
        [(b, [int(x) for x in np.cumsum(matrix[b])]) for b in range(blocks)], "_block int, _cuts array<bigint>"
    )
    order = [mixed(1), *[F.col(c) for c in identity]]
    dealt = (
        rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1)
        .join(F.broadcast(cuts), "_block")
        .withColumn("shard", F.expr("size(filter(_cuts, c -> c <= _rank))").cast("int"))
        .withColumn("_piece", F.pmod(mixed(2), F.lit(pieces)).cast("int"))
        .drop("_block", "_rank", "_cuts")
    )
    dealt = stored(dealt)
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "_piece").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    )  # at most shards x MAX_PIECES rows
    inside = Window.partitionBy("shard", "_piece").orderBy(mixed(3), *[F.col(c) for c in identity])
    return (
        dealt.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "_piece"])
        .withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long"))
        .select(*df.columns, "shard", "slot")
    )


def op2_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by at most one. A null text has no bytes and counts as size 1."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(utf8(F.col("text"))) + 1).cast("long").alias("size"),
        F.crc32(utf8(F.col("text"))).alias("text_crc32"),
    )
    out = shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
