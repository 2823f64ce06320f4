"""Parquet tables: staged overwrite, tier tables, views, rating document."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import col
from ..operators.tiers import first_rows, tiered
from ..plans.joins import join_lookup


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a table, even one that ``df`` reads from.

    Rows go to a staged folder beside the table; only a complete write takes the
    table's place.
    """
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(staged)
    swap(df.sparkSession, staged, path)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put the finished ``staged`` folder in the place of ``path``."""
    files, Path = _file_system(spark, path)
    old = Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had_old = files.exists(Path(path))
    if had_old and not files.rename(Path(path), old):
        raise OSError(f"cannot set aside {path}")
    if not files.rename(Path(staged), Path(path)):
        if had_old:
            files.rename(old, Path(path))
        raise OSError(f"cannot move {staged} to {path}")
    if had_old:
        files.delete(old, True)


def write_tiers(groups: DataFrame, path: str, by: Sequence[str] = ("ai",)) -> None:
    """All, regular, unbeaten and cheese tables as partitions of one dataset."""
    write_table(tiered(groups, by, with_all=True), path, [*by, "tier"])


def write_recent(df: DataFrame, path: str, n: int | None, order: Sequence[Column]) -> None:
    """Write a report; with ``n`` only its first ``n`` rows in ``order``."""
    write_table(df if n is None else first_rows(df, n, order), path)


def rating_document(ratings: DataFrame, ai: str = "ai", player: str = "Player", rating: str = "PVE Rating") -> DataFrame:
    """Lines of the JSON document ``{"pve_ratings": {ai: {player: rating}}}``.

    ``part`` and ``place`` give the order of the lines. One line holds one player,
    so the document never is a single row. A name held by several users
    keeps the lowest rating, which comes last in the rating table.
    """
    entries = ratings.groupBy(col(ai).alias("ai"), col(player).cast("string").alias("place")).agg(
        F.min_by(col(rating), F.coalesce(col(rating), F.lit(-1.0))).alias("rating")
    )
    sides = entries.groupBy("ai").agg(F.min("place").alias("first"))
    first_side = sides.agg(F.min("ai")).first()[0]
    body = F.to_json(F.create_map(F.col("place"), F.col("rating")), {"ignoreNullFields": "false"})
    lines = join_lookup(entries, sides, ["ai"]).select(
        F.concat("ai", F.lit(" 1")).alias("part"),
        "place",
        F.concat(F.when(F.col("place") != F.col("first"), ",").otherwise(""), body.substr(F.lit(2), F.length(body) - 2)).alias("value"),
    )
    opened = sides.select(
        F.concat("ai", F.lit(" 0")).alias("part"),
        F.lit("").alias("place"),
        F.concat(
            F.when(F.col("ai") == F.lit(first_side), '{"pve_ratings":{').otherwise(","), F.lit('"'), "ai", F.lit('":{')
        ).alias("value"),
    )
    last_side = sides.agg(F.max("ai")).first()[0]
    closed = sides.select(
        F.concat("ai", F.lit(" 2")).alias("part"),
        F.lit("").alias("place"),
        F.when(F.col("ai") == F.lit(last_side), "}}}").otherwise("}").alias("value"),
    )
    return opened.unionByName(lines).unionByName(closed)


def write_rating_json(ratings: DataFrame, path: str, **columns: str) -> None:
    """Write the rating document as text files; in file order they form one JSON object."""
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    rating_document(ratings, **columns).orderBy("part", "place").select("value").write.text(staged)
    swap(ratings.sparkSession, staged, path)


def resolve_view(spark: SparkSession, root: str, view: str = "recent_games", ai: str = "", tier: str = "regular") -> DataFrame:
    """Table behind a view; ``ai`` and ``tier`` prune partitions.

    ``easy`` is another name for ``cheese``; anything unknown shows recent games.
    """
    label = ai[:1].upper() + ai[1:]
    if view == "gamesettings":
        wanted = tier.replace("easy", "cheese")
        table = spark.read.parquet(f"{root}/setting_groups")
        return table.where((F.col("ai") == label) & (F.col("tier") == wanted)).drop("tier")
    if view == "ratings":
        return spark.read.parquet(f"{root}/player_ratings").where(F.col("ai") == label)
    return spark.read.parquet(f"{root}/recent_games")


def read_backups(spark: SparkSession, root: str, pattern: str = "*replays*") -> DataFrame:
    """All backup files below ``root`` whose name holds ``replays``, with their path as ``_file``."""
    found = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("mergeSchema", "true")
    )
    return found.parquet(root).withColumn("_file", F.input_file_name())
