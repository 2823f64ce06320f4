"""Scoring of a live lobby against rated setting groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lobby_number
from ..operators.filters import lobby_players
from ..operators.importance import SettingFeatures
from ..operators.joins import zip_rows
from ..operators.knn import knn


def lobby_ai(text: Column) -> Column:
    """AI side from the bot text: a digit means barbarian."""
    lower = F.lower(text)
    return F.when(lower.rlike(r"\d"), "Barbarian").when(lower.contains("scavengers"), "Scavengers").otherwise("Raptors")


def vectors(features: SettingFeatures, df: DataFrame, key: str, out: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return features.transform(df).select(F.col(key).alias(out), vector_to_array("features").alias("vector"))


def score_lobbies(lobbies: DataFrame, groups: DataFrame, features: SettingFeatures, k: int = 8) -> DataFrame:
    """The ``k`` nearest groups of each lobby with their difficulty in percent.

    ``lobbies`` has ``lobby`` and the setting columns, ``groups`` has ``gid``,
    ``Difficulty`` and the same columns.
    """
    near = knn(vectors(features, lobbies, "lobby", "query_id"), vectors(features, groups, "gid", "base_id"), k)
    facts = groups.select(F.col("gid").alias("base_id"), (F.col("Difficulty").cast("double") * 100).alias("Difficulty"))
    return near.join(facts, "base_id").select(
        F.col("query_id").alias("lobby"), "place", F.col("base_id").alias("gid"), "Difficulty", "distance"
    )


def lobby_table(neighbours: DataFrame, ratings: DataFrame, lobby: DataFrame) -> DataFrame:
    """Neighbours of one lobby beside the ratings of its players."""
    present = lobby_players(ratings, lobby)
    shown = zip_rows(
        neighbours.select("Difficulty", "distance"),
        [F.col("distance").asc(), F.col("Difficulty").asc()],
        present,
        [F.col("PVE Rating").desc_nulls_last(), F.col("Player").asc()],
    )
    texts = {}
    for name, kind in shown.dtypes:
        if name in ("Difficulty", "distance"):
            texts[name] = F.coalesce(F.round(F.col(name), 1).cast("string"), F.lit(""))
        elif kind in ("float", "double"):
            texts[name] = F.coalesce(lobby_number(F.round(F.col(f"`{name}`").cast("double"), 2).cast("string")), F.lit(""))
        elif kind in ("int", "bigint", "string") and name != "row":
            texts[name] = F.coalesce(lobby_number(F.col(f"`{name}`").cast("string")), F.lit(""))
    return shown.withColumns(texts).drop("row")
