"""Player names over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matches as mx
from ..functions.keys import col


def name_sightings(games: DataFrame, teams: str = "AllyTeams", start: str = "startTime", match_id: str = "id") -> DataFrame:
    """One row per match and player: userId, name, start and match id."""
    return (
        games.select(col(start).alias("start"), col(match_id).alias("match"), F.explode(mx.player_records(col(teams))).alias("p"))
        .where(F.col("p").isNotNull())
        .select(F.col("p.userId").cast("bigint").alias("userId"), F.col("p.name").alias("name"), "start", "match")
    )


def latest_names(sightings: DataFrame) -> DataFrame:
    """The name of each user in the latest match, ties to the larger match id."""
    return sightings.groupBy("userId").agg(F.max_by("name", F.struct("start", "match")).alias("name"))


def distinct_names(sightings: DataFrame) -> DataFrame:
    return sightings.select("userId", "name").dropna().distinct()


def aliases(sightings: DataFrame, name: str) -> DataFrame:
    """All names of the users who ever used ``name``."""
    pairs = distinct_names(sightings)
    users = pairs.where(F.col("name") == name).select("userId")
    return pairs.join(users, "userId", "left_semi")
