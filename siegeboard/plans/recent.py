"""Recent-games job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import cast_matches, derive_matches
from ..operators.names import latest_names, name_sightings
from ..operators.report import recent_games
from ..session import materialize
from ..sources.tables import write_recent


def publish_recent(
    spark: SparkSession, details: DataFrame, root: str, n: int | None = None, tweaks: DataFrame | None = None
) -> DataFrame:
    """Write and return all games, or the newest ``n``, with their setting groups."""
    derived = materialize(derive_matches(cast_matches(details), tweaks))
    names = latest_names(name_sightings(derived))
    groups = spark.read.parquet(f"{root}/setting_groups").where(F.col("tier") == "all").drop("ai", "tier")
    table = recent_games(derived, groups, names, n)
    write_recent(table, f"{root}/recent_games", n, [F.col("Start Time").desc(), F.col("Replay ID").desc()])
    return table
