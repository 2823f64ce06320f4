"""JSON landing files of match lists and match details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_map_name
from ..operators.clean import parse_start_time

TEAMS = (
    "array<struct<winningTeam:boolean,"
    "Players:array<struct<teamId:int,userId:bigint,name:string,handicap:int>>,"
    "AIs:array<struct<shortName:string,handicap:int>>>>"
)
MATCH_LIST_SCHEMA = f"id string, startTime string, durationMs bigint, Map struct<scriptName:string>, AllyTeams {TEAMS}"
AWARDS = (
    "struct<fightingUnitsDestroyed:array<struct<teamId:int,value:double>>,mostResourcesProduced:struct<teamId:int>>"
)
ROOT_COLUMNS = ["startTime", "durationMs", "AllyTeams", "id", "Map Name"]


def root_rows(listed: DataFrame) -> DataFrame:
    """Match-list records as rows of the root table."""
    typed = listed.withColumns(
        {
            "Map Name": normalize_map_name(F.col("Map.scriptName")),
            "startTime": parse_start_time(F.col("startTime")),
            "durationMs": F.col("durationMs").cast("bigint"),
        }
    )
    return typed.select(*[F.col(f"`{c}`") for c in ROOT_COLUMNS])


def read_match_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Match-list records of all landing files, one JSON object per line."""
    return root_rows(spark.read.schema(MATCH_LIST_SCHEMA).json(folder))


def detail_rows(raw: DataFrame) -> DataFrame:
    """Details with settings as columns; a failed fetch keeps its id and ``fetch_success = false``."""
    ok = F.col("status") == 200
    settings = raw.schema["gameSettings"].dataType.fieldNames()
    base = ["awards", "AllyTeams", "Map", "startTime"]
    return raw.select(
        "id",
        *[F.when(ok, F.col(f"gameSettings.`{s}`")).alias(s) for s in settings],
        *[F.when(ok, F.col(b)).alias(b) for b in base],
        ok.alias("fetch_success"),
    )


def read_match_details(spark: SparkSession, folder: str, settings: T.StructType | None = None) -> DataFrame:
    """Match-detail records. Without ``settings`` the setting names come from the files."""
    reader = spark.read
    if settings is None:
        seen = reader.json(folder).schema["gameSettings"].dataType
        settings = T.StructType([T.StructField(f.name, T.StringType()) for f in seen.fields])
    schema = (
        f"id string, status int, startTime string, Map struct<scriptName:string>, AllyTeams {TEAMS}, awards {AWARDS}, "
        f"gameSettings {settings.simpleString()}"
    )
    return detail_rows(spark.read.schema(schema).json(folder))
