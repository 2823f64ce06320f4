"""Match view over the order tables.

An order is a match, its suppliers are the players and its status names the AI
side. Used to run the match operators on the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..roles import Gate, MatchColumns, SettingRoles

VIEW_ROLES = SettingRoles(
    map_column="map_name",
    equal=("tweakunits",),
    higher=("difficulty_ord", "spawn_mult", "nuttyb_hp"),
    lower=("start_metal", "evocom", "evocom_rate"),
    optional=("nuttyb_hp",),
    gates=(Gate("evocom", 0, ("evocom_rate",)),),
)

VIEW_COLUMNS = MatchColumns(
    id="id",
    start="start_time",
    duration="duration",
    ai_win="ai_win",
    players="players",
    winners="winners",
    damage="damage_award",
    damage_value="damage_value",
    eco="eco_award",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def match_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    line_order = ["l_linenumber", "l_suppkey"]
    crews = lines.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(F.collect_set("l_suppkey")).alias("players"),
        F.max("l_extendedprice").alias("top_price"),
        F.min_by("l_suppkey", F.struct((-F.col("l_extendedprice")).alias("p"), *line_order)).alias("damage_award"),
        F.min_by("l_suppkey", F.struct((-F.col("l_quantity")).alias("q"), *line_order)).alias("eco_award"),
    )
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ai_win = (cust + key) % 3 != 0
    return (
        orders.join(customers, cust == F.col("c_custkey"))
        .join(crews, key == F.col("id"))
        .select(
            "id",
            F.col("o_orderdate").alias("start_time"),
            F.when(F.col("o_orderstatus") == "P", "Raptors")
            .when(F.col("o_orderstatus") == "F", "Scavengers")
            .otherwise("Barbarian")
            .alias("ai"),
            ai_win.alias("ai_win"),
            F.floor("o_totalprice").cast("long").alias("duration"),
            F.col("c_mktsegment").alias("map_name"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("difficulty_ord"),
            (key % 5 + 1).alias("spawn_mult"),
            ((cust % 4) * 1000).alias("start_metal"),
            (key % 2).alias("evocom"),
            (cust % 3 + 1).alias("evocom_rate"),
            F.when(key % 10 == 0, "mod").otherwise("").alias("tweakunits"),
            F.when(key % 7 == 0, cust % 6).alias("nuttyb_hp"),
            "players",
            F.when(ai_win, F.array().cast("array<bigint>")).otherwise(F.col("players")).alias("winners"),
            "damage_award",
            F.floor("top_price").cast("long").alias("damage_value"),
            "eco_award",
        )
    )


def nested_view(spark: SparkSession, sf_dir: str, games: DataFrame | None = None) -> DataFrame:
    """The match view as raw nested records, odd ones included; ``games`` is the view if it is at hand.

    Matches of one map hold an AI nobody knows, orders without a stated priority
    get a third team, the dearest orders a mixed team, the cheapest no length;
    the owner of a very high damage award has a handicap.
    """
    games = match_view(spark, sf_dir) if games is None else games
    handicapped = F.col("damage_value") > 100000
    players = F.transform(
        "players",
        lambda p, i: F.struct(
            i.cast("int").alias("teamId"),
            p.alias("userId"),
            F.concat(F.lit("player "), p.cast("string")).alias("name"),
            F.when(handicapped & (p == F.col("damage_award")), 10).otherwise(0).alias("handicap"),
        ),
    )
    ai_name = (
        F.when(F.col("map_name") == "MACHINERY", "OtherAI")
        .when(F.col("ai") == "Raptors", "RaptorsAI")
        .when(F.col("ai") == "Scavengers", "ScavengersAI")
        .otherwise("BARb")
    )
    n_ais = F.when(F.col("ai") == "Barbarian", F.size("players") % 3 + 1).otherwise(1)
    ais = F.transform(
        F.sequence(F.lit(1), n_ais),
        lambda i: F.struct(ai_name.alias("shortName"), (i * 5).cast("int").alias("handicap")),
    )
    nobody, no_ai = F.slice(players, 1, 0), F.slice(ais, 1, 0)

    def team(won, people, bots):
        return F.struct(won.alias("winningTeam"), people.alias("Players"), bots.alias("AIs"))

    mixed = F.when(F.col("duration") > 490000, F.slice(players, 1, 1)).otherwise(nobody)
    two = F.array(team(~F.col("ai_win"), players, no_ai), team(F.col("ai_win"), mixed, ais))
    three = F.concat(two, F.array(team(F.lit(False), nobody, no_ai)))

    def team_id(owner: str):
        return (F.array_position("players", F.col(owner)) - 1).cast("int")

    damage_team = F.when(F.size("players") == 2, F.lit(99)).otherwise(team_id("damage_award"))
    units = F.array(F.struct(damage_team.alias("teamId"), (F.col("damage_value") + 0.5).alias("value")))
    awards = F.struct(
        F.when(F.size("players") == 1, F.slice(units, 1, 0)).otherwise(units).alias("fightingUnitsDestroyed"),
        F.struct(team_id("eco_award").alias("teamId")).alias("mostResourcesProduced"),
    )
    settings = [F.col(c) for c in VIEW_ROLES.settings]
    return games.select(
        F.col("id").cast("string").alias("id"),
        F.col("start_time").alias("startTime"),
        F.when(F.col("duration") < 2000, 0).otherwise(F.col("duration")).alias("durationMs"),
        F.struct(F.concat("map_name", F.lit(" v1."), F.col("difficulty_ord").cast("string")).alias("scriptName")).alias("Map"),
        F.when(F.col("tweakunits") == "", F.col("map_name")).alias("Map Name"),
        F.when(F.col("difficulty_ord") == 4, three).otherwise(two).alias("AllyTeams"),
        awards.alias("awards"),
        F.when(F.col("spawn_mult") != 3, F.col("spawn_mult") != 2).alias("fetch_success"),
        *settings,
    )
