"""Rating job: setting report and player ratings of one AI side."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import col
from ..operators.clean import cast_matches, derive_matches
from ..operators.columns import drop_constant_columns, tweaks_in_order
from ..operators.dominance import ExtendedGroups, extend_results, report_cells
from ..operators.filters import plain_barbarian, split_ai
from ..operators.groups import list_by_order, own_replays, with_group_key
from ..operators.names import latest_names, name_sightings
from ..operators.players import player_ratings, setting_index
from ..operators.report import setup_text
from ..operators.settings import ai_roles
from ..plans.joins import join_lookup
from ..roles import MatchColumns, SettingRoles
from ..session import materialize, store
from ..sources.tables import write_rating_json, write_table, write_tiers

AIS = ("Barbarian", "Raptors", "Scavengers")


@dataclass
class RatedSide:
    """Result for one AI side."""

    report: DataFrame
    ratings: DataFrame
    extended: ExtendedGroups
    roles: SettingRoles
    constants: dict[str, object] = field(default_factory=dict)


def setting_report(
    extended: ExtendedGroups,
    indexed: DataFrame,
    matches_df: DataFrame,
    matches: MatchColumns,
    names: DataFrame,
    option_defaults: DataFrame,
    site: str,
    document: str = "",
    constants: dict[str, object] | None = None,
    by: tuple[str, ...] = ("ai",),
) -> DataFrame:
    """The published setting table; ``names`` holds ``userId, name``.

    Replay and member lists are the cells of the published rows; they are put into rows that are
    else complete, last, from pieces that hold many of their values each.
    """
    roles = extended.state.roles
    shown = F.sort_array(F.collect_list("name"))  # without nulls
    titled = names.groupBy(F.col("userId").alias("player")).agg(F.when(F.size(shown) > 0, F.array_join(shown, ", ")).alias("name"))
    ids = extended.state.groups.select("group_key", "gid")
    own = own_replays(with_group_key(matches_df, roles, by), matches).join(ids, "group_key").drop("group_key")
    own = store(own, partition_by=("kind",))
    table = indexed
    for kind in ("Win", "Loss"):
        mine = list_by_order(own.where(F.col("kind") == kind), ["gid"], ["sort_value", "replay"], "replay", f"{kind} Replays")
        table = table.join(mine, "gid", "left").withColumn(f"{kind} Replays", F.coalesce(col(f"{kind} Replays").cast("array<string>"), F.array().cast("array<string>")))
    texted = setup_text(table.withColumnRenamed(roles.map_column, "Map"), roles, option_defaults, F.col("ai"), site, document, constants)
    settings = tweaks_in_order(roles.settings)
    rows = texted.select(
        "gid",
        *[col(b) for b in by],
        F.col("index").cast("int").alias("index"),
        *[col(c) for c in ("Difficulty", "#Winners", "#Players", "Win Replays", "Loss Replays", "Copy Paste", "Map")],
        *[col(c) for c in settings],
    )
    wanted = own.select("gid", "kind", "replay")
    whole = report_cells(extended, rows, matches_df, matches, wanted, titled, by)
    texts = {c: col(c).cast("array<string>") for c in ("Merged Win Replays", "Merged Loss Replays")}
    return whole.withColumns(texts).select(
        *[col(b) for b in by],
        "index",
        *[
            col(c)
            for c in (
                "Difficulty", "#Winners", "#Players", "Winners", "Players", "Win Replays", "Merged Win Replays",
                "Loss Replays", "Merged Loss Replays", "Copy Paste", "Map",
            )
        ],
        *[col(c) for c in settings],
    )


def rate_side(
    derived: DataFrame,
    ai: str,
    names: DataFrame,
    option_defaults: DataFrame,
    site: str,
    document: str = "",
) -> RatedSide:
    """Group, extend and rate all matches against one AI."""
    games = split_ai(derived, ai)
    games = (
        games.select("*", "damage_eco_award.*")
        .drop("damage_eco_award", "AllyTeams", "AllyTeamsList")
        .withColumn("ai", F.lit(ai))
        .withColumn("ai_win", F.col(f"{ai.lower()}_win"))
    )
    games = materialize(games)
    grouped = plain_barbarian(games) if ai == "Barbarian" else games
    roles = ai_roles(ai)
    grouped, constants = drop_constant_columns(grouped, [c for c in roles.settings if c in grouped.columns])
    roles = roles.keep(grouped.columns)
    matches = MatchColumns(ai_win="ai_win")
    extended = extend_results(grouped, roles, matches, ("ai",))
    indexed = materialize(setting_index(extended, ("ai",)))
    report = setting_report(
        extended, indexed, grouped, matches, names, option_defaults, site, document, constants
    )
    rated = player_ratings(extended, grouped, matches, ("ai",), indexed, stats_from=games)
    known = names.select(F.col("userId").alias("Player"), "name")
    titled = join_lookup(rated, known, ["Player"]).withColumn("Player", F.col("name")).drop("name")
    ordered = titled.orderBy(F.col("PVE Rating").desc_nulls_last(), F.col("Player").asc())
    return RatedSide(report, ordered, extended, roles, constants)


def rate(
    spark: SparkSession,
    details: DataFrame,
    option_defaults: DataFrame,
    out: str,
    site: str,
    tweaks: DataFrame | None = None,
    document: str = "",
) -> dict[str, RatedSide]:
    """Whole rating job over a match-detail table; writes all published tables."""
    derived = materialize(derive_matches(cast_matches(details), tweaks))
    names = materialize(latest_names(name_sightings(derived)))
    sides = {
        ai: rate_side(derived, ai, names, option_defaults, site, document) for ai in AIS
    }
    reports = None
    ratings = None
    for side in sides.values():
        reports = side.report if reports is None else reports.unionByName(side.report, allowMissingColumns=True)
        ratings = side.ratings if ratings is None else ratings.unionByName(side.ratings)
    write_tiers(materialize(reports), f"{out}/setting_groups", ("ai",))
    ratings = materialize(ratings)
    write_table(ratings, f"{out}/player_ratings", ["ai"])
    write_rating_json(ratings.withColumn("ai", F.concat("ai", F.lit("AI"))), f"{out}/pve_ratings")
    return sides
