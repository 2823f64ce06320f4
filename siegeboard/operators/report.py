"""Published tables: setting report, recent games, rating display."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.keys import col
from ..roles import SettingRoles
from ..session import materialize
from .columns import moved, reorder_column, tweaks_in_order
from .clean import label_games
from .joins import join_by_replay, translate_names
from .tiers import link_tier


# First lines of every setup text.
SETUP_HEADER = "!preset coop\n!draft_mode disabled\n!unit_market 1\n!teamsize 16\n"
SKIPPED_IN_SETUP = ("nuttyb_hp", "Barbarian Handicap", "Barbarian Per Player")


def group_link(ai: Column, difficulty: Column, index: Column, site: str) -> Column:
    """Address of one group row in the viewer."""
    return F.concat(
        F.lit(f"{site}/?view=gamesettings&ai="),
        ai,
        F.lit("&filter="),
        link_tier(difficulty),
        F.lit("&row="),
        index.cast("string"),
    )


def _setting_text(df: DataFrame, name: str) -> Column:
    value = col(name)
    if "_spawntimemult" in name:
        value = F.round(value.cast("double"), 1)
    return F.trim(value.cast("string"))


def setting_line(df: DataFrame, name: str, default: str | None, default_type: str | None) -> Column:
    """Command line for one setting, null when the setting need not be given."""
    text = _setting_text(df, name)
    given = text.isNotNull() & (text != "")
    if default is not None:
        switch = {"true": "1", "1": "1", "1.0": "1", "false": "0", "0": "0", "0.0": "0"}.get(str(default).lower())
        if default_type in ("bool", "number"):
            if switch is not None:
                given = given & (text != switch)
        else:
            given = given & (text != str(default))
    short = F.regexp_replace(text, r"\.0\s*$", "")
    if "multiplier_" in name:
        given = given & (short != "1")
    if "unit_restrictions_" in name:
        given = given & (short != "0")
    command = f"!bSet {name} " if "tweak" in name else f"!{name} "
    return F.when(given, F.concat(F.lit(command), short, F.lit("\n")))


def setup_text(
    groups: DataFrame,
    roles: SettingRoles,
    option_defaults: DataFrame,
    ai: Column,
    site: str,
    document: str = "",
    constants: Mapping[str, object] | None = None,
    map_column: str = "Map",
    out: str = "Copy Paste",
) -> DataFrame:
    """Add the text that sets up a lobby like the group.

    ``option_defaults`` holds ``key, type, def``; only the rows of the role
    columns are fetched, so their number is bounded by the columns of the table.
    """
    names = [c for c in tweaks_in_order(roles.settings) if c in groups.columns]
    wanted = option_defaults.where(F.col("key").isin(names)).select("key", "type", F.col("def").cast("string"))
    catalog = {r["key"]: (r["def"], r["type"]) for r in wanted.collect()}
    lines = [
        setting_line(groups, c, *catalog.get(c, (None, None))) for c in names if c not in SKIPPED_IN_SETUP
    ]
    maps = F.when(F.coalesce(col(map_column), F.lit("")) != "", F.concat(F.lit("!map "), col(map_column), F.lit("\n")))
    link = group_link(ai, F.col("Difficulty"), F.col("index"), site)
    told = constants or {}
    has_document = col("nuttyb_hp").isNotNull() if "nuttyb_hp" in groups.columns else F.lit(told.get("nuttyb_hp") is not None)
    welcome = F.concat(
        F.lit("$welcome-message Settings from "), link, F.when(has_document, F.lit(document)).otherwise(""), F.lit("\n")
    )
    modded = F.lit(any("tweak" in k and v not in (None, "") for k, v in told.items()))
    for name in groups.columns:
        if "tweak" in name:
            modded = modded | (F.coalesce(col(name).cast("string"), F.lit("")) != "")
    rename = F.when(modded, F.concat(F.lit("$rename [Modded] "), ai, F.lit("\n")))
    return groups.withColumn(out, F.concat_ws("", F.lit(SETUP_HEADER), maps, *lines, welcome, rename))


def recent_games(games: DataFrame, groups: DataFrame, names: DataFrame, n: int | None = None) -> DataFrame:
    """Labelled games, newest first, with the settings of their group; with ``n`` the newest ``n``.

    A cut to ``n`` comes before the joins: a game belongs to one group at most.
    """
    labelled = label_games(games).where(F.col("AI").isNotNull())
    labelled = labelled.withColumn("Map", tx.normalize_map_name(F.col("Map.scriptName")))
    base = labelled.select(
        "startTime", "AI", "id", "Result", F.col("players").alias("Players"), "Map", "Barbarian Handicap", "Barbarian Per Player"
    )
    newest = materialize(base if n is None else base.orderBy(F.col("startTime").desc(), F.col("id").desc()).limit(n))
    named = translate_names(newest, ["id"], "Players", names)
    found = groups.drop("Winners", "Merged Win Replays", "Merged Loss Replays")
    joined = join_by_replay(named, found, ["Win Replays", "Loss Replays"])
    shown = joined.withColumnsRenamed({"startTime": "Start Time", "id": "Replay ID"})
    shown = shown.orderBy(F.col("Start Time").desc(), F.col("Replay ID").desc())
    return reorder_column(reorder_column(shown, 11, "Barbarian Handicap"), 11, "Barbarian Per Player")


def explain_rating(ratings: DataFrame, keys: Sequence[str] = ("Player",), column: str = "Top-5 Difficulties") -> DataFrame:
    """Best groups of each player as rows, with a row of sums divided by 5.

    ``row`` numbers the groups from 1; the summary row has no index and comes last.
    """
    labels = [col(k) for k in keys]
    parts = F.arrays_zip(*[col(column)[f].alias(f) for f in ("diffs", "completions", "diff_completions", "indices")])
    rows = ratings.select(*labels, F.posexplode(parts).alias("place", "p")).select(
        *labels,
        (F.col("place") + 1).alias("row"),
        F.col("p.indices").alias("index"),
        F.col("p.diffs").cast("double").alias("diff"),
        F.col("p.completions").cast("double").alias("completion"),
        F.col("p.diff_completions").cast("double").alias("diff_completion"),
    )

    def fifth(field: str) -> Column:
        return F.aggregate(col(column)[field], F.lit(0.0), lambda a, x: a + x.cast("double")) / 5

    totals = ratings.select(
        *labels,
        (F.size(col(column)["diffs"]) + 1).alias("row"),
        F.lit(None).cast("int").alias("index"),
        fifth("diffs").alias("diff"),
        fifth("completions").alias("completion"),
        fifth("diff_completions").alias("diff_completion"),
    )
    return rows.unionByName(totals)


VIEWS = ("recent_games", "gamesettings", "ratings")


def display(df: DataFrame, view: str) -> DataFrame:
    """Cells as the viewer shows them, every plain column as text."""
    if view == "ratings":
        formats = {
            "PVE Rating": lambda c: tx.drop_zero_decimals(tx.fixed(c, 2)),
            "Award Rate": tx.percent,
            "Win Rate": tx.percent,
            "Difficulty Score": lambda c: tx.drop_zero_decimals(tx.fixed(F.coalesce(c.cast("double"), F.lit(0.0)) * 100, 1)),
            "Weighted Award Rate": tx.one_decimal,
        }
    else:
        formats = {
            "Difficulty": lambda c: F.when(c != 0, tx.percent(c, 2)),
            "Barbarian Per Player": tx.one_decimal,
        }
    shown = []
    for field in df.schema.fields:
        value = col(field.name)
        if field.name in formats:
            value = formats[field.name](value)
        elif isinstance(field.dataType, T.NumericType):
            value = tx.blank_zero(value)
        elif not isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            value = tx.blank_zero_text(value.cast("string"))
        shown.append(value.alias(field.name))
    return df.select(*shown)


def view_columns(columns: Sequence[str], view: str) -> list[str]:
    """Column order of a view."""
    order = list(columns)
    if view == "gamesettings":
        order = moved(moved(order, 3, "#Winners"), 4, "#Players")
    elif view == "ratings":
        order = moved(moved(order, 1, "Combined Rank"), 2, "PVE Rating")
    return order


def in_view_order(df: DataFrame, view: str) -> DataFrame:
    return df.select(*[col(c) for c in view_columns(df.columns, view)])


def lobby_summary(neighbours: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean difficulty and distance of the neighbours and mean rating of the lobby."""
    near = neighbours.agg(
        F.round(F.avg("Difficulty"), 1).alias("Difficulty"), F.round(F.avg("distance"), 1).alias("distance")
    )
    rated = ratings.agg(F.avg("PVE Rating").alias("PVE Rating"))
    one = F.lit(1).alias("_one")
    return near.select("*", one).join(rated.select("*", one), "_one").drop("_one")


