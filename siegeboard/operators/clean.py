"""Raw match details into typed, derived match rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matches as mx
from ..functions.keys import col
from ..functions.numeric import normalize_spawn_mult, quantize_1dp
from ..functions.ordinals import ordinal
from ..functions.text import normalize_map_name
from .columns import cast_strings, fill_defaults, narrow_integers, reorder_tweaks, schema_drift
from .joins import join_unique
from .settings import (
    INTEGER_COLUMNS,
    KNOWN_COLUMNS,
    LEVELS,
    ONE_DECIMAL_COLUMNS,
    SETTING_DEFAULTS,
    SPAWN_COLUMNS,
    TEXT_COLUMNS,
)


def parse_start_time(value: Column, lenient: bool = False) -> Column:
    """ISO-8601 text to a timestamp; bad text raises unless ``lenient``."""
    return value.try_cast("timestamp") if lenient else value.cast("timestamp")


def checked_level(value: Column, levels) -> Column:
    """The text itself, after checking that it is one of ``levels``."""
    return F.when(ordinal(value, levels) >= 0, value)


def cast_matches(df: DataFrame, drift: str = "report") -> DataFrame:
    """Typed settings: texts, narrow integers, one-decimal values, checked levels, defaults."""
    if drift == "fail":
        schema_drift(df, KNOWN_COLUMNS, "fail")
    typed = cast_strings(df, TEXT_COLUMNS)
    if dict(typed.dtypes).get("startTime") == "string":
        typed = typed.withColumn("startTime", parse_start_time(F.col("startTime")))
    typed = narrow_integers(typed, INTEGER_COLUMNS)
    changes: dict[str, Column] = {}
    for name in SPAWN_COLUMNS:
        if name in typed.columns:
            changes[name] = normalize_spawn_mult(col(name), F.col("startTime"))
    for name, levels in LEVELS.items():
        if name in typed.columns:
            changes[name] = checked_level(col(name), levels)
    for name in ONE_DECIMAL_COLUMNS:
        if name in typed.columns:
            changes[name] = quantize_1dp(col(name))
    typed = typed.withColumns(changes) if changes else typed
    switches = {c for c in TEXT_COLUMNS if c in LEVELS}
    defaults = {c: v for c, v in SETTING_DEFAULTS.items() if c not in switches}
    return reorder_tweaks(fill_defaults(typed, defaults))


def derive_ai_flags(df: DataFrame, teams: str = "AllyTeams") -> DataFrame:
    """Which AI sides took part and which of them won."""
    names = {"barbarian": "Barbarian", "raptors": "Raptors", "scavengers": "Scavengers"}
    flags: dict[str, Column] = {}
    for flag, label in names.items():
        flags[flag] = mx.has_ai(col(teams), mx.AI_NAMES[label])
    for flag, label in names.items():
        flags[f"{flag}_win"] = mx.ai_won(col(teams), mx.AI_NAMES[label])
    return df.withColumns(flags)


def derive_players(df: DataFrame, teams: str = "AllyTeams") -> DataFrame:
    return df.withColumns({"winners": mx.winner_ids(col(teams)), "players": mx.player_ids(col(teams))})


def derive_barbarian(df: DataFrame, teams: str = "AllyTeams") -> DataFrame:
    return df.withColumns(
        {
            "Barbarian Handicap": mx.barbarian_handicap(col(teams)),
            "Barbarian Per Player": mx.barbarian_per_player(col(teams)),
        }
    )


def derive_awards(df: DataFrame, teams: str = "AllyTeams") -> DataFrame:
    return df.withColumn("damage_eco_award", mx.award_owners(col(teams), F.col("awards")))


def backfill_map_name(df: DataFrame) -> DataFrame:
    if not {"Map Name", "Map"} <= set(df.columns):
        return df
    return df.withColumn("Map Name", F.coalesce(col("Map Name"), normalize_map_name(F.col("Map.scriptName"))))


def label_hp(df: DataFrame, tweaks: DataFrame) -> DataFrame:
    """Add the hp label of the tweak text; ``tweaks`` holds ``tweakdefs1, nuttyb_hp``."""
    if "nuttyb_hp" in df.columns or "tweakdefs1" not in df.columns:
        return df
    return join_unique(df, tweaks.select("tweakdefs1", "nuttyb_hp"), ["tweakdefs1"])


def derive_matches(df: DataFrame, tweaks: DataFrame | None = None) -> DataFrame:
    """Eligible matches with every derived column; award owners are unpacked."""
    from .filters import eligible_matches, no_player_handicap

    kept = no_player_handicap(eligible_matches(df))
    flagged = derive_ai_flags(kept)
    if tweaks is not None:
        flagged = label_hp(flagged, tweaks)
    full = derive_barbarian(derive_players(backfill_map_name(derive_awards(flagged))))
    return full


def label_games(df: DataFrame) -> DataFrame:
    """``AI`` label and ``Result`` from the players' side."""
    ai = (
        F.when(F.col("raptors"), "Raptors").when(F.col("scavengers"), "Scavengers").when(F.col("barbarian"), "Barbarian")
    )
    lost = F.col("raptors_win") | F.col("scavengers_win") | F.col("barbarian_win")
    draw = F.col("draw") if "draw" in df.columns else F.lit(False)
    result = F.when(lost, "Loss").when(draw, "Draw").otherwise("Win")
    return df.withColumns({"AI": ai, "Result": result})


def mark_refetch(df: DataFrame, settled: Column | None = None, need_map: bool = False) -> DataFrame:
    """Null ``fetch_success`` where details are incomplete; otherwise ``settled``."""
    missing = mx.first_award_value(F.col("awards")).isNull() | col("Map Name").isNull()
    if need_map:
        missing = missing | F.col("Map.scriptName").isNull()
    kept = F.col("fetch_success") if settled is None else settled
    return df.withColumn("fetch_success", F.when(~missing, kept))
