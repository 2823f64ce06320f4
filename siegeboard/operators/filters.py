"""Row filters over matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matches as mx
from ..functions.keys import col
from ..plans.joins import fits_broadcast


def eligible_matches(df: DataFrame, teams: str = "AllyTeams", duration: str = "durationMs") -> DataFrame:
    return df.where(mx.is_eligible(col(teams), col(duration)))


def no_player_handicap(df: DataFrame, teams: str = "AllyTeams") -> DataFrame:
    return df.where(~mx.has_handicap(col(teams)))


AI_FLAGS = {"Barbarian": "barbarian", "Raptors": "raptors", "Scavengers": "scavengers"}


def split_ai(df: DataFrame, ai: str) -> DataFrame:
    """Matches against this AI alone."""
    condition = F.lit(True)
    for name, flag in AI_FLAGS.items():
        condition = condition & (F.col(flag) if name == ai else ~F.col(flag))
    return df.where(condition)


def plain_barbarian(df: DataFrame) -> DataFrame:
    """Barbarian matches with human players and every multiplier at 1."""
    condition = F.abs(col("Barbarian Per Player")) != float("inf")
    for name in df.columns:
        if "multiplier_" in name:
            condition = condition & (col(name) == 1)
    return df.where(condition)


def missing_awards(df: DataFrame, awards: str = "awards") -> DataFrame:
    return df.where(mx.first_award_value(col(awards)).isNull())


def known_sources(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in any of the compared columns."""
    return df.dropna(subset=columns)


def lobby_players(ratings: DataFrame, lobby: DataFrame, name: str = "Player") -> DataFrame:
    """Ratings of the players in a lobby; host bots are left out.

    A lobby is small, but its size is counted before it is broadcast.
    """
    wanted = lobby.where(~F.col(name).startswith("Host[")).select(name).distinct()
    side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    return ratings.join(side, name, "left_semi")
