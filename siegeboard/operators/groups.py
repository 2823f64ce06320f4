"""Matches folded into setting groups: one group per map and settings vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import col, fingerprint
from ..functions.wordsets import word_bit, word_index
from ..roles import MatchColumns, SettingRoles


def with_group_key(matches: DataFrame, roles: SettingRoles, by: Sequence[str] = ()) -> DataFrame:
    """Add ``group_key``, the fingerprint of ``by``, map and settings."""
    return matches.withColumn("group_key", fingerprint([*by, *roles.keys]))


def lost_to_players(matches: MatchColumns) -> Column:
    """True for a match the players won, null when the outcome is unknown."""
    return ~col(matches.ai_win)


def group_table(
    keyed: DataFrame, roles: SettingRoles, matches: MatchColumns, by: Sequence[str] = ()
) -> DataFrame:
    """One row per group: its settings and match counts by outcome."""
    settings = [F.first(col(k)).alias(k) for k in [*by, *roles.keys]]
    return keyed.groupBy("group_key").agg(
        *settings,
        F.count(F.lit(1)).alias("n_matches"),
        F.count_if(lost_to_players(matches)).alias("n_wins"),
        F.count_if(col(matches.ai_win)).alias("n_losses"),
    )


def member_rows(keyed: DataFrame, matches: MatchColumns, *extra: str, key: str = "group_key") -> DataFrame:
    """One row per group, match and player, with ``won`` set for winners."""
    return (
        keyed.select(
            key,
            *[col(c) for c in extra],
            col(matches.ai_win).alias("ai_win"),
            F.coalesce(col(matches.winners), F.array().cast("array<bigint>")).alias("_winners"),
            F.explode(col(matches.players)).alias("player"),
        )
        .where(F.col("player").isNotNull())
        .withColumn("won", F.array_contains("_winners", F.col("player")))
        .drop("_winners")
    )


def member_words(keyed: DataFrame, matches: MatchColumns, key: str = "group_key") -> DataFrame:
    """Player sets of each group as words, split by what they are good for.

    ``own_*`` are the group's own winners and players. ``win_*`` and
    ``loss_players`` are what its won and lost matches hand on to other groups.
    """
    rows = member_rows(keyed, matches, key=key)
    bit = word_bit(F.col("player"))
    won, ai_win = F.col("won"), F.col("ai_win")
    return rows.groupBy(key, word_index(F.col("player")).alias("word")).agg(
        F.bit_or(F.when(won, bit)).alias("own_winners"),
        F.bit_or(bit).alias("own_players"),
        F.bit_or(F.when(won & ~ai_win, bit)).alias("win_winners"),
        F.bit_or(F.when(~ai_win, bit)).alias("win_players"),
        F.bit_or(F.when(ai_win, bit)).alias("loss_players"),
    )


def difficulty(n_winners: Column, n_players: Column) -> Column:
    """Share of a group's players who never won it, as a 32-bit float."""
    return (F.lit(1.0) - F.try_divide(n_winners.cast("double"), n_players.cast("double"))).cast("float")


def plain_difficulty(
    matches_df: DataFrame, roles: SettingRoles, matches: MatchColumns, by: Sequence[str] = ()
) -> DataFrame:
    """Difficulty per group from the group's own matches only."""
    keyed = with_group_key(matches_df, roles, by)
    sizes = member_words(keyed, matches).groupBy("group_key").agg(
        F.coalesce(F.sum(F.bit_count("own_winners")), F.lit(0)).alias("#Winners"),
        F.sum(F.bit_count("own_players")).alias("#Players"),
    )
    return (
        group_table(keyed, roles, matches, by)
        .join(sizes, "group_key", "left")
        .na.fill(0, ["#Winners", "#Players"])
        .withColumn("Difficulty", difficulty(F.col("#Winners"), F.col("#Players")))
    )


def ordered_group_members(
    keyed: DataFrame, matches: MatchColumns, winners_only: bool = False
) -> DataFrame:
    """Distinct players of each group with the place where each first appears.

    Matches are walked by damage value from the top, unknown values first, then
    by id; players inside a match by list place. The place is the sort key
    ``first_seen``; ordering a group by it gives the report order.
    """
    source = col(matches.winners if winners_only else matches.players)
    seen = keyed.select(
        "group_key",
        col(matches.damage_value).alias("damage"),
        col(matches.id).alias("match"),
        F.posexplode(source).alias("place", "player"),
    ).where(F.col("player").isNotNull())
    first = F.min(F.struct((-F.col("damage")).alias("minus_damage"), "match", "place"))
    return seen.groupBy("group_key", "player").agg(first.alias("first_seen"))


def own_replays(keyed: DataFrame, matches: MatchColumns) -> DataFrame:
    """Match ids of each group by kind with their report order.

    Won matches go by damage value from the top with unknown values first, lost
    ones by duration from the longest.
    """
    won = lost_to_players(matches)
    return keyed.where(col(matches.ai_win).isNotNull()).select(
        "group_key",
        F.when(won, "Win").otherwise("Loss").alias("kind"),
        col(matches.id).alias("replay"),
        F.when(won, -col(matches.damage_value).cast("double"))
        .otherwise(-col(matches.duration).cast("double"))
        .alias("sort_value"),
    )


def list_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str):
    """Gather report lists: per key, the values of ``value`` sorted by ``order``.

    The list is one cell of a published row, so it is as long as the report
    wants it to be; nothing but report tables should call this.
    """
    packed = F.sort_array(F.collect_list(F.struct(*order, col(value).alias("_value"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda x: x["_value"]).alias(out))
