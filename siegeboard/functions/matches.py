"""Expressions over the nested team records of a match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# AI names in the records and the labels used for them.
AI_NAMES = {"Barbarian": "BARb", "Raptors": "RaptorsAI", "Scavengers": "ScavengersAI"}




def has_ai(teams: Column, name: str) -> Column:
    return F.exists(teams, lambda t: F.coalesce(F.exists(t["AIs"], lambda a: F.coalesce(a["shortName"] == name, F.lit(False))), F.lit(False)))


def ai_won(teams: Column, name: str) -> Column:
    return F.exists(
        teams,
        lambda t: F.coalesce(
            t["winningTeam"] & F.exists(t["AIs"], lambda a: F.coalesce(a["shortName"] == name, F.lit(False))),
            F.lit(False),
        ),
    )


def is_eligible(teams: Column, duration: Column) -> Column:
    """Known AIs only, positive length, a winner, at most two teams, no mixed team."""
    known_ais = F.forall(
        teams,
        lambda t: F.coalesce(
            F.forall(t["AIs"], lambda a: a["shortName"].isNull() | a["shortName"].isin(*AI_NAMES.values())),
            F.lit(True),
        ),
    )
    unmixed = F.forall(
        teams,
        lambda t: (F.coalesce(F.size(t["Players"]), F.lit(0)) <= 0) | (F.coalesce(F.size(t["AIs"]), F.lit(0)) <= 0),
    )
    decided = F.exists(teams, lambda t: F.coalesce(t["winningTeam"], F.lit(False)))
    return known_ais & (duration > 0) & decided & (F.size(teams) < 3) & unmixed


def has_handicap(teams: Column) -> Column:
    return F.exists(
        teams,
        lambda t: F.coalesce(F.exists(t["Players"], lambda p: F.coalesce(p["handicap"] > 0, F.lit(False))), F.lit(False)),
    )


def player_records(teams: Column) -> Column:
    """All player structs of a match in team order."""
    return F.flatten(F.filter(F.transform(teams, lambda t: t["Players"]), lambda p: p.isNotNull()))


def _ids(players: Column) -> Column:
    return F.filter(F.transform(players, lambda p: p["userId"].cast("bigint")), lambda u: u.isNotNull())


def player_ids(teams: Column) -> Column:
    return _ids(player_records(teams))


def winner_ids(teams: Column) -> Column:
    return _ids(player_records(F.filter(teams, lambda t: F.coalesce(t["winningTeam"], F.lit(False)))))


def ai_records(teams: Column, name: str) -> Column:
    every = F.flatten(F.filter(F.transform(teams, lambda t: t["AIs"]), lambda a: a.isNotNull()))
    return F.filter(every, lambda a: F.coalesce(a["shortName"] == name, F.lit(False)))


def barbarian_handicap(teams: Column) -> Column:
    """Rounded mean handicap of the barbarian AIs, null without any."""
    given = F.filter(
        F.transform(ai_records(teams, AI_NAMES["Barbarian"]), lambda a: a["handicap"].cast("double")),
        lambda h: h.isNotNull(),
    )
    mean = F.try_divide(F.aggregate(given, F.lit(0.0), lambda x, h: x + h), F.size(given).cast("double"))
    return F.when(has_ai(teams, AI_NAMES["Barbarian"]), F.round(mean, 0).cast("smallint"))


def barbarian_per_player(teams: Column) -> Column:
    """Barbarian AIs per human player, 1 decimal; infinite without humans."""
    ais = F.size(ai_records(teams, AI_NAMES["Barbarian"])).cast("double")
    humans = F.size(player_records(teams)).cast("double")
    ratio = F.round(F.try_divide(ais, humans), 1)
    alone = F.when(ais > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(humans == 0, alone).otherwise(ratio).cast("float")


def award_owners(teams: Column, awards: Column) -> Column:
    """Users behind the damage and economy awards.

    A team id held by several players belongs to the last of them. Without a
    known owner the damage value is null too.
    """
    players = player_records(teams)

    def owner(team_id: Column) -> Column:
        held = F.filter(players, lambda p: F.coalesce(p["teamId"] == team_id, F.lit(False)))
        return F.try_element_at(held, F.lit(-1))["userId"].cast("bigint")

    top = F.try_element_at(awards["fightingUnitsDestroyed"], F.lit(1))
    damage = owner(top["teamId"])
    packed = F.struct(
        damage.alias("damage_award"),
        F.when(damage.isNotNull(), top["value"].cast("bigint")).alias("damage_award_value"),
        owner(awards["mostResourcesProduced"]["teamId"]).alias("eco_award"),
    )
    return F.when(teams.isNotNull() & awards.isNotNull(), packed)


def first_award_value(awards: Column) -> Column:
    return F.try_element_at(awards["fightingUnitsDestroyed"], F.lit(1))["value"]
