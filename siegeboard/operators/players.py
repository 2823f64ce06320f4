"""Player statistics, best completions and ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import col, fingerprint
from ..functions.numeric import required_teammates
from ..functions.wordsets import word_members
from ..plans.joins import join_lookup
from ..roles import MatchColumns
from ..session import materialize, store
from .carry import union_sizes
from .dominance import ExtendedGroups
from .groups import with_group_key
from .tiers import with_ends
from .ranking import (
    average_ranks,
    combined_rank,
    games_label,
    min_max_rating,
    smallest_per,
    top_k_per,
    with_row_index,
)

TOP_GROUPS = 5


def player_stats(matches_df: DataFrame, matches: MatchColumns, by: Sequence[str] = ()) -> DataFrame:
    """Games, win rate and award rates per player.

    An award counts in won matches with more than one player; the weighted rate
    multiplies a match's awards by the number of teammates.
    """
    size = F.size(col(matches.players))
    player = F.col("Player")
    rows = matches_df.select(
        *[col(b) for b in by],
        size.alias("_size"),
        col(matches.damage).alias("_damage"),
        col(matches.eco).alias("_eco"),
        F.coalesce(col(matches.winners), F.array().cast("array<bigint>")).alias("_winners"),
        F.explode(col(matches.players)).alias("Player"),
    ).where(player.isNotNull())
    won = F.array_contains("_winners", player)
    awards = F.when(player == F.col("_damage"), 1).otherwise(0) + F.when(player == F.col("_eco"), 1).otherwise(0)
    counted = F.when(won & (F.col("_size") > 1), awards)
    return rows.groupBy(*[col(b) for b in by], "Player").agg(
        F.count(F.lit(1)).alias("n_games"),
        F.avg(won.cast("int")).cast("float").alias("Win Rate"),
        F.avg(counted).cast("float").alias("Award Rate"),
        F.coalesce(F.avg(counted * (F.col("_size") - 1)), F.lit(0.0)).cast("float").alias("Weighted Award Rate"),
    )


def settings_won(extended: ExtendedGroups, by: Sequence[str] = ()) -> DataFrame:
    """Number of groups each player has won in own matches (``#Settings``)."""
    return own_wins(extended, by).groupBy(*[col(b) for b in by], "Player").agg(F.count(F.lit(1)).alias("#Settings"))


def own_wins(extended: ExtendedGroups, by: Sequence[str]) -> DataFrame:
    """One row per group and player who won it."""
    labels = extended.state.groups.select("gid", *[col(b) for b in by])
    wins = extended.own_words.where(F.col("own_winners").isNotNull()).select(
        "gid", F.explode(word_members(F.col("word"), F.col("own_winners"))).alias("Player")
    )
    return wins.join(labels, "gid") if by else wins


def losers_sum(extended: ExtendedGroups, by: Sequence[str] = ()) -> DataFrame:
    """Distinct players who played but never won a group that the player won.

    Players who won the same groups share one answer. Which records are the same is told by a
    fingerprint that sums up in any order (count, xor and sum of the groups' hashes); one list of
    groups for each different record meets the loser sets, slice by slice of their words.
    """
    labels = [col(b) for b in by]
    side = F.xxhash64(*labels).alias("bucket") if by else F.lit(0).cast("long").alias("bucket")
    never_won = F.col("players").bitwiseAND(F.bitwise_not(F.coalesce("own_winners", F.lit(0).cast("long"))))
    lost = extended.words.select("gid", "word", never_won.alias("bits")).where(F.col("bits") != 0)
    sides = extended.state.groups.select("gid", side)
    wins = own_wins(extended, by)
    records = store(wins.groupBy(*labels, "Player").agg(*_set_fingerprint("gid"), F.collect_list("gid").alias("groups")))
    different = records.groupBy(*PRINT).agg(F.first(side).alias("bucket"), F.first("groups").alias("groups"))
    sums = union_sizes(join_lookup(lost, sides, ["gid"], "inner"), store(different), PRINT)
    counted = sums.withColumnRenamed("size", "Difficulty Losers Sum")
    return records.drop("groups").join(counted, list(PRINT), "left").na.fill(0, ["Difficulty Losers Sum"]).drop(*PRINT)


#: Columns of a set fingerprint.
PRINT = ("members", "mixed", "summed")


def _set_fingerprint(member: str) -> list[Column]:
    """Aggregates that are equal for equal sets, whatever the order: number, xor and sum of two hashes of the members."""
    return [
        F.count(F.lit(1)).alias(PRINT[0]),
        F.bit_xor(F.xxhash64(member)).alias(PRINT[1]),
        F.sum(F.xxhash64(F.lit(1), member).cast("decimal(20,0)")).alias(PRINT[2]),
    ]


def setting_index(extended: ExtendedGroups, by: Sequence[str] = ()) -> DataFrame:
    """Sized groups numbered from the hardest: difficulty, players, map, then settings."""
    roles = extended.state.roles
    order = [
        F.col("Difficulty").desc_nulls_last(),
        F.col("#Players").desc(),
        *[col(k).asc_nulls_first() for k in roles.keys],
    ]
    return with_row_index(extended.sized, order, by)


def tier_counts(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` group: difficulty ends and the number of groups at the top and between."""
    labels = [col(b) for b in by]
    joined = with_ends(groups, by)
    d = F.col("Difficulty")
    return joined.groupBy(*labels, "low", "high").agg(
        F.count_if(d == F.col("high")).alias("n_unbeaten"),
        F.count_if((d > F.col("low")) & (d < F.col("high"))).alias("n_regular"),
    )


def closed_completion(level: Column, lobby: Column, lists: Column) -> Column:
    """Completion of a group all of whose matches have the same ``lobby`` winners.

    Each of the ``lists`` matches adds the player, the first adds all teammates
    too; a solo lobby is complete at once.
    """
    share = level * (lobby + lists - 1).cast("double") / required_teammates(lobby)
    return F.when(lobby == 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def unmatched_completions(extended: ExtendedGroups, matches_df: DataFrame, matches: MatchColumns, by: Sequence[str] = ()) -> DataFrame:
    """Completion per group and player for groups with an unknown compared setting.

    Such a group hands nothing to its own matches, so the matches differ: match
    ``i`` has its own winners plus the carried ones ``E``. Walking the matches from the
    highest damage, a match adds ``level * (new teammates + 1) / required``,
    and the total is capped at 1. The sum is built from first meetings: every teammate
    counts once, at the first match that has both players.
    """
    roles = extended.state.roles
    open_groups = extended.sized.where(~F.col("is_source")).select(
        "group_key", "gid", F.col("Difficulty").cast("double").alias("level")
    )
    carried = extended.words.where(F.col("carried").isNotNull()).join(open_groups, "gid", "left_semi").select(
        "gid", F.explode(word_members(F.col("word"), F.col("carried"))).alias("player")
    )
    carried_size = carried.groupBy("gid").agg(F.count(F.lit(1)).alias("n_carried"))
    order = F.struct((-col(matches.damage_value)).alias("minus_damage"), col(matches.id).alias("match"))
    own = F.coalesce(col(matches.winners), F.array().cast("array<bigint>"))
    keyed = with_group_key(matches_df, roles, by).select("group_key", order.alias("at"), own.alias("own"))
    walked = keyed.join(open_groups, "group_key").join(carried_size, "gid", "left").na.fill(0, ["n_carried"])
    in_match = walked.select("gid", "at", F.explode("own").alias("player"))
    fresh = in_match.join(carried, ["gid", "player"], "left_anti")
    fresh_lists = fresh.groupBy("gid", "at").agg(F.collect_set("player").alias("fresh"))
    lists = (
        walked.select("gid", "level", "at", "n_carried")
        .join(fresh_lists, ["gid", "at"], "left")
        .withColumn("lobby", F.col("n_carried") + F.coalesce(F.size("fresh"), F.lit(0)))
        .where(F.col("lobby") > 0)
        .withColumn("unit", F.try_divide(F.lit(1.0), required_teammates(F.col("lobby"))))
        .withColumn("solo", F.col("lobby") == 1)
    )
    firsts = [
        F.sum("unit").alias("me"),
        F.min_by("unit", "at").alias("first_unit"),
        F.bool_or("solo").alias("solo"),
        F.first("level").alias("level"),
        F.first("n_carried").alias("n_carried"),
    ]

    def total(mates: Column) -> Column:
        summed = F.col("level") * (F.col("me") + mates + F.coalesce("met", F.lit(0.0)))
        return F.when(F.col("solo"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), summed)).alias("completion")

    exploded = lists.select("gid", "at", "unit", "solo", "level", "n_carried", "fresh", F.explode("fresh").alias("Player"))
    met_any = (
        exploded.groupBy("gid", "Player").agg(F.min_by("unit", "at").alias("u")).groupBy("gid").agg(F.sum("u").alias("met"))
    )
    for_carried = (
        lists.groupBy("gid").agg(*firsts)
        .join(met_any, "gid", "left")
        .join(carried.withColumnRenamed("player", "Player"), "gid")
        .select("gid", "Player", total((F.col("n_carried") - 1) * F.col("first_unit")))
    )
    met_mates = (
        exploded.select("gid", "at", "unit", "Player", F.explode("fresh").alias("mate"))
        .where(F.col("mate") != F.col("Player"))
        .groupBy("gid", "Player", "mate").agg(F.min_by("unit", "at").alias("u"))
        .groupBy("gid", "Player").agg(F.sum("u").alias("met"))
    )
    for_own = (
        exploded.groupBy("gid", "Player").agg(*firsts)
        .join(met_mates, ["gid", "Player"], "left")
        .select("gid", "Player", total(F.col("n_carried") * F.col("first_unit")))
    )
    return for_carried.unionByName(for_own)


def completions(
    extended: ExtendedGroups,
    indexed: DataFrame,
    matches_df: DataFrame,
    matches: MatchColumns,
    by: Sequence[str] = (),
    k: int = TOP_GROUPS,
) -> DataFrame:
    """The ``k`` best groups of each player by difficulty times completion.

    In a group without unknown settings all winners, own or carried, have the
    same completion, so the best ``k`` of a player are among the best ``k`` that each of
    the player's won groups reaches; membership lists are never expanded, and what
    is not among a player's best is dropped before the wins are dealt by player.
    Ties go to the smaller index.
    """
    level = F.col("Difficulty").cast("double")
    best_first = [F.col("diff_completion").desc(), F.col("index").asc()]
    facts = ["index", "diff", "completion", "diff_completion"]
    scored = (
        indexed.where(F.col("is_source") & (F.col("#Winners") > 0))
        .withColumn("diff", level)
        .withColumn("completion", closed_completion(level, F.col("#Winners"), F.col("n_matches")))
        .withColumn("diff_completion", F.col("diff") * F.col("completion"))
    )
    # One number a group, the better the smaller: what a win leads to travels as a short list of them.
    numbered = with_row_index(scored, [*[col(b) for b in by], *best_first], name="best")
    pairs = extended.pairs.where("easier").select("source", "gid").join(numbered.select("gid", "best"), "gid")
    side = F.xxhash64(*[col(b) for b in by]) if by else F.lit(0).cast("long")
    labels = extended.state.groups.select(F.col("gid").alias("source"), side.alias("side"))
    reached = join_lookup(
        top_k_per(pairs, ["source"], [F.col("best").asc()], k).groupBy("source").agg(F.collect_list("best").alias("bests")), labels, ["source"], "inner"
    )
    wins = extended.own_words.where(F.col("win_winners").isNotNull()).select(
        F.col("gid").alias("source"), F.explode(word_members(F.col("word"), F.col("win_winners"))).alias("Player")
    )
    reachable = join_lookup(wins, reached, ["source"], "inner").select("side", "Player", "bests")
    kept = smallest_per(reachable, ["side", "Player"], "bests", k)
    found = join_lookup(kept.withColumnRenamed("value", "best"), numbered.select(*[col(b) for b in by], "gid", *facts, "best"), ["best"], "inner").select(
        *[col(b) for b in by], "Player", "gid", *facts
    )
    if extended.state.groups.where(~F.col("is_source")).limit(1).count():
        groups = indexed.select("gid", *[col(b) for b in by], "index", level.alias("diff"))
        single = unmatched_completions(extended, matches_df, matches, by).join(groups, "gid")
        single = single.withColumn("diff_completion", F.col("diff") * F.col("completion"))
        found = found.unionByName(single.select(*found.columns))
    return top_k_per(found, [*by, "Player"], best_first, k)


def top_difficulties(best: DataFrame, counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best groups packed per player, with row numbers local to the tier tables."""
    labels = [col(b) for b in by]
    placed = join_lookup(best, counts, list(by))
    local = (
        F.col("index")
        - F.when(F.col("diff") < 1, F.col("n_unbeaten")).otherwise(0)
        - F.when(F.col("diff") == 0, F.col("n_regular")).otherwise(0)
    )
    rows = F.array_sort(
        F.collect_list(F.struct("place", "diff", "completion", "diff_completion", local.cast("int").alias("index")))
    )
    packed = placed.groupBy(*labels, "Player").agg(rows.alias("_rows"))

    def field(name: str, kind: str = "float") -> Column:
        return F.transform("_rows", lambda r: r[name].cast(kind))

    score = F.aggregate("_rows", F.lit(0.0), lambda a, r: a + r["diff_completion"]) / TOP_GROUPS
    return packed.select(
        *labels,
        "Player",
        F.struct(
            field("diff").alias("diffs"),
            field("completion").alias("completions"),
            field("diff_completion").alias("diff_completions"),
            field("index", "int").alias("indices"),
        ).alias("Top-5 Difficulties"),
        score.alias("score"),
    )


def player_ratings(
    extended: ExtendedGroups,
    matches_df: DataFrame,
    matches: MatchColumns,
    by: Sequence[str],
    indexed: DataFrame | None = None,
    stats_from: DataFrame | None = None,
) -> DataFrame:
    """The rating table: rates, best groups, ranks, combined rank and rating.

    ``stats_from`` gives the matches behind the player rates when they are
    more than the grouped ones.
    """
    all_games = matches_df if stats_from is None else stats_from
    numbered = setting_index(extended, by) if indexed is None else indexed
    best = completions(extended, numbered, matches_df, matches, by)
    tops = top_difficulties(best, tier_counts(numbered, by), by)
    key = [*by, "Player"]
    joined = (
        tops.join(losers_sum(extended, by), key, "left")
        .join(settings_won(extended, by), key, "left")
        .join(player_stats(all_games, matches, by), key, "left")
        .na.fill(0, ["Difficulty Losers Sum", "#Settings"])
        .withColumn("clipped_games", F.least(F.col("n_games"), F.lit(20)))
    )
    stored = materialize(joined)
    ranked = average_ranks(
        stored,
        ["Player"],
        {
            "Weighted Award Rate": "Weighted Award Rate Rank",
            "score": "Difficulty Score Rank",
            "Difficulty Losers Sum": "Difficulty Losers Sum Rank",
            "clipped_games": "#Games Rank",
            "#Settings": "Setting Combinations Rank",
            "Win Rate": "Win Rate Rank",
        },
        by,
    )
    blended = materialize(combined_rank(ranked, ["Player"], by))
    rated = min_max_rating(blended, by, "Combined Rank", "PVE Rating")
    return (
        rated.withColumn("Difficulty Score", F.col("score").cast("float"))
        .withColumn("#Games", games_label(F.col("n_games")))
        .drop("score", "clipped_games", "n_games")
        .select(*[col(b) for b in by], *[col(c) for c in RATING_COLUMNS])
    )


# Columns of the rating table in published order.
RATING_COLUMNS = [
    "Player",
    "Award Rate",
    "Weighted Award Rate",
    "Difficulty Score",
    "Top-5 Difficulties",
    "Difficulty Losers Sum",
    "#Settings",
    "#Games",
    "Win Rate",
    "Weighted Award Rate Rank",
    "Difficulty Score Rank",
    "Difficulty Losers Sum Rank",
    "#Games Rank",
    "Setting Combinations Rank",
    "Win Rate Rank",
    "Combined Rank",
    "PVE Rating",
]
