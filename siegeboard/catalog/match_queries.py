"""Queries of the match operators on the match view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import col
from ..operators import groups as gr
from ..operators import players as pl
from ..operators.dominance import ExtendedGroups, extend_results, merged_replays, ordered_members
from ..operators.ranking import average_ranks
from ..operators.report import display, explain_rating, group_link
from ..operators.tiers import tiered, tiered_sample
from ..session import materialize, store
from . import viewsql as vs
from .matchview import VIEW_COLUMNS, VIEW_ROLES, match_view, table
from .registry import query

BY = ("ai",)


def settings() -> list:
    """Key columns in one type family for comparing."""
    texts = ("ai", "map_name", "tweakunits")
    return [col(k) if k in texts else col(k).cast("bigint").alias(k) for k in vs.KEYS]


SETTINGS_SQL = ", ".join(
    k if k in ("ai", "map_name", "tweakunits") else f"cast({k} as bigint) {k}" for k in vs.KEYS
)
SIZES_SQL = (
    "cast(n_winners as bigint) n_winners, cast(n_players as bigint) n_players, "
    "round(cast(difficulty as double), 6) difficulty"
)
LABEL_SQL = "concat_ws('|', " + ", ".join(f"coalesce(cast(k.{k} as varchar), '-')" for k in vs.KEYS) + ")"


def label() -> F.Column:
    return F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("-")) for k in vs.KEYS]).alias("group_label")


def sizes() -> list:
    return [
        col("#Winners").cast("bigint").alias("n_winners"),
        col("#Players").cast("bigint").alias("n_players"),
        F.round(F.col("Difficulty").cast("double"), 6).alias("difficulty"),
    ]


def extended(spark: SparkSession, sf: str) -> tuple[ExtendedGroups, DataFrame]:
    games = store(match_view(spark, sf).repartition("id"))
    return extend_results(games, VIEW_ROLES, VIEW_COLUMNS, BY), games


@query(
    "difficulty_plain",
    vs.GROUPS
    + f""" select {SETTINGS_SQL}, cast(n_matches as bigint) n_matches, {SIZES_SQL} from (
      select k.*, w n_winners, n n_players, cast(1.0::double - w::double / n::double as float) difficulty
      from k join (select gid, count(distinct p) filter (not ai_win) w, count(distinct p) n from own group by gid) using (gid))""",
)
def difficulty_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Difficulty per setting group from its own matches."""
    groups = gr.plain_difficulty(match_view(spark, sf), VIEW_ROLES, VIEW_COLUMNS, BY)
    return groups.select(*settings(), "n_matches", *sizes())


@query("difficulty_extended", vs.EXTENDED + f" select {SETTINGS_SQL}, {SIZES_SQL} from sized")
def difficulty_extended(spark: SparkSession, sf: str) -> DataFrame:
    """Difficulty per setting group after carrying results over."""
    state, _ = extended(spark, sf)
    return state.sized.select(*settings(), *sizes())


@query(
    "difficulty_tiers",
    vs.INDEXED
    + f""" select {SETTINGS_SQL}, {SIZES_SQL}, tier from (
      select s.*, unnest(list_filter([case when difficulty = high then 'unbeaten' end,
        case when difficulty > low and difficulty < high then 'regular' end,
        case when difficulty = low then 'cheese' end], lambda x: x is not null)) tier
      from sized s join ends using (ai))""",
)
def difficulty_tiers(spark: SparkSession, sf: str) -> DataFrame:
    state, _ = extended(spark, sf)
    return tiered(state.sized, BY).select(*settings(), *sizes(), "tier")


@query(
    "tiered_sample",
    vs.EXTENDED
    + f""", hard as (select * from sized where difficulty = 1 order by n_players desc, {vs.KEY_LIST.replace("nuttyb_hp", "nuttyb_hp nulls first")} limit 50),
    mid as (select * from sized where difficulty > 0 and difficulty < 1),
    easy as (select * from sized where difficulty = (select min(difficulty) from sized)
      order by n_players desc, {vs.KEY_LIST.replace("nuttyb_hp", "nuttyb_hp nulls first")} limit 10)
    select {SETTINGS_SQL}, {SIZES_SQL} from (select * from hard union all select * from mid union all select * from easy)""",
)
def tiered_sample_query(spark: SparkSession, sf: str) -> DataFrame:
    state, _ = extended(spark, sf)
    ties = [col(k).asc_nulls_first() for k in vs.KEYS]
    return tiered_sample(state.sized, ties, 50, 10).select(*settings(), *sizes())


@query(
    "merged_replays",
    vs.GROUPS
    + f""" select {LABEL_SQL} group_label, kind, replay from k join (
      select t.gid, 'Win' kind, m.id replay from k s join k t on {vs.pair_condition(True)} join gk m on m.gid = s.gid and not m.ai_win
      union all
      select t.gid, 'Loss', m.id from k s join k t on {vs.pair_condition(False)} join gk m on m.gid = s.gid and m.ai_win) using (gid)""",
)
def merged_replays_query(spark: SparkSession, sf: str) -> DataFrame:
    """Replays of other groups that count for a group, one row each."""
    state, games = extended(spark, sf)
    replays = gr.own_replays(gr.with_group_key(games, VIEW_ROLES, BY), VIEW_COLUMNS)
    return merged_replays(state, replays, state.state.groups.select("gid", label())).select("group_label", "kind", "replay")


@query(
    "own_replays",
    vs.GROUPS
    + f""" select {LABEL_SQL} group_label, case when ai_win then 'Loss' else 'Win' end kind, gk.id replay,
      cast(case when ai_win then -duration else -damage_value end as double) sort_value from gk join k using (gid)""",
)
def own_replays_query(spark: SparkSession, sf: str) -> DataFrame:
    keyed = gr.with_group_key(match_view(spark, sf), VIEW_ROLES, BY)
    rows = gr.own_replays(keyed, VIEW_COLUMNS)
    groups = gr.group_table(keyed, VIEW_ROLES, VIEW_COLUMNS, BY)
    return rows.join(groups, "group_key").select(label(), "kind", "replay", "sort_value")


@query(
    "ordered_winners",
    vs.GROUPS
    + f""", top as (select gid, arg_min(id, (-damage_value, id)) top_id from gk group by gid),
    seats as (select gid, id, start_time, ai_win, unnest(players) p, generate_subscripts(players, 1) - 1 place from gk),
    src as (select gid, p, min((1, start_time, id, place)) pos from seats where not ai_win group by 1, 2),
    rows as (
      select s.gid, s.p, case when s.id = t.top_id then (0, start_time, id, place) else (1, start_time, id, place) end pos
        from seats s join top t using (gid) where not s.ai_win
      union all
      select t.gid, o.p, o.pos from k s join k t on {vs.pair_condition(True)} join src o on o.gid = s.gid),
    firsts as (select gid, p, min(pos) pos from rows group by 1, 2)
    select {LABEL_SQL} group_label, p player, pos[1] part, strftime(pos[2], '%Y-%m-%d') first_start, pos[3] first_match,
      pos[4] place from firsts join k using (gid)""",
)
def ordered_winners(spark: SparkSession, sf: str) -> DataFrame:
    """Winners of every group, own and carried, with their report order."""
    state, games = extended(spark, sf)
    rows = ordered_members(state, games, VIEW_COLUMNS, BY, winners_only=True)
    return rows.join(state.state.groups, "gid").select(
        label(),
        "player",
        F.col("first_seen.part").alias("part"),
        F.date_format("first_seen.start", "yyyy-MM-dd").alias("first_start"),
        F.col("first_seen.match").alias("first_match"),
        F.col("first_seen.place").cast("bigint").alias("place"),
    )


@query(
    "group_member_order",
    vs.GROUPS
    + f""" select {LABEL_SQL} group_label, p player, pos[1] minus_damage, pos[2] first_match, cast(pos[3] as bigint) place from (
      select gid, p, min((-damage_value, id, place)) pos from (
        select gid, id, damage_value, unnest(players) p, generate_subscripts(players, 1) - 1 place from gk) group by 1, 2)
      join k using (gid)""",
)
def group_member_order(spark: SparkSession, sf: str) -> DataFrame:
    """Own players of every group by first appearance in damage order."""
    keyed = gr.with_group_key(match_view(spark, sf), VIEW_ROLES, BY)
    rows = gr.ordered_group_members(keyed, VIEW_COLUMNS)
    groups = gr.group_table(keyed, VIEW_ROLES, VIEW_COLUMNS, BY)
    return rows.join(groups, "group_key").select(
        label(),
        "player",
        F.col("first_seen.minus_damage").alias("minus_damage"),
        F.col("first_seen.match").alias("first_match"),
        F.col("first_seen.place").cast("bigint").alias("place"),
    )


def rounded(name: str, alias: str, digits: int = 4):
    return F.round(col(name).cast("double"), digits).alias(alias)


@query(
    "player_stats",
    vs.MATCHES
    + vs.STATS
    + """ select ai, player, cast(n_games as bigint) n_games, round(win_rate::double, 4) win_rate,
      round(award_rate::double, 4) award_rate, round(weighted::double, 4) weighted from stats""",
)
def player_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = pl.player_stats(match_view(spark, sf), VIEW_COLUMNS, BY)
    return stats.select(
        "ai",
        F.col("Player").alias("player"),
        "n_games",
        rounded("Win Rate", "win_rate"),
        rounded("Award Rate", "award_rate"),
        rounded("Weighted Award Rate", "weighted"),
    )


@query(
    "losers_sum",
    vs.RATED + " select ai, player, cast(coalesce(l.n, 0) as bigint) losers from won left join losers l using (ai, player)",
)
def losers_sum(spark: SparkSession, sf: str) -> DataFrame:
    state, _ = extended(spark, sf)
    return pl.losers_sum(state, BY).select("ai", F.col("Player").alias("player"), F.col("Difficulty Losers Sum").alias("losers"))


@query(
    "settings_won",
    vs.GROUPS
    + """ select ai, p player, count(distinct gid) settings from (select distinct gid, p from own where not ai_win) join k using (gid) group by 1, 2""",
)
def settings_won(spark: SparkSession, sf: str) -> DataFrame:
    state, _ = extended(spark, sf)
    return pl.settings_won(state, BY).select("ai", F.col("Player").alias("player"), F.col("#Settings").alias("settings"))


@query("setting_index", vs.INDEXED + f" select {SETTINGS_SQL}, {SIZES_SQL}, cast(idx as bigint) idx from numbered")
def setting_index(spark: SparkSession, sf: str) -> DataFrame:
    """Row numbers of the report without a single-task sort."""
    state, _ = extended(spark, sf)
    return pl.setting_index(state, BY).select(*settings(), *sizes(), F.col("index").alias("idx"))


def best_groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    state, games = extended(spark, sf)
    indexed = materialize(pl.setting_index(state, BY))
    return pl.completions(state, indexed, games, VIEW_COLUMNS, BY), indexed


@query(
    "top5_score",
    vs.BEST
    + """ select ai, player, cast(place as bigint) place, cast(idx as bigint) idx, round(diff, 6) diff,
      round(completion, 6) completion, round(diff_completion, 6) diff_completion from best""",
)
def top5_score(spark: SparkSession, sf: str) -> DataFrame:
    best, _ = best_groups(spark, sf)
    return best.select(
        "ai",
        F.col("Player").alias("player"),
        F.col("place").cast("bigint").alias("place"),
        F.col("index").alias("idx"),
        *[F.round(c, 6).alias(c) for c in ("diff", "completion", "diff_completion")],
    )


@query(
    "explain_rating",
    vs.BEST
    + """, shown as (select ai, player, place, cast(idx - case when diff < 1 then n_unbeaten else 0 end
        - case when diff = 0 then n_regular else 0 end as bigint) idx, diff::float::double diff,
        completion::float::double completion, diff_completion::float::double diff_completion
      from best join tier_sizes using (ai))
    select ai, player, cast(place as bigint) "row", idx, round(diff, 5) diff, round(completion, 5) completion,
      round(diff_completion, 5) diff_completion from shown
    union all
    select ai, player, cast(count(*) + 1 as bigint), null, round(sum(diff) / 5, 5), round(sum(completion) / 5, 5),
      round(sum(diff_completion) / 5, 5) from shown group by ai, player""",
)
def explain_rating_query(spark: SparkSession, sf: str) -> DataFrame:
    best, indexed = best_groups(spark, sf)
    tops = materialize(pl.top_difficulties(best, pl.tier_counts(indexed, BY), BY))
    rows = explain_rating(tops, ("ai", "Player"))
    return rows.select(
        "ai",
        F.col("Player").alias("player"),
        F.col("row").cast("bigint").alias("row"),
        F.col("index").cast("bigint").alias("idx"),
        *[F.round(c, 5).alias(c) for c in ("diff", "completion", "diff_completion")],
    )


@query(
    "avg_ranks",
    vs.MATCHES
    + vs.STATS
    + """ select ai, player,
      rank() over (partition by ai order by weighted) + (count(*) over (partition by ai, weighted) - 1) / 2.0::double weighted_rank,
      rank() over (partition by ai order by least(n_games, 20)) + (count(*) over (partition by ai, least(n_games, 20)) - 1) / 2.0::double games_rank,
      rank() over (partition by ai order by win_rate) + (count(*) over (partition by ai, win_rate) - 1) / 2.0::double win_rank
      from stats""",
)
def avg_ranks(spark: SparkSession, sf: str) -> DataFrame:
    stats = pl.player_stats(match_view(spark, sf), VIEW_COLUMNS, BY)
    stats = stats.withColumn("clipped", F.least(F.col("n_games"), F.lit(20)))
    wanted = {"Weighted Award Rate": "weighted_rank", "clipped": "games_rank", "Win Rate": "win_rank"}
    ranked = average_ranks(stats, ["Player"], wanted, BY)
    return ranked.select("ai", F.col("Player").alias("player"), *wanted.values())


RATED_SQL = """ select ai, player, round(award_rate::double, 4) award_rate, round(weighted::double, 4) weighted,
  round(score::float::double, 5) score, cast(losers as bigint) losers, cast(settings as bigint) settings,
  case when n_games > 20 then '>20' else cast(n_games as varchar) end games, round(win_rate::double, 4) win_rate,
  cast(trunc(weighted_rank) as bigint) weighted_rank, cast(trunc(score_rank) as bigint) score_rank,
  cast(trunc(losers_rank) as bigint) losers_rank, cast(trunc(games_rank) as bigint) games_rank,
  cast(trunc(settings_rank) as bigint) settings_rank, cast(trunc(win_rank) as bigint) win_rank,
  cast(combined_rank as bigint) combined_rank, round(pve_rating::float::double, 2) pve_rating from rated"""


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    state, games = extended(spark, sf)
    return pl.player_ratings(state, games, VIEW_COLUMNS, BY)


@query("pve_rating", vs.RATED + RATED_SQL)
def pve_rating(spark: SparkSession, sf: str) -> DataFrame:
    """The whole rating job: results carried over, best groups, ranks and ratings."""
    ranks = {
        "Weighted Award Rate Rank": "weighted_rank",
        "Difficulty Score Rank": "score_rank",
        "Difficulty Losers Sum Rank": "losers_rank",
        "#Games Rank": "games_rank",
        "Setting Combinations Rank": "settings_rank",
        "Win Rate Rank": "win_rank",
        "Combined Rank": "combined_rank",
    }
    return ratings(spark, sf).select(
        "ai",
        F.col("Player").alias("player"),
        rounded("Award Rate", "award_rate"),
        rounded("Weighted Award Rate", "weighted"),
        rounded("Difficulty Score", "score", 5),
        col("Difficulty Losers Sum").alias("losers"),
        col("#Settings").alias("settings"),
        col("#Games").alias("games"),
        rounded("Win Rate", "win_rate"),
        *[col(c).cast("bigint").alias(a) for c, a in ranks.items()],
        rounded("PVE Rating", "pve_rating", 2),
    )


@query(
    "display_groups",
    vs.EXTENDED
    + """ select ai, map_name, coalesce(nullif(cast(difficulty_ord as varchar), '0'), '') difficulty_ord,
      case when evocom = 0 then '' else cast(evocom as varchar) end evocom, cast(evocom_rate as varchar) evocom_rate,
      case when nuttyb_hp = 0 then '' else cast(nuttyb_hp as varchar) end nuttyb_hp, cast(spawn_mult as varchar) spawn_mult,
      case when start_metal = 0 then '' else cast(start_metal as varchar) end start_metal, tweakunits,
      case when n_winners = 0 then '' else cast(n_winners as varchar) end n_winners, cast(n_players as varchar) n_players,
      case when difficulty <> 0 then cast(cast(round(difficulty::double * 100, 2) as decimal(18, 2)) as varchar) || '%' end shown
      from sized""",
)
def display_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Viewer cells of the setting table."""
    state, _ = extended(spark, sf)
    cells = display(state.sized.select(*settings(), "#Winners", "#Players", "Difficulty"), "gamesettings")
    return cells.select(
        *vs.KEYS, col("#Winners").alias("n_winners"), col("#Players").alias("n_players"), F.col("Difficulty").alias("shown")
    )


@query(
    "group_winners",
    vs.GROUPS + f" select distinct {LABEL_SQL} group_label, p player from own join k using (gid) where not ai_win",
)
def group_winners(spark: SparkSession, sf: str) -> DataFrame:
    """Players who won a group in its own matches."""
    state, _ = extended(spark, sf)
    return pl.own_wins(state, ()).join(state.state.groups, "gid").select(label(), F.col("Player").alias("player"))


@query(
    "group_links",
    vs.INDEXED
    + """ select ai, cast(idx as bigint) idx, 'https://board.example/?view=gamesettings&ai=' || ai || '&filter='
      || case difficulty when 1 then 'unbeaten' when 0 then 'easy' else 'regular' end || '&row=' || idx link from numbered""",
)
def group_links(spark: SparkSession, sf: str) -> DataFrame:
    state, _ = extended(spark, sf)
    rows = pl.setting_index(state, BY)
    link = group_link(F.col("ai"), F.col("Difficulty"), F.col("index"), "https://board.example")
    return rows.select("ai", F.col("index").alias("idx"), link.alias("link"))
