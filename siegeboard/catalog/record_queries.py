"""Queries of the nested-record, report, sink and stream operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import col
from ..operators import clean as cl
from ..operators import encode as en
from ..operators import filters as fi
from ..operators import groups as gr
from ..operators import importance as im
from ..operators import joins as jo
from ..operators import names as na
from ..operators import players as pl
from ..operators import profile as pr
from ..operators import report as rp
from ..operators.tiers import fetch_queue
from ..plans import ingest as ig
from ..plans.lobby import score_lobbies
from ..plans.rating import setting_report
from ..session import ensure_checkpoint_dir, materialize, store
from ..sources import landing as la
from ..sources import tables as ta
from ..streaming.ingest import ingest_rows, stored_rows
from ..streaming.lobby import score_lobby_stream
from . import viewsql as vs
from .match_queries import BY, LABEL_SQL, extended, label, ratings, settings, sizes, SETTINGS_SQL, SIZES_SQL
from .matchview import VIEW_COLUMNS, VIEW_ROLES, match_view, nested_view, table
from .registry import query


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint storage."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/query-{uuid.uuid4().hex}"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The nested records, stored once as the raw table they stand for."""
    return materialize(nested_view(spark, sf))


KEPT = "map_name <> 'MACHINERY' and difficulty_ord <> 4 and duration between 2000 and 490000"
FAIR = f"{KEPT} and damage_value <= 100000"


def ids_text(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query("eligible_matches", vs.MATCHES + f" select cast(id as varchar) id from g where {KEPT}")
def eligible_matches(spark, sf):
    return fi.eligible_matches(records(spark, sf)).select("id")


@query("no_player_handicap", vs.MATCHES + " select cast(id as varchar) id from g where damage_value <= 100000")
def no_player_handicap(spark, sf):
    return fi.no_player_handicap(records(spark, sf)).select("id")


@query(
    "derived_matches",
    vs.MATCHES
    + f""" select cast(id as varchar) id, map_name, cast(ai = 'Barbarian' as int) barbarian, cast(ai = 'Raptors' as int) raptors,
      cast(ai = 'Scavengers' as int) scavengers, cast(ai = 'Barbarian' and ai_win as int) barbarian_win,
      cast(ai = 'Raptors' and ai_win as int) raptors_win, cast(ai = 'Scavengers' and ai_win as int) scavengers_win,
      case when ai_win then '' else array_to_string(players, ',') end winners, array_to_string(players, ',') players,
      case when len(players) > 2 then damage_award end damage_award, case when len(players) > 2 then damage_value end damage_value, eco_award,
      case when ai = 'Barbarian' then cast(round(5.0 * (len(players) % 3 + 2) / 2.0, 0) as int) end handicap,
      case when ai = 'Barbarian' then round((len(players) % 3 + 1) / len(players)::double, 1) else 0 end per_player
      from g where {FAIR}""",
)
def derived_matches(spark, sf):
    """Flags, players, awards, handicaps and map names from nested records."""
    rows = cl.derive_matches(records(spark, sf))
    flags = ["barbarian", "raptors", "scavengers", "barbarian_win", "raptors_win", "scavengers_win"]
    return rows.select(
        "id",
        col("Map Name").alias("map_name"),
        *[F.col(f).cast("int").alias(f) for f in flags],
        ids_text("winners").alias("winners"),
        ids_text("players").alias("players"),
        F.col("damage_eco_award.damage_award").alias("damage_award"),
        F.col("damage_eco_award.damage_award_value").alias("damage_value"),
        F.col("damage_eco_award.eco_award").alias("eco_award"),
        col("Barbarian Handicap").cast("int").alias("handicap"),
        F.round(col("Barbarian Per Player").cast("double"), 1).alias("per_player"),
    )


@query(
    "split_ai",
    vs.MATCHES + f" select cast(id as varchar) id from g where {FAIR} and ai = 'Scavengers'",
)
def split_ai(spark, sf):
    return fi.split_ai(cl.derive_matches(records(spark, sf)), "Scavengers").select("id")


@query(
    "plain_barbarian",
    vs.MATCHES + f" select cast(id as varchar) id from g where {FAIR} and ai = 'Barbarian' and spawn_mult = 1",
)
def plain_barbarian(spark, sf):
    """Barbarian matches with every multiplier at 1."""
    rows = fi.split_ai(cl.derive_matches(records(spark, sf)), "Barbarian")
    return fi.plain_barbarian(rows.withColumnRenamed("spawn_mult", "multiplier_spawn")).select("id")


@query("missing_awards", vs.MATCHES + " select cast(id as varchar) id from g where len(players) = 1")
def missing_awards(spark, sf):
    return fi.missing_awards(records(spark, sf)).select("id")


@query(
    "label_games",
    vs.MATCHES + f" select cast(id as varchar) id, ai label, case when ai_win then 'Loss' else 'Win' end result from g where {FAIR}",
)
def label_games(spark, sf):
    rows = cl.label_games(cl.derive_matches(records(spark, sf)))
    return rows.select("id", F.col("AI").alias("label"), F.col("Result").alias("result"))


@query(
    "mark_refetch",
    vs.MATCHES
    + """ select cast(id as varchar) id, case when len(players) > 1 and tweakunits = '' and spawn_mult <> 3
        then cast(spawn_mult <> 2 as int) end fetched from g""",
)
def mark_refetch(spark, sf):
    rows = cl.mark_refetch(records(spark, sf), need_map=True)
    return rows.select("id", F.col("fetch_success").cast("int").alias("fetched"))


@query(
    "completeness",
    vs.MATCHES
    + """ select count(*) matches, count(*) filter (len(players) = 1) missing_awards, 0 missing_map,
      count(*) filter (tweakunits <> '') missing_map_name, count(*) filter (spawn_mult = 2) failed_fetch,
      count(*) filter (spawn_mult = 3) unfetched from g""",
)
def completeness(spark, sf):
    return pr.completeness(records(spark, sf))


@query(
    "last_player_win",
    vs.MATCHES + f" select strftime(max(start_time), '%Y-%m-%d %H:%M:%S') last_player_win from g where {FAIR} and not ai_win",
)
def last_player_win(spark, sf):
    rows = cl.derive_matches(records(spark, sf))
    wins = {f: f"{f}_win" for f in ("barbarian", "raptors", "scavengers")}
    last = pr.last_player_win(rows, "startTime", wins)
    return last.select(F.date_format("last_player_win", "yyyy-MM-dd HH:mm:ss").alias("last_player_win"))


@query(
    "fetch_queue",
    vs.MATCHES + " select cast(id as varchar) id from g where spawn_mult = 3 order by start_time desc, cast(id as varchar) desc limit 500",
)
def fetch_queue_query(spark, sf):
    return fetch_queue(records(spark, sf), 500)


@query(
    "fill_nested",
    vs.MATCHES
    + """ select cast(id as varchar) id, case when len(players) = 1 then 7.0::double else damage_value + 0.5::double end first_value from g""",
)
def fill_nested(spark, sf):
    """Fetched details fill the matches whose awards are empty."""
    games = records(spark, sf)
    fetched = games.select(
        "id",
        F.struct(
            F.array(F.struct(F.lit(0).alias("teamId"), F.lit(7.0).alias("value"))).alias("fightingUnitsDestroyed"),
            F.struct(F.lit(0).alias("teamId")).alias("mostResourcesProduced"),
        ).alias("awards"),
        "Map",
    )
    filled = jo.fill_nested(games, fetched)
    return filled.select("id", F.col("awards.fightingUnitsDestroyed")[0]["value"].alias("first_value"))


@query(
    "nested_names",
    vs.MATCHES
    + """ select p user_id, 'player ' || p as "name", n from (select unnest(players) p, count(*) n from g group by 1)""",
)
def nested_names(spark, sf):
    """Latest name and number of sightings per user in nested records."""
    seen = na.name_sightings(records(spark, sf).where(F.col("durationMs") <= 490000))
    extra = na.name_sightings(records(spark, sf).where(F.col("durationMs") > 490000)).distinct()
    every = seen.unionByName(extra)
    counts = every.groupBy("userId").agg(F.count("*").alias("n"))
    names = na.latest_names(every)
    return names.join(counts, "userId").select(F.col("userId").alias("user_id"), "name", "n")


@query(
    "translate_names",
    vs.MATCHES
    + """ select id, string_agg(s_name, ', ' order by i) crew from (
        select id, unnest(players) p, generate_subscripts(players, 1) i from g) join supplier on s_suppkey = p group by 1""",
)
def translate_names(spark, sf):
    games = match_view(spark, sf).select("id", F.col("players").alias("crew"))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("userId"), F.col("s_name").alias("name"))
    return jo.translate_names(games, ["id"], "crew", names)


def option_defaults(spark: SparkSession) -> DataFrame:
    """Option catalog for the view's settings."""
    rows = [("evocom", "bool", "false"), ("spawn_mult", "number", "1"), ("start_metal", "number", "1000"), ("tweakunits", "string", "")]
    return spark.createDataFrame(rows, "key string, type string, def string")


SETUP_SQL = """'!preset coop' || chr(10) || '!draft_mode disabled' || chr(10) || '!unit_market 1' || chr(10) || '!teamsize 16' || chr(10)
  || '!map ' || map_name || chr(10) || '!difficulty_ord ' || difficulty_ord || chr(10)
  || case when evocom <> 0 then '!evocom ' || evocom || chr(10) else '' end
  || '!evocom_rate ' || evocom_rate || chr(10)
  || case when spawn_mult <> 1 then '!spawn_mult ' || spawn_mult || chr(10) else '' end
  || '!start_metal ' || start_metal || chr(10)
  || case when tweakunits <> '' then '!bSet tweakunits ' || tweakunits || chr(10) else '' end
  || '$welcome-message Settings from https://board.example/?view=gamesettings&ai=' || ai || '&filter='
  || case difficulty when 1 then 'unbeaten' when 0 then 'easy' else 'regular' end || '&row=' || idx
  || case when nuttyb_hp is not null then ' and https://docs.example/hp' else '' end || chr(10)
  || case when tweakunits <> '' then '$rename [Modded] ' || ai || chr(10) else '' end"""
SITE = "https://board.example"
DOCUMENT = " and https://docs.example/hp"


@query("setup_text", vs.INDEXED + f" select ai, cast(idx as bigint) idx, {SETUP_SQL} setup from numbered")
def setup_text(spark, sf):
    """Lobby commands for every setting group."""
    state, _ = extended(spark, sf)
    indexed = pl.setting_index(state, BY)
    texts = rp.setup_text(
        indexed, VIEW_ROLES, option_defaults(spark), F.col("ai"), SITE, DOCUMENT, map_column="map_name"
    )
    return texts.select("ai", F.col("index").alias("idx"), col("Copy Paste").alias("setup"))


@query(
    "setting_report",
    vs.INDEXED
    + f""", top as (select gid, arg_min(id, (-damage_value, id)) top_id from gk group by gid),
    seats as (select gid, id, start_time, ai_win, unnest(players) p, generate_subscripts(players, 1) - 1 place from gk),
    src as (select gid, ai_win, p, min((1, start_time, id, place)) pos from seats group by 1, 2, 3),
    rows as (
      select s.gid, s.p, not ai_win won, case when s.id = t.top_id then (0, start_time, id, place) else (1, start_time, id, place) end pos
        from seats s join top t using (gid)
      union all
      select t.gid, o.p, true, o.pos from k s join k t on {vs.pair_condition(True)} join src o on o.gid = s.gid and not o.ai_win
      union all
      select t.gid, o.p, false, o.pos from k s join k t on {vs.pair_condition(False)} join src o on o.gid = s.gid and o.ai_win),
    firsts as (select gid, p, min(pos) pos, min(pos) filter (won) won_pos from rows group by 1, 2),
    texts as (select gid, string_agg(s_name, ', ' order by won_pos) filter (won_pos is not null) winners, string_agg(s_name, ', ' order by pos) players
      from firsts join supplier on s_suppkey = p group by 1),
    mine as (select gid, string_agg(id, ',' order by damage_value desc, id) filter (not ai_win) wins,
        string_agg(id, ',' order by duration desc, id) filter (ai_win) losses from gk group by 1),
    merged as (select gid, string_agg(id, ',' order by cast(id as bigint)) filter (won) wins, string_agg(id, ',' order by cast(id as bigint)) filter (not won) losses from (
      select t.gid, m.id, true won from k s join k t on {vs.pair_condition(True)} join gk m on m.gid = s.gid and not m.ai_win
      union all
      select t.gid, m.id, false from k s join k t on {vs.pair_condition(False)} join gk m on m.gid = s.gid and m.ai_win) group by 1)
    select n.ai, cast(idx as bigint) idx, {SIZES_SQL}, coalesce(t.winners, '') winners, t.players, coalesce(m.wins, '') wins,
      coalesce(m.losses, '') losses, coalesce(x.wins, '') merged_wins, coalesce(x.losses, '') merged_losses, {SETUP_SQL} setup, map_name "map"
    from numbered n left join texts t using (gid) left join mine m using (gid) left join merged x using (gid)""",
)
def setting_report_query(spark, sf):
    """The published setting table, lists as texts."""
    state, games = extended(spark, sf)
    indexed = materialize(pl.setting_index(state, BY))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("userId"), F.col("s_name").alias("name"))
    report = setting_report(state, indexed, games, VIEW_COLUMNS, names, option_defaults(spark), SITE, DOCUMENT)
    lists = {
        "wins": "Win Replays",
        "losses": "Loss Replays",
    }
    return report.select(
        "ai",
        F.col("index").cast("bigint").alias("idx"),
        *sizes(),
        col("Winners").alias("winners"),
        col("Players").alias("players"),
        *[F.array_join(col(c), ",").alias(a) for a, c in lists.items()],
        *[
            F.array_join(F.transform(F.sort_array(F.transform(col(c), lambda x: x.cast("bigint"))), lambda x: x.cast("string")), ",").alias(a)
            for a, c in {"merged_wins": "Merged Win Replays", "merged_losses": "Merged Loss Replays"}.items()
        ],
        col("Copy Paste").alias("setup"),
        F.col("Map").alias("map"),
    )


def replay_groups(games: DataFrame) -> DataFrame:
    """Setting groups of the match view ``games`` with own replay lists and row numbers."""
    games = games.withColumn("id", F.col("id").cast("string"))
    keyed = materialize(gr.with_group_key(games, VIEW_ROLES, BY))
    groups = gr.plain_difficulty(games, VIEW_ROLES, VIEW_COLUMNS, BY)
    replays = gr.own_replays(keyed, VIEW_COLUMNS)
    for kind in ("Win", "Loss"):
        rows = replays.where(F.col("kind") == kind)
        lists = gr.list_by_order(rows, ["group_key"], ["sort_value", "replay"], "replay", f"{kind} Replays")
        groups = groups.join(lists, "group_key", "left")
    return groups


@query(
    "recent_games",
    vs.GROUPS
    + f""", plain as (select k.gid, cast(1.0::double - w::double / n::double as float) difficulty
        from k join (select gid, count(distinct p) filter (not ai_win) w, count(distinct p) n from own group by gid) using (gid))
    select strftime(start_time, '%Y-%m-%d') start_day, ai, cast(id as varchar) id, case when ai_win then 'Loss' else 'Win' end result,
      crew, map_name "map", round(difficulty::double, 6) difficulty, cast(difficulty_ord as bigint) difficulty_ord
    from (select * from gk where {FAIR}) gk
    join plain using (gid)
    join (select id, string_agg('player ' || p, ', ' order by i) crew from (
        select id, unnest(players) p, generate_subscripts(players, 1) i from g) group by 1) using (id)""",
)
def recent_games(spark, sf):
    """All games with names, result and their group's settings."""
    # Records, lists and difficulties are all made of the view; the records are read once.
    games = store(match_view(spark, sf))
    derived = materialize(cl.derive_matches(nested_view(spark, sf, games)).drop(*VIEW_ROLES.settings))
    names = na.latest_names(na.name_sightings(derived))
    groups = replay_groups(games).select("Win Replays", "Loss Replays", "Difficulty", "difficulty_ord")
    shown = rp.recent_games(derived, groups, names)
    return shown.select(
        F.date_format(col("Start Time"), "yyyy-MM-dd").alias("start_day"),
        F.col("AI").alias("ai"),
        col("Replay ID").alias("id"),
        F.col("Result").alias("result"),
        F.col("Players").alias("crew"),
        F.col("Map").alias("map"),
        F.round(F.col("Difficulty").cast("double"), 6).alias("difficulty"),
        F.col("difficulty_ord").cast("bigint").alias("difficulty_ord"),
    )


@query("tier_tables", vs.INDEXED + f" select {SETTINGS_SQL}, {SIZES_SQL} from sized join ends using (ai) where ai = 'Raptors' and difficulty = low")
def tier_tables(spark, sf):
    """Tier tables written as partitions; the easy raptor view reads one of them."""
    state, _ = extended(spark, sf)
    root = scratch(spark)
    kept = state.sized.select(*[col(k) for k in vs.KEYS], "#Winners", "#Players", "Difficulty")
    ta.write_tiers(kept, f"{root}/setting_groups", BY)
    return ta.resolve_view(spark, root, "gamesettings", "raptors", "easy").select(*settings(), *sizes())


TIER_RULES = {"all": "true", "unbeaten": "difficulty = high", "regular": "difficulty > low and difficulty < high", "easy": "difficulty = low"}


@query(
    "view_tables",
    vs.INDEXED
    + " union all ".join(
        f" select '{tier}' tier, {SETTINGS_SQL}, {SIZES_SQL} from sized join ends using (ai) where {rule}"
        for tier, rule in TIER_RULES.items()
    ),
)
def view_tables(spark, sf):
    """Every settings view: all tiers of each side, each read from its own partition."""
    state, _ = extended(spark, sf)
    root = scratch(spark)
    kept = state.sized.select(*[col(k) for k in vs.KEYS], "#Winners", "#Players", "Difficulty")
    ta.write_tiers(kept, f"{root}/setting_groups", BY)
    shown = None
    for ai in ("raptors", "scavengers", "barbarian"):
        for tier in TIER_RULES:
            rows = ta.resolve_view(spark, root, "gamesettings", ai, tier)
            rows = rows.select(F.lit(tier).alias("tier"), *settings(), *sizes())
            shown = rows if shown is None else shown.unionByName(rows)
    return shown


@query("rating_document", vs.RATED + " select ai, cast(player as varchar) player, round(pve_rating::float::double, 2) rating from rated")
def rating_document(spark, sf):
    """The rating document, written as ordered JSON lines and read back."""
    root = scratch(spark)
    table = ratings(spark, sf).withColumn("Player", F.concat("ai", F.lit(" "), col("Player").cast("string")))
    ta.write_rating_json(table, f"{root}/pve_ratings")
    entries = spark.read.text(f"{root}/pve_ratings").where(F.col("value").rlike(r'^,?"[^"]*":([0-9]|null)'))
    parsed = F.from_json(F.concat(F.lit("{"), F.regexp_replace("value", "^,", ""), F.lit("}")), "map<string,double>")
    found = entries.select(F.explode(parsed).alias("player", "rating"))
    return found.select(
        F.split("player", " ")[0].alias("ai"), F.split("player", " ")[1].alias("player"), F.round("rating", 2).alias("rating")
    )


@query(
    "landing_pages",
    vs.MATCHES
    + """ select cast(id as varchar) id, cast(epoch(start_time) as bigint) started, case when duration < 2000 then 0 else duration end duration,
      map_name, case when difficulty_ord = 4 then 3 else 2 end teams from g""",
)
def landing_pages(spark, sf):
    """Match-list records written as JSON landing files and read back."""
    root = scratch(spark)
    games = records(spark, sf).withColumn("startTime", F.date_format("startTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    games.select("id", "startTime", "durationMs", "Map", "AllyTeams").write.json(root)
    rows = la.read_match_pages(spark, root)
    return rows.select(
        "id",
        F.unix_timestamp("startTime").alias("started"),
        F.col("durationMs").alias("duration"),
        col("Map Name").alias("map_name"),
        F.size("AllyTeams").alias("teams"),
    )


@query(
    "landing_details",
    vs.MATCHES
    + """ select cast(id as varchar) id, case when spawn_mult <> 2 then cast(start_metal as varchar) end startmetal,
      case when spawn_mult <> 2 then cast(evocom as varchar) end evocom, cast(spawn_mult <> 2 as int) fetched from g""",
)
def landing_details(spark, sf):
    """Match-detail records, settings unpacked, failed fetches kept without values."""
    root = scratch(spark)
    raw = records(spark, sf).select(
        "id",
        F.when(F.col("spawn_mult") == 2, 500).otherwise(200).alias("status"),
        F.date_format("startTime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("startTime"),
        "Map",
        "AllyTeams",
        "awards",
        F.struct(
            F.col("start_metal").cast("string").alias("startmetal"), F.col("evocom").cast("string").alias("evocom")
        ).alias("gameSettings"),
    )
    raw.write.json(root)
    rows = la.read_match_details(spark, root)
    return rows.select("id", "startmetal", "evocom", F.col("fetch_success").cast("int").alias("fetched"))


@query(
    "root_append",
    vs.MATCHES + " select cast(id as varchar) id, case when tweakunits = '' then map_name end map_name from g",
)
def root_append(spark, sf):
    """Root table after the later half of all matches arrives with some known ones."""
    games = records(spark, sf).select(*[col(c) for c in la.ROOT_COLUMNS])
    early = games.where(F.col("startTime") < "1999-01-01")
    overlap = games.where(F.col("startTime") >= "1998-01-01")
    return ig.append_root(early, overlap).select("id", col("Map Name").alias("map_name"))


@query("backup_scan", "select o_orderkey, o_custkey from orders union all select l_orderkey, null from lineitem")
def backup_scan(spark, sf):
    """Backups below one folder, found by name; columns that a file lacks are null."""
    root = scratch(spark)
    table(spark, sf, "orders").select("o_orderkey", "o_custkey").write.parquet(f"{root}/a/orders_table")
    table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).write.parquet(f"{root}/b/lines_table")
    return ta.read_backups(spark, root, "*.parquet").select("o_orderkey", "o_custkey")


@query(
    "overwrite_table",
    "select c_custkey, c_acctbal + 1 c_acctbal from customer",
)
def overwrite_table(spark, sf):
    """A table read, changed and written over itself."""
    path = f"{scratch(spark)}/customer"
    ta.write_table(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), path)
    changed = ta.read_table(spark, path).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    ta.write_table(changed, path)
    return ta.read_table(spark, path)


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("ingest_incremental", "select event_id, user_id, event_type from events")
def ingest_incremental(spark, sf):
    """Events streamed into a table twice; the second stream adds nothing."""
    target = f"{scratch(spark)}/events"
    rows = event_stream(spark, sf).select("event_id", "user_id", "event_type")
    for _ in range(2):
        ingest_rows(rows, target, scratch(spark), "event_id", buckets=16).awaitTermination()
    return stored_rows(spark, target, rows.schema)


@query(
    "lobby_changes",
    """select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) before from events)
       where before is null or before <> event_type""",
)
def lobby_changes(spark, sf):
    """Users as lobbies and event types as settings: only changes are scored.

    The events arrive in three batches by time; each batch brings those of the batch before it once more, late.
    """
    root = scratch(spark)
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("lobby"), F.struct("ts", "event_id").alias("at"), "event_id", "event_type"
    )
    first, second = events.agg(F.percentile_approx(F.unix_micros(F.col("at.ts").cast("timestamp")), [0.3, 0.6])).first()[0]
    at = F.unix_micros(F.col("at.ts").cast("timestamp"))
    part = F.when(at <= first, 0).when(at <= second, 1).otherwise(2)
    for n in range(3):
        events.where(part.isin(n - 1, n)).write.mode("append").parquet(f"{root}/landing")
        rows = spark.readStream.schema(events.schema).parquet(f"{root}/landing")
        score_lobby_stream(
            rows, ["event_type"], lambda changed: changed.select("lobby", "event_id", "event_type"),
            f"{root}/scores", f"{root}/last", f"{root}/state", buckets=16,
        ).awaitTermination()
    return spark.read.parquet(f"{root}/scores").select(F.col("lobby").alias("user_id"), "event_id", "event_type")


NUMBERS = ["difficulty_ord", "spawn_mult", "start_metal", "evocom", "evocom_rate"]
TEXTS = ["ai", "map_name", "tweakunits"]


def plain_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = gr.plain_difficulty(match_view(spark, sf), VIEW_ROLES, VIEW_COLUMNS, BY)
    return materialize(groups.withColumn("gid", F.monotonically_increasing_id()))


@query("score_lobby")
def score_lobby(spark, sf):
    """The newest match of every map as a lobby: its eight nearest groups and their difficulty."""
    groups = plain_groups(spark, sf)
    features = im.SettingFeatures(NUMBERS, TEXTS).fit(groups)
    games = match_view(spark, sf)
    newest = games.groupBy("map_name").agg(F.max_by(F.struct("id", *[F.col(c) for c in NUMBERS], "ai", "tweakunits"), F.struct("start_time", "id")).alias("m"))
    lobbies = newest.select(F.col("m.id").alias("lobby"), "map_name", *[F.col(f"m.{c}").alias(c) for c in [*NUMBERS, "ai", "tweakunits"]])
    scored = score_lobbies(lobbies, groups, features)
    return scored.select("lobby", "place", F.round("Difficulty", 4).alias("difficulty"), F.round("distance", 6).alias("distance"))


@query(
    "lobby_distances",
    vs.GROUPS
    + f""", scale as (select {", ".join(f"stddev_pop({c}) {c}" for c in NUMBERS)} from k),
    newest as (select arg_max(id, (start_time, id)) id from g group by map_name),
    lobbies as (select g.* from g join newest using (id))
    select lobby, cast(place as bigint) place, round(distance, 6) + 0.0 distance from (
      select l.id lobby, d.distance, row_number() over (partition by l.id order by d.distance) place from lobbies l, lateral (
        select {" + ".join(f"((l.{c} - k.{c}) / s.{c}) ^ 2" for c in NUMBERS)} + {" + ".join(f"case when l.{t} = k.{t} then 0 else 2 end" for t in TEXTS)} distance
        from k, scale s) d) where place <= 8""",
)
def lobby_distances(spark, sf):
    """How near the eight groups of ``score_lobby`` are; groups at equal distance may stand for each other."""
    return score_lobby(spark, sf).select("lobby", F.col("place").cast("bigint").alias("place"), (F.abs("distance") + 0.0).alias("distance"))


FILLED = [*NUMBERS, "nuttyb_hp"]
SCALED_SQL = "stats as (" + " union all ".join(
    f"""select '{c}' c, m, (select stddev_pop(coalesce({c}, m)) from k) s from (select avg({c}) m from k)""" for c in FILLED
) + "), cells as (" + " union all ".join(
    f"""select {LABEL_SQL} group_label, c, (coalesce({c}::double, m) - m) / case when s = 0 then 1 else s end v from k join stats on c = '{c}'"""
    for c in FILLED
) + ")"


@query(
    "ml_pipeline",
    vs.GROUPS
    + f""", {SCALED_SQL}
    select group_label, c "column", cast(-1 as bigint) "index", round(v, 4) + 0.0 "value" from cells union all """
    + " union all ".join(
        f"""select {LABEL_SQL}, '{t}_' || level, cast(i as bigint), 1.0 from
          (select k.*, coalesce({t}, (select {t} from k where {t} is not null group by 1 order by count(*) desc, 1 limit 1)) level from k) k
          join (select {t} level, row_number() over (order by {t}) - 1 i from (select distinct {t} from k where {t} is not null)) using (level)"""
        for t in TEXTS
    ),
)
def ml_pipeline(spark, sf):
    """Every setting group as sparse cells: filled and scaled numbers, and the ones of its texts."""
    groups = plain_groups(spark, sf).withColumn("group_label", label())
    numbers = en.number_cells(groups, "group_label", en.fit_scales(groups, FILLED))
    texts = en.level_cells(groups, "group_label", TEXTS, en.levels(groups, TEXTS))
    return numbers.select("group_label", "column", F.lit(-1).cast("bigint").alias("index"), (F.round("value", 4) + 0.0).alias("value")).unionByName(
        texts.select("group_label", F.concat_ws("_", "column", "level").alias("column"), F.col("index").cast("bigint").alias("index"), "value")
    )


@query(
    "principal_components",
    vs.GROUPS
    + f""", {SCALED_SQL}, wide as (
      select group_label, {", ".join(f"max(v) filter (c = '{c}') {c}" for c in FILLED)} from cells group by 1)
    select group_label, round({" + ".join(f"{c} * {c}" for c in FILLED)}, 4) squares,
      (select round({" + ".join(f"var_pop({c})" for c in FILLED)}, 4) from wide) trace from wide""",
)
def principal_components(spark, sf):
    """Squared length of every group in all principal components, and the sum of their variances: rotation keeps both."""
    groups = plain_groups(spark, sf).withColumn("group_label", label())
    scales = en.fit_scales(groups, FILLED)
    variance, loadings = en.components(groups, scales)
    turned = en.rotated_cells(groups, "group_label", scales, loadings)
    return turned.groupBy("group_label").agg(F.round(F.sum(F.col("value") * F.col("value")), 4).alias("squares")).withColumn(
        "trace", F.round(F.lit(float(variance.sum())), 4)
    )


@query("rf_importance")
def rf_importance(spark, sf):
    """Forest importance of each setting beside its correlation with difficulty."""
    return im.forest_importance(plain_groups(spark, sf), NUMBERS, TEXTS, "Difficulty", trees=20)


def labelled_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Setting groups with the difficulty that is published: after results were carried over."""
    state, _ = extended(spark, sf)
    return materialize(state.sized.select(*[col(c) for c in [*NUMBERS, *TEXTS]], col("Difficulty"), label()))


@query(
    "holdout_report",
    vs.EXTENDED
    + f""", marked as (select y, substr(md5(group_label), 1, 8) < '33333333' held from (
      select {LABEL_SQL} group_label, cast(difficulty as double) y from sized k))
    select cast(count(*) filter (not held) as bigint) n_train, cast(count(*) filter (held) as bigint) n_test,
      round(avg((y - (select avg(y) from marked where not held)) ^ 2) filter (held), 6) baseline_mse, true better from marked""",
)
def holdout_report(spark, sf):
    """Split by hash, error of the mean predictor, and whether the forest does better on held-out groups."""
    told = im.holdout_report(labelled_groups(spark, sf), "group_label", NUMBERS, TEXTS, "Difficulty", trees=20)
    return told.select("n_train", "n_test", F.round("baseline_mse", 6).alias("baseline_mse"), (F.col("mse") < F.col("baseline_mse")).alias("better"))


@query("permutation_importance")
def permutation_importance(spark, sf):
    """Growth of the held-out error when one setting is taken from another group."""
    return im.permutation_importance(labelled_groups(spark, sf), "group_label", NUMBERS, TEXTS, "Difficulty", trees=20)


@query("holdout_mse")
def holdout_mse(spark, sf):
    return im.holdout_error(plain_groups(spark, sf), NUMBERS, TEXTS, "Difficulty", trees=20)


@query(
    "lobby_summary",
    """select round(avg(d), 1) "Difficulty", round(avg(q), 1) "distance", round((select avg(s_acctbal) from supplier), 4) "PVE Rating"
       from (select l_discount * 100 d, l_quantity q from lineitem)""",
)
def lobby_summary(spark, sf):
    near = table(spark, sf, "lineitem").select((F.col("l_discount") * 100).alias("Difficulty"), F.col("l_quantity").alias("distance"))
    rated = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("PVE Rating"))
    return rp.lobby_summary(near, rated).withColumn("PVE Rating", F.round(col("PVE Rating"), 4))


@query(
    "display_ratings",
    vs.RATED
    + """ select * exclude (w1), w1 || repeat(' ', greatest(0, 4 - length(w1))) weighted from (select ai, case when player = 0 then '' else cast(player as varchar) end player, regexp_replace(cast(cast(round(pve_rating::float::double, 2) as decimal(18, 2)) as varchar), '\\.0+$', '') rating,
      cast(cast(round(coalesce(win_rate, 0)::double * 100, 0) as bigint) as varchar) || '%' win_rate,
      cast(cast(round(coalesce(award_rate, 0)::double * 100, 0) as bigint) as varchar) || '%' award_rate,
      regexp_replace(cast(cast(round(score::float::double * 100, 1) as decimal(18, 1)) as varchar), '\\.0+$', '') score,
      regexp_replace(cast(cast(round(weighted::double, 1) as decimal(18, 1)) as varchar), '\\.0+$', '') w1 from rated)""".replace("\\\\", "\\"),
)
def display_ratings(spark, sf):
    """Viewer cells of the rating table in view order."""
    cells = rp.display(rp.in_view_order(ratings(spark, sf), "ratings"), "ratings")
    return cells.select(
        "ai",
        F.col("Player").alias("player"),
        col("PVE Rating").alias("rating"),
        col("Win Rate").alias("win_rate"),
        col("Award Rate").alias("award_rate"),
        col("Difficulty Score").alias("score"),
        col("Weighted Award Rate").alias("weighted"),
    )
