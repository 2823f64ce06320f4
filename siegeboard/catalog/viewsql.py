"""SQL twins of the match view and of the steps built on it."""

from __future__ import annotations

KEYS = [
    "ai", "map_name", "difficulty_ord", "evocom", "evocom_rate", "nuttyb_hp", "spawn_mult", "start_metal", "tweakunits",
]
KEY_LIST = ", ".join(KEYS)

MATCHES = """
with ap as (
  select l_orderkey id, list(distinct l_suppkey order by l_suppkey) players, max(l_extendedprice) top_price,
         arg_min(l_suppkey, (-l_extendedprice, l_linenumber, l_suppkey)) damage_award,
         arg_min(l_suppkey, (-l_quantity, l_linenumber, l_suppkey)) eco_award
  from lineitem group by 1),
g as (
  select o_orderkey id, o_orderdate start_time,
    case o_orderstatus when 'P' then 'Raptors' when 'F' then 'Scavengers' else 'Barbarian' end ai,
    (o_custkey + o_orderkey) % 3 <> 0 as ai_win,
    cast(floor(o_totalprice) as bigint) duration,
    c_mktsegment map_name,
    cast(substr(o_orderpriority, 1, 1) as int) difficulty_ord,
    o_orderkey % 5 + 1 spawn_mult,
    (o_custkey % 4) * 1000 start_metal,
    o_orderkey % 2 evocom, o_custkey % 3 + 1 evocom_rate,
    case when o_orderkey % 10 = 0 then 'mod' else '' end tweakunits,
    case when o_orderkey % 7 = 0 then o_custkey % 6 end nuttyb_hp,
    players, damage_award, cast(floor(top_price) as bigint) damage_value, eco_award
  from orders join customer on c_custkey = o_custkey join ap on ap.id = o_orderkey)"""

GROUPS = MATCHES + f""",
k as (select row_number() over (order by {KEY_LIST}) gid, {KEY_LIST}, count(*) n_matches
      from g group by {KEY_LIST}),
gk as (select k.gid, g.* from g join k on g.ai = k.ai and g.map_name = k.map_name
       and g.difficulty_ord = k.difficulty_ord and g.evocom = k.evocom and g.evocom_rate = k.evocom_rate
       and g.nuttyb_hp is not distinct from k.nuttyb_hp and g.spawn_mult = k.spawn_mult
       and g.start_metal = k.start_metal and g.tweakunits = k.tweakunits),
own as (select distinct gid, ai_win, unnest(players) p from gk)"""


def pair_condition(easier: bool) -> str:
    """Target ``t`` counts the result of source ``s``."""
    up, down = ("<=", ">=") if easier else (">=", "<=")
    return f"""s.ai = t.ai and s.map_name = t.map_name and s.tweakunits = t.tweakunits
   and t.difficulty_ord {up} s.difficulty_ord and t.spawn_mult {up} s.spawn_mult
   and t.start_metal {down} s.start_metal and t.evocom {down} s.evocom
   and (s.evocom = 0 or t.evocom_rate {down} s.evocom_rate)
   and ((s.nuttyb_hp is null and t.nuttyb_hp is null) or t.nuttyb_hp {up} s.nuttyb_hp)
   and s.gid <> t.gid"""


EXTENDED = GROUPS + f""",
ext as (
  select gid, p, not ai_win won from own
  union select t.gid, o.p, true from k s join k t on {pair_condition(True)}
    join own o on o.gid = s.gid and not o.ai_win
  union select t.gid, o.p, false from k s join k t on {pair_condition(False)}
    join own o on o.gid = s.gid and o.ai_win),
sized as (
  select k.*, w n_winners, n n_players, cast(1.0::double - w::double / n::double as float) difficulty
  from k join (select gid, count(distinct p) filter (won) w, count(distinct p) n from ext group by gid) using (gid))"""

INDEXED = EXTENDED + f""",
numbered as (
  select *, row_number() over (partition by ai order by difficulty desc nulls last, n_players desc, map_name,
    difficulty_ord, evocom, evocom_rate, nuttyb_hp nulls first, spawn_mult, start_metal, tweakunits) - 1 idx
  from sized),
ends as (select ai, min(difficulty) low, max(difficulty) high from sized group by ai),
tier_sizes as (select ai, count(*) filter (difficulty = high) n_unbeaten,
   count(*) filter (difficulty > low and difficulty < high) n_regular from sized join ends using (ai) group by ai)"""

REQUIRED = "greatest(1.0::double, 0.010523765015405669::double * (n * n) + 2.4052341883892385::double * n + -1.1838543289368846::double)"

BEST = INDEXED + f""",
scored as (
  select gid, ai, idx, difficulty::double diff,
    case when n_winners = 1 then 1.0::double
         else least(1.0::double, difficulty::double * (n_winners + n_matches - 1)::double / {REQUIRED}) end completion
  from (select *, n_winners::double n from numbered where n_winners > 0)),
ranked as (
  select s.ai, e.p player, s.idx, s.diff, s.completion, s.diff * s.completion diff_completion,
    row_number() over (partition by s.ai, e.p order by s.diff * s.completion desc, s.idx) place
  from ext e join scored s using (gid) where e.won),
best as (select * from ranked where place <= 5)"""

STATS = """,
seats as (select ai, unnest(players) player, ai_win, len(players) size, damage_award, eco_award from g),
stats as (
  select ai, player, count(*) n_games, cast(avg(case when ai_win then 0 else 1 end) as float) win_rate,
    cast(avg(a) as float) award_rate, cast(coalesce(avg(a * (size - 1)), 0.0) as float) weighted
  from (select *, case when not ai_win and size > 1 then
      (case when player = damage_award then 1 else 0 end) + (case when player = eco_award then 1 else 0 end) end a
    from seats) group by 1, 2)"""

RATED = BEST + STATS + """,
winners as (select distinct gid, p from own where not ai_win),
losers as (
  select k.ai, w.p player, count(distinct e.p) n from winners w join k using (gid)
  join (select distinct gid, p from ext) e on e.gid = w.gid
  where not exists (select 1 from winners x where x.gid = e.gid and x.p = e.p) group by 1, 2),
won as (select k.ai, w.p player, count(*) n from winners w join k using (gid) group by 1, 2),
tops as (select ai, player, list_sum(list(diff_completion order by place)) / 5 score from best group by 1, 2),
base as (
  select t.ai, t.player, award_rate, weighted, score, coalesce(l.n, 0) losers, coalesce(o.n, 0) settings, n_games, win_rate,
    least(n_games, 20) clipped
  from tops t left join losers l using (ai, player) left join won o using (ai, player) left join stats s using (ai, player)),
ranks as (
  select *,
    rank() over (partition by ai order by weighted) + (count(*) over (partition by ai, weighted) - 1) / 2.0::double weighted_rank,
    rank() over (partition by ai order by score) + (count(*) over (partition by ai, score) - 1) / 2.0::double score_rank,
    rank() over (partition by ai order by losers) + (count(*) over (partition by ai, losers) - 1) / 2.0::double losers_rank,
    rank() over (partition by ai order by clipped) + (count(*) over (partition by ai, clipped) - 1) / 2.0::double games_rank,
    rank() over (partition by ai order by settings) + (count(*) over (partition by ai, settings) - 1) / 2.0::double settings_rank,
    rank() over (partition by ai order by win_rate) + (count(*) over (partition by ai, win_rate) - 1) / 2.0::double win_rank
  from base),
blended as (
  select *, weighted_rank * 1.0::double + losers_rank * 0.4::double + score_rank * 0.25::double
    + settings_rank * 0.01::double + games_rank * 0.5::double + win_rank * 0.005::double blend from ranks),
combined as (
  select *, trunc(rank() over (partition by ai order by blend)
      + (count(*) over (partition by ai, blend) - 1) / 2.0::double) combined_rank from blended),
rated as (
  select c.*, round((combined_rank - lo) / nullif(hi - lo, 0) * 30.0::double, 2) pve_rating
  from combined c join (select ai, min(combined_rank) lo, max(combined_rank) hi from combined group by ai) using (ai))"""
