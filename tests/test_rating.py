"""Carried results, completions and ranks against plain per-match loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siegeboard.functions.numeric import TEAMMATES_A, TEAMMATES_B, TEAMMATES_C
from siegeboard.operators import groups as gr
from siegeboard.operators import players as pl
from siegeboard.operators import ranking as rk
from siegeboard.operators.dominance import extend_results, merged_replays, ordered_members
from siegeboard.roles import Gate, MatchColumns, SettingRoles
from siegeboard.session import materialize

ROLES = SettingRoles(
    map_column="map",
    equal=("mode", "evocommethod"),
    higher=("level", "hp", "grade"),
    lower=("metal", "evocom", "evocomrate"),
    optional=("hp",),
    gates=(Gate("evocom", 0, ("evocommethod", "evocomrate")),),
    levels={"grade": ("easy", "hard", "epic"), "hp": ("Epic", "Epic+")},
)
COLUMNS = MatchColumns(start="start", duration="duration")
SCHEMA = (
    "ai string, id string, start bigint, duration bigint, ai_win boolean, players array<bigint>, winners array<bigint>, "
    "damage_award bigint, damage_award_value bigint, eco_award bigint, map string, mode string, evocommethod string, "
    "level int, hp string, grade string, metal double, evocom int, evocomrate double"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def random_matches(seed, n, nulls):
    rng = random.Random(seed)

    def maybe(value):
        return None if nulls and rng.random() < 0.08 else value

    rows = []
    for i in range(n):
        players = rng.sample(range(1, 200, 7), rng.randint(1, 4))
        ai_win = rng.random() < 0.5
        rows.append(
            dict(
                ai="X", id=f"m{i:03}", start=rng.randint(0, 50), duration=rng.randint(1, 99), ai_win=ai_win,
                players=players, winners=[] if ai_win else players, damage_award=rng.choice([players[0], None]),
                damage_award_value=rng.choice([None, 5, 5, 9]), eco_award=players[-1],
                map=rng.choice(["a", "b"]), mode=maybe(rng.choice(["", "t"])), evocommethod=maybe(rng.choice(["d", "s"])),
                level=maybe(rng.randint(1, 4)), hp=rng.choice([None, None, "Epic", "Epic+"]),
                grade=maybe(rng.choice(["easy", "hard", "epic"])), metal=maybe(rng.choice([0.5, 1.0])),
                evocom=maybe(rng.choice([0, 1])), evocomrate=maybe(rng.choice([1.0, 2.0])),
            )
        )
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], SCHEMA)


def place(name, value):
    return ROLES.levels[name].index(value) if name in ROLES.levels and value is not None else value


def counts_for(source, target):
    """Does the source match's result count for the target match?"""
    win = not source["ai_win"]
    off = source["evocom"] == 0
    gated = {"evocommethod", "evocomrate"} if off else set()
    if source["map"] != target["map"]:
        return False
    for name in ROLES.settings:
        if name in gated:
            continue
        s, t = place(name, source[name]), place(name, target[name])
        if name == "hp" and s is None:
            if t is not None:
                return False
            continue
        if t is None:
            return False
        if name in ROLES.equal and s != t:
            return False
        if name in ROLES.higher and not (t <= s if win else t >= s):
            return False
        if name in ROLES.lower and not (t >= s if win else t <= s):
            return False
    return True


def loop(rows):
    """Per-match lists the slow way."""
    out = {r["id"]: dict(w=list(r["winners"]), p=list(r["players"]), mw=[], ml=[]) for r in rows}
    for source in rows:
        if any(source[c] is None for c in ROLES.compared):
            continue
        for target in rows:
            if target["id"] == source["id"] or not counts_for(source, target):
                continue
            mine = out[target["id"]]
            mine["p"] += source["players"]
            if source["ai_win"]:
                mine["ml"].append(source["id"])
            else:
                mine["w"] += source["winners"]
                mine["mw"].append(source["id"])
    return out


def grouped(rows):
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in ROLES.keys), []).append(r)
    return groups


def key_of(row):
    return tuple(row[k] for k in ROLES.keys)


@pytest.fixture(scope="module", params=[(1, False), (2, True), (3, True)], ids=["full", "nulls", "more-nulls"])
def case(request, spark):
    seed, nulls = request.param
    rows = random_matches(seed, 120, nulls)
    df = frame(spark, rows)
    state = extend_results(df, ROLES, COLUMNS, ["ai"], block_groups=7)
    return rows, df, state


def test_sets_match_the_loop(case):
    rows, _, state = case
    lists = loop(rows)
    got = {key_of(r): (r["#Winners"], r["#Players"], r["Difficulty"]) for r in state.sized.collect()}
    want = {}
    for key, members in grouped(rows).items():
        w = {p for m in members for p in lists[m["id"]]["w"]}
        p = {p for m in members for p in lists[m["id"]]["p"]}
        want[key] = (len(w), len(p), pytest.approx(1 - len(w) / len(p), abs=1e-6))
        assert w <= p
    assert got == want
    assert all(0 <= d <= 1 for *_, d in got.values())


def test_pivots_do_not_change_rows(spark, case):
    rows, df, state = case
    other = extend_results(df, ROLES, COLUMNS, ["ai"], pivots=0)
    a = {key_of(r): (r["#Winners"], r["#Players"]) for r in state.sized.collect()}
    b = {key_of(r): (r["#Winners"], r["#Players"]) for r in other.sized.collect()}
    assert a == b


def test_one_bucket_is_many_tasks(spark):
    """All groups in one bucket: both sides lie in small blocks, and no pair of blocks holds much of the work."""
    rows = random_matches(5, 400, False)
    for r in rows:
        r[ROLES.map_column] = "one map"
        r.update({c: "same" if isinstance(r[c], str) else r[c] for c in ROLES.equal})
    df = frame(spark, rows)
    state = extend_results(df, ROLES, COLUMNS, ["ai"], block_groups=8)
    held = state.state.groups.where("block is not null").groupBy("bucket", "block").count().collect()
    biggest = max(sum(r["count"] for r in held if r["bucket"] == b) for b in {r["bucket"] for r in held})
    assert biggest > 40 and max(r["count"] for r in held) <= 24
    met = state.state.meetings.collect()
    whole = {e: sum(r["n_sources"] * r["n_targets"] for r in met if r["easier"] == e) for e in (True, False)}
    assert all(r["n_sources"] * r["n_targets"] <= max(24 * 24, 0.1 * whole[r["easier"]]) for r in met)
    # Pairs of blocks that are left out hold no pair of groups.
    blocks = {r["gid"]: r["block"] for r in state.state.groups.collect()}
    allowed = {(r["easier"], r["s_block"], r["t_block"]) for r in met}
    pairs = state.pairs.collect()
    assert len(pairs) == len({(r["easier"], r["source"], r["gid"]) for r in pairs})
    assert all((r["easier"], blocks[r["source"]], blocks[r["gid"]]) in allowed for r in pairs)
    lists = loop(rows)
    got = {key_of(r): (r["#Winners"], r["#Players"]) for r in state.sized.collect()}
    for key, members in grouped(rows).items():
        assert got[key] == tuple(len({p for m in members for p in lists[m["id"]][x]}) for x in "wp")
    few = state.state.meetings.count()
    every = sum(1 for a in held for b in held if a["bucket"] == b["bucket"])
    assert few < 2 * every


def test_merged_replays_match_the_loop(case):
    rows, df, state = case
    lists = loop(rows)
    replays = gr.own_replays(gr.with_group_key(df, ROLES, ["ai"]), COLUMNS)
    got = {}
    for r in merged_replays(state, replays).join(state.state.groups, "gid").collect():
        got.setdefault((key_of(r), r["kind"]), []).append(r["replay"])
    for key, members in grouped(rows).items():
        own_w = {m["id"] for m in members if not m["ai_win"]}
        own_l = {m["id"] for m in members if m["ai_win"]}
        won = {x for m in members for x in lists[m["id"]]["mw"]} - own_w
        lost = {x for m in members for x in lists[m["id"]]["ml"]} - own_l
        assert sorted(got.get((key, "Win"), [])) == sorted(won)
        assert sorted(got.get((key, "Loss"), [])) == sorted(lost)


def test_merged_replays_look_takers_up_before_the_rows_multiply(case):
    rows, df, state = case
    replays = gr.own_replays(gr.with_group_key(df, ROLES, ["ai"]), COLUMNS)
    takers = state.state.groups.where(F.col("gid") % 2 == 0).select("gid", F.concat(F.lit("g"), F.col("gid").cast("string")).alias("named"))
    got = merged_replays(state, replays, takers)
    want = [("g%d" % r.gid, r.kind, r.replay) for r in merged_replays(state, replays).collect() if r.gid % 2 == 0]
    assert sorted((r.named, r.kind, r.replay) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "source#" in next(x for x in plan.splitlines() if "Join" in x)  # the last join is that of pairs and replays


def test_ordered_members_hold_the_sets(case):
    rows, df, state = case
    lists = loop(rows)
    for winners_only, name in ((True, "w"), (False, "p")):
        got = {}
        for r in ordered_members(state, df, COLUMNS, ["ai"], winners_only).join(state.state.groups, "gid").collect():
            got.setdefault(key_of(r), []).append((r["first_seen"], r["player"]))
        for key, members in grouped(rows).items():
            want = {p for m in members for p in lists[m["id"]][name]}
            assert {p for _, p in got.get(key, [])} == want
            top = min(members, key=lambda m: (m["damage_award_value"] is not None, -(m["damage_award_value"] or 0), m["id"]))
            first = [p for _, p in sorted(got.get(key, []))][: len(top["winners" if winners_only else "players"])]
            assert first == (top["winners"] if winners_only else top["players"])


def fold(lists, player, level):
    done, seen = 0.0, set()
    for members in lists:
        if done >= 1:
            break
        members = set(members)
        if player not in members:
            continue
        new = members - seen - {player}
        seen |= new
        n = len(members)
        need = max(1, TEAMMATES_A * n * n + TEAMMATES_B * n + TEAMMATES_C)
        done = min(1.0, done + (1.0 if n == 1 else level * (len(new) + 1) / need))
    return done


def test_completions_match_the_fold(case):
    rows, df, state = case
    lists = loop(rows)
    indexed = materialize(pl.setting_index(state, ["ai"]))
    facts = {key_of(r): (r["index"], float(r["Difficulty"])) for r in indexed.collect()}
    want = {}
    for key, members in grouped(rows).items():
        index, level = facts[key]
        ordered = sorted(
            (m for m in members if lists[m["id"]]["w"]),
            key=lambda m: (m["damage_award_value"] is not None, -(m["damage_award_value"] or 0), m["id"]),
        )
        walk = [lists[m["id"]]["w"] for m in ordered]
        for player in {p for w in walk for p in w}:
            done = fold(walk, player, level)
            want.setdefault(player, []).append((-level * done, index, level, done))
    best = pl.completions(state, indexed, df, COLUMNS, ["ai"])
    got = {}
    for r in best.collect():
        got.setdefault(r["Player"], []).append((r["place"], r["index"], r["diff"], r["completion"], r["diff_completion"]))
    assert set(got) == set(want)
    for player, found in got.items():
        top = sorted(want[player], key=lambda x: (round(x[0], 9), x[1]))[:5]
        found = sorted(found)
        assert [round(x[4], 6) for x in found] == [round(-x[0], 6) for x in top]
        by_index = {x[1]: x[3] for x in want[player]}
        assert all(x[3] == pytest.approx(by_index[x[1]], abs=1e-9) for x in found)


def test_losers_and_settings(case):
    rows, _, state = case
    lists = loop(rows)
    lost, won = {}, {}
    for members in grouped(rows).values():
        own = {p for m in members for p in m["winners"]}
        every = {p for m in members for p in lists[m["id"]]["p"]}
        for p in own:
            won[p] = won.get(p, 0) + 1
            lost.setdefault(p, set()).update(every - own)
    got = {r["Player"]: r["Difficulty Losers Sum"] for r in pl.losers_sum(state, ["ai"]).collect()}
    assert got == {p: len(x) for p, x in lost.items()}
    assert {r["Player"]: r["#Settings"] for r in pl.settings_won(state, ["ai"]).collect()} == won


def test_rating_table(case):
    _, df, state = case
    table = pl.player_ratings(state, df, COLUMNS, ["ai"]).collect()
    ratings = sorted(r["PVE Rating"] for r in table)
    assert ratings[0] == 0 and ratings[-1] == 30
    assert table[0].asDict().keys() == {"ai", *pl.RATING_COLUMNS}


def test_average_ranks(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "by string, k int, v double")
    got = [r["rank"] for r in rk.average_ranks(df, ["k"], {"v": "rank"}, ["by"]).orderBy("k").collect()]
    assert got == [4.0, 1.0, 4.0, None, 2.0, 4.0]
    n = len([v for v in values if v is not None])
    assert sum(x for x in got if x) == n * (n + 1) / 2


def test_row_index_is_dense(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = rk.with_row_index(df, [F.col("v").desc(), F.col("id")]).orderBy(F.col("v").desc(), "id").collect()
    assert [r["index"] for r in got] == list(range(1000))


def test_rating_of_a_single_value_is_null(spark):
    df = spark.createDataFrame([("g", 1), ("g", 1)], "by string, r int")
    assert [r["out"] for r in rk.min_max_rating(df, ["by"], "r", "out").collect()] == [None, None]


def test_combined_weights():
    assert sum(rk.RANK_WEIGHTS.values()) == pytest.approx(2.165)
    assert np.isclose(rk.RANK_WEIGHTS["#Games Rank"], 0.5)


def test_previous_value_crosses_ranges(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 3).alias("k"), "id")
    got = rk.previous_value(df, ["k"], [F.col("id")], F.col("id"), "before").collect()
    want, last = {}, {}
    for row in sorted(got, key=lambda r: r["id"]):
        want[row["id"]] = last.get(row["k"])
        last[row["k"]] = row["id"]
    assert {r["id"]: r["before"] for r in got} == want and len(got) == 3000


def test_best_groups_are_found_without_dealing_them_again(spark):
    """A player's wins are dealt once; the groups they reach stay where the player's wins are."""
    df = frame(spark, random_matches(1, 120, False))
    state = extend_results(df, ROLES, COLUMNS, ["ai"], block_groups=7)
    best = pl.completions(state, materialize(pl.setting_index(state, ["ai"])), df, COLUMNS, ["ai"])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(Player" in plan and "hashpartitioning(ai" not in plan


@pytest.mark.parametrize("held", [8, 1 << 20])
def test_smallest_values_of_each_key(spark, held):
    """A task drops all but the smallest values before the shuffle; the result does not depend on how much it holds."""
    rng = random.Random(3)
    rows = [(rng.randint(0, 2), rng.randint(0, 9), [rng.randint(0, 400) for _ in range(rng.randint(0, 5))]) for _ in range(3000)] + [(0, 1, None)]
    df = spark.createDataFrame(rows, "side bigint, player bigint, bests array<bigint>").repartition(3)
    got = {}
    for r in rk.smallest_per(df, ["side", "player"], "bests", 4, held).collect():
        got.setdefault((r["side"], r["player"]), []).append(r["value"])
    want = {}
    for side, player, bests in rows:
        want.setdefault((side, player), set()).update(bests or ())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:4] for k, v in want.items()}


def test_few_rows_a_player_are_dealt(spark):
    """Of a player who won very many groups, only the best ones of each task are shuffled."""
    many = spark.range(20000, numPartitions=2).select(F.lit(0).cast("long").alias("side"), F.lit(7).cast("long").alias("player"), F.array("id").alias("bests"))
    dealt = rk.smallest_per(many, ["side", "player"], "bests", 5)
    assert sorted(r["value"] for r in dealt.collect()) == [0, 1, 2, 3, 4]
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression [player") < plan.index("MapInArrow")
