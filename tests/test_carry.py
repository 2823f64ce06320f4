"""Tiles against plain loops; limits so small that there are many slices and parts."""

import random

import pytest
from pyspark.sql import functions as F

from siegeboard.operators import carry

SMALL = {"cells": 40, "sources": 30}


@pytest.fixture(scope="module")
def world(spark):
    """Groups of two buckets and one without, pairs inside buckets, sets of far-apart and of close words."""
    draw = random.Random(4)
    bucket = {g: b"a" if g < 14 else b"b" for g in range(20)} | {20: None, 21: None}
    pairs = {(e, s, g) for s in bucket for g in bucket if bucket[s] and bucket[s] == bucket[g] for e in (True, False) if s == g or draw.random() < 0.4}
    groups = spark.createDataFrame(list(bucket.items()), "gid long, bucket binary")
    return draw, bucket, pairs, groups, spark.createDataFrame(list(pairs), "easier boolean, source long, gid long")


def test_united_words(spark, world):
    draw, bucket, pairs, groups, pair_rows = world
    own = {}
    for g in bucket:
        for word in draw.sample([*range(9), 10**15, -7], 6):
            bits = [draw.choice([None, 1 << draw.randrange(63), -(1 << 63)]) for _ in range(5)]
            own[g, word] = bits if any(bits) else [None, 1, None, 1, None]
    rows = [(g, w, *bits) for (g, w), bits in own.items()]
    got = carry.united_words(groups, spark.createDataFrame(rows, "gid long, word long, " + ", ".join(f"{c} long" for c in carry.SETS)), pair_rows, **SMALL)
    want = {}
    for (g, w), (own_winners, own_players, *_) in own.items():
        want[g, w] = [own_winners or 0, 0, own_players or 0]
    for easier, s, g in pairs:
        for (x, w), (_, _, win_winners, win_players, loss_players) in own.items():
            if x == s and s != g:
                to = want.setdefault((g, w), [0, 0, 0])
                to[1] |= (win_winners or 0) if easier else 0
                to[2] |= (win_players if easier else loss_players) or 0
    want = {k: (a or None, b or None, a | b or None, c or None) for k, (a, b, c) in want.items() if a or b or c}
    found = got.collect()
    assert {(r["gid"], r["word"]): (r["own_winners"], r["carried"], r["winners"], r["players"]) for r in found if any(r[2:])} == want
    assert len(found) == len({r[:2] for r in found})


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_first_seats(spark, world, kind):
    draw, bucket, pairs, groups, pair_rows = world
    seats = []
    for match in range(150):
        name = f"m{match}" if kind == "string" else match
        g, won, source = draw.randrange(22), draw.choice([True, False, None]), draw.random() < 0.9
        start = draw.choice([None, 5, 6, 7])
        for place, player in enumerate(draw.sample(range(25), 3)):
            seats.append((g, player, start, None if match == 3 else name, place, match % 7 == 0, source and won is True, source and won is False))
    df = spark.createDataFrame(seats, f"gid long, player long, start int, match {kind}, place int, top boolean, win boolean, loss boolean")
    df = df.withColumn("start", F.timestamp_seconds("start"))
    order = lambda x: tuple((y is not None, y) for y in x)
    want = {}

    def met(g, player, at):
        want[g, player] = min(want.get((g, player), at), at, key=order)

    for g, player, start, match, place, top, win, loss in seats:
        met(g, player, (0 if top else 1, start, match, place))
        for easier, s, t in pairs:
            if s == g != t and (win if easier else loss):
                met(t, player, (1, start, match, place))
    found = carry.first_seats(groups, df, pair_rows, **SMALL).select("gid", "player", "first_seen.part", F.unix_seconds("first_seen.start"), "first_seen.match", "first_seen.place").collect()
    assert {tuple(r[:2]): tuple(r[2:]) for r in found} == want and len(found) == len(want)


def test_union_sizes(spark, world):
    draw = random.Random(8)
    sets = {(g, w): draw.choice([1 << draw.randrange(63), -(1 << 63)]) for g in range(15) for w in range(12) if draw.random() < 0.6}
    records = {k: draw.sample(range(20), draw.randrange(1, 9)) for k in range(40)}
    got = carry.union_sizes(
        spark.createDataFrame([(0, g, w, b) for (g, w), b in sets.items()], "bucket long, gid long, word long, bits long"),
        spark.createDataFrame([(0, k, x) for k, x in records.items()], "bucket long, key long, groups array<long>"),
        ["key"],
        **SMALL,
    )
    held = {g: {(w, i) for (x, w), b in sets.items() if x == g for i in range(64) if b & (1 << i)} for g in range(20)}
    assert {r["key"]: r["size"] for r in got.collect()} == {k: len(set().union(*(held[g] for g in x))) for k, x in records.items()}


def test_slices_follow_the_input(spark, world):
    """A tile's matrix stays within the limit when there are ten times the items."""
    _, _, _, groups, pair_rows = world
    for n in (30, 300):
        items = spark.range(20 * n).select((F.col("id") % 20).alias("gid"), F.floor(F.col("id") / 20).alias("word"))
        tiles = carry.tiled(carry.with_bucket(items, groups), carry.with_bucket(carry.source_lists(pair_rows), groups), "word", ["gid"], cells=200)

        def shape(left, right):
            import pyarrow as pa

            return pa.table({"n": [left.num_rows], "at": [right.num_rows]})

        got = tiles.applyInArrow(shape, "n long, at long").collect()
        assert sum(r["n"] for r in got) == 20 * n and max(r["n"] for r in got) < 600 and all(r["at"] for r in got if r["n"])


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_list_cells_from_pieces(spark, world, kind):
    """Cells put together from the pieces of many tiles: merged replays sorted, repeated ones kept, members by their first places."""
    draw, bucket, pairs, groups, pair_rows = world
    draw = random.Random(8)
    as_kind = str if kind == "string" else int
    replays = [(g, k, None if draw.random() < 0.05 else as_kind(draw.randrange(40))) for g in bucket for k in ("Win", "Loss") for _ in range(draw.randrange(6))]
    seats = []
    for g in bucket:
        for at in draw.sample(range(10_000), 9):
            player = draw.randrange(30)
            win = draw.random() < 0.5
            name = None if player == 3 else f"name {player}" + ", again" * (player == 4)
            seats.append((g, player, name, at, draw.random() < 0.2, win, not win))
    table = spark.createDataFrame([(g, f"row {g}") for g in bucket], "gid long, own string")
    seat_rows = spark.createDataFrame(seats, "gid long, player long, name string, at long, top boolean, win boolean, loss boolean")
    replay_rows = spark.createDataFrame(replays, f"gid long, kind string, replay {kind}")
    pieces = carry.replay_pieces(groups, replay_rows, pair_rows, {"Win": "wins", "Loss": "losses"}, **SMALL)
    pieces = pieces.unionByName(carry.member_pieces(groups, seat_rows, pair_rows, "members", **SMALL))
    whole = carry.with_cells(table, pieces, ["wins", "losses"], ["members"], replay_rows.schema["replay"].dataType, len(bucket))
    assert pieces.groupBy("gid", "cell").count().agg(F.max("count")).first()[0] > 1
    got = {r.gid: r for r in whole.collect()}
    assert set(got) == set(bucket)
    for g in bucket:
        sources = {e: [s for easier, s, t in pairs if t == g and easier == e and s != g] for e in (True, False)}
        for name, k, e in (("wins", "Win", True), ("losses", "Loss", False)):
            taken = [r for s, of, r in replays if of == k and s in sources[e]]
            assert got[g][name] == sorted(taken, key=lambda x: (x is not None, x))
        first = {}
        for s, player, name, at, top, win, loss in seats:
            places = ([(not top, at)] if s == g else []) + ([(True, at)] if (win and s in sources[True]) or (loss and s in sources[False]) else [])
            for place in places:
                first[player] = min(first.get(player, (place, name)), (place, name))
        assert got[g]["members"] == ", ".join(n for _, n in sorted((x for x in first.values() if x[1] is not None)))
        assert got[g]["own"] == f"row {g}"
