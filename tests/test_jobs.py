"""Whole jobs on hand-written records: ingest, rating, recent games, streams, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from siegeboard.operators import joins as jo
from siegeboard.operators import names as na
from siegeboard.operators.clean import cast_matches
from siegeboard.operators.knn import knn
from siegeboard.plans import ingest as ig
from siegeboard.plans.joins import fits_broadcast, join_lookup, join_skewed, row_bytes
from siegeboard.plans.lobby import lobby_ai, lobby_table
from siegeboard.plans.rating import rate
from siegeboard.plans.recent import publish_recent
from siegeboard.sources import landing as la
from siegeboard.sources import tables as ta
from siegeboard.streaming.ingest import ingest_stream, stored_rows
from siegeboard.streaming.lobby import changed_lobbies

from records import awards, bots, frame, humans, match

RAPTOR = ("RaptorsAI", 0)
SCAV = ("ScavengersAI", 0)
BARB = ("BARb", 20)


def rated_records(spark):
    """Raptor matches on two difficulties, a few of the other sides."""
    rows, settings = [], []

    def add(mid, ai, won, users, difficulty, at, value=10.0, **extra):
        people = [(u, 0) for u in users]
        teams = [humans(won, *people), bots(not won, ai)]
        rows.append(match(mid, teams, at=at, given=awards(0, value, 0), script=extra.get("script", "Glade_v2")))
        settings.append((mid, difficulty, extra.get("metal", "1000"), extra.get("tweak", ""), "1"))

    add("r1", RAPTOR, True, [1, 2], "epic", "2024-07-01 10:00:00", 50.0)
    add("r2", RAPTOR, False, [3, 4], "epic", "2024-07-02 10:00:00")
    add("r3", RAPTOR, False, [3], "easy", "2024-07-03 10:00:00")
    add("r4", RAPTOR, True, [4], "easy", "2024-07-04 10:00:00", tweak="abc")
    add("r5", RAPTOR, True, [5, 6], "easy", "2024-07-05 10:00:00", metal="5000")
    for i in range(3):
        add(f"s{i}", SCAV, i > 0, [1, 2 + i], "hard" if i else "normal", f"2024-07-0{6 + i} 10:00:00")
        add(f"b{i}", BARB, i > 0, [1, 2 + i][: 1 + i % 2], "hard", f"2024-08-0{6 + i} 10:00:00")
    extra = spark.createDataFrame(
        settings, "id string, raptor_difficulty string, startmetal string, tweakdefs string, multiplier_buildpower string"
    )
    table = frame(spark, rows).join(extra, "id")
    return table.withColumn("scav_difficulty", F.col("raptor_difficulty"))


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("published"))
    defaults = spark.createDataFrame([("startmetal", "number", "1000"), ("raptor_difficulty", "list", "normal")], "key string, type string, def string")
    details = rated_records(spark)
    sides = rate(spark, details, defaults, root, "https://board.example")
    return root, details, sides


def test_setting_report(spark, published):
    root, _, sides = published
    rows = {(r["raptor_difficulty"], r["startmetal"], r["tweakdefs"]): r for r in sides["Raptors"].report.collect()}
    easy, epic = rows[("easy", 1000, "")], rows[("epic", 1000, "")]
    # The epic win counts for the easy group, the easy loss for the epic one.
    assert easy["#Winners"] == 2 and easy["Merged Win Replays"] == ["r1"] and easy["Loss Replays"] == ["r3"]
    assert epic["#Players"] == 4 and epic["Merged Loss Replays"] == ["r3"] and epic["Winners"] == "user1, user2"
    # The richer start is easier: wins with less metal count for it.
    rich = rows[("easy", 5000, "")]
    assert rich["#Winners"] == 4 and sorted(rich["Merged Win Replays"]) == ["r1"]
    assert "!map Glade\n" in epic["Copy Paste"] and "!raptor_difficulty epic\n" in epic["Copy Paste"]
    assert "[Modded]" in rows[("easy", 1000, "abc")]["Copy Paste"] and "!bSet tweakdefs abc\n" in rows[("easy", 1000, "abc")]["Copy Paste"]
    assert "[Modded]" not in epic["Copy Paste"] and "multiplier" not in epic["Copy Paste"]
    assert sides["Raptors"].constants["scav_difficulty"] if "scav_difficulty" in sides["Raptors"].constants else True


def test_rating_job_tables(spark, published):
    root, _, sides = published
    ratings = {r["Player"]: r for r in sides["Raptors"].ratings.collect()}
    assert set(ratings) == {"user1", "user2", "user4", "user5", "user6"}
    assert max(r["PVE Rating"] for r in ratings.values()) == 30
    assert ratings["user4"]["Top-5 Difficulties"]["completions"][0] == 1.0
    document = json.loads("".join(r["value"] for r in spark.read.text(f"{root}/pve_ratings").collect()))
    assert set(document["pve_ratings"]) == {"BarbarianAI", "RaptorsAI", "ScavengersAI"}
    assert set(document["pve_ratings"]["RaptorsAI"]) == set(ratings)
    shown = ta.resolve_view(spark, root, "ratings", "raptors")
    assert shown.count() == 5
    whole = spark.read.parquet(f"{root}/setting_groups").where("ai = 'Raptors'")
    assert whole.where("tier = 'all'").count() == 4
    low = whole.where("tier = 'all'").agg(F.min("Difficulty")).first()[0]
    easy = ta.resolve_view(spark, root, "gamesettings", "raptors", "easy")
    assert {r["Difficulty"] for r in easy.collect()} == {low}
    plan = easy._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "Raptors" in filters and "cheese" in filters


def test_recent_job(spark, published):
    root, details, _ = published
    rows = publish_recent(spark, details, root, n=4).collect()
    assert [r["Replay ID"] for r in rows] == ["b2", "b1", "b0", "s2"]
    assert rows[0]["Result"] == "Win" and rows[2]["Result"] == "Loss" and rows[3]["AI"] == "Scavengers"
    assert rows[3]["Players"] == "user1, user4" and rows[3]["Map"] == "Glade"
    assert ta.resolve_view(spark, root).count() == 4


def test_names_over_time(spark):
    rows = [
        match("a", [(True, [(0, 1, "old", 0)], []), bots(False, RAPTOR)], at="2024-01-01 00:00:00"),
        match("b", [(True, [(0, 1, "new", 0), (1, 2, "other", 0)], []), bots(False, RAPTOR)], at="2024-02-01 00:00:00"),
    ]
    seen = na.name_sightings(frame(spark, rows))
    assert {r["userId"]: r["name"] for r in na.latest_names(seen).collect()} == {1: "new", 2: "other"}
    assert {r["name"] for r in na.aliases(seen, "old").collect()} == {"old", "new"}


def test_missing_name_is_an_error(spark):
    lists = spark.createDataFrame([(1, [1, 2])], "k int, ids array<bigint>")
    names = spark.createDataFrame([(1, "one")], "userId bigint, name string")
    with pytest.raises(Exception, match="no name for user 2"):
        jo.translate_names(lists, ["k"], "ids", names).collect()
    assert jo.translate_names(lists, ["k"], "ids", names, strict=False).first()["ids"] == "one, 2"


def test_one_to_one_check(spark):
    left = spark.createDataFrame([(1, "a")], "id int, v string")
    right = spark.createDataFrame([(1, "b"), (1, "c")], "id int, w string")
    with pytest.raises(ValueError, match="unique"):
        jo.join_one_to_one(left, right, ["id"])


def test_ingest_keeps_one_of_each(spark):
    root = frame(spark, [match("a", None, name="A"), match("b", None, name="B")]).select(*[F.col(f"`{c}`") for c in la.ROOT_COLUMNS])
    batch = frame(spark, [match("b", None, name="X"), match("c", None, name="C"), match("c", None, name="C")]).select(*root.columns)
    once = ig.append_root(root, batch)
    twice = ig.append_root(once, batch)
    want = [("a", "A"), ("b", "B"), ("c", "C")]
    for got in (once, twice):
        assert sorted((r["id"], r["Map Name"]) for r in got.collect()) == want
    fresh = ig.append_root(root, batch, refresh=True)
    assert sorted((r["id"], r["Map Name"]) for r in fresh.collect()) == [("a", "A"), ("b", "X")]


def test_details_merge_touches_months_once(spark, tmp_path):
    good = [humans(True, (1, 0)), bots(False, RAPTOR)]
    rows = [
        match("a", good, at="2024-05-01 00:00:00", fetched=None),
        match("b", good, at="2024-06-01 00:00:00", fetched=None),
    ]
    table = frame(spark, rows).withColumn("startmetal", F.lit(None).cast("int"))
    path = str(tmp_path / "details")
    ig.store_by_month(table, path)
    fetched = frame(spark, [match("a", good, given=awards(0, 3.0, 0), name="Foo")]).withColumn("startmetal", F.lit("500"))
    assert ig.merge_details(spark, path, fetched) == ["2024-05"]
    ig.merge_details(spark, path, fetched)
    got = {r["id"]: r for r in spark.read.parquet(path).collect()}
    assert len(got) == 2 and got["a"]["startmetal"] == 500 and got["a"]["fetch_success"] is True
    assert got["a"]["awards"]["fightingUnitsDestroyed"][0]["value"] == 3.0 and got["b"]["startmetal"] is None
    assert [r["id"] for r in ig.pending(spark.read.parquet(path), 5).collect()] == ["b"]


def test_details_keep_values_of_all_batches(spark, tmp_path):
    """Wide values, fractions and new columns of later batches read back as fetched, and are turned once."""
    good = [humans(True, (1, 0)), bots(False, RAPTOR)]
    days = {"a": "2024-05-01 00:00:00", "b": "2024-06-01 00:00:00", "c": "2024-07-01 00:00:00"}
    path = str(tmp_path / "details")
    ig.store_by_month(frame(spark, [match(i, good, at=at, fetched=None) for i, at in days.items()]).withColumn("startmetal", F.lit(None).cast("int")), path)
    for i, metal in (("a", "500"), ("b", "70000"), ("c", "1.5")):
        batch = frame(spark, [match(i, good, at=days[i], given=awards(0, 3.0, 0))]).withColumn("startmetal", F.lit(metal))
        if i != "b":
            batch = batch.withColumn("raptor_spawntimemult", F.lit("2"))
        assert ig.merge_details(spark, path, batch) == [days[i][:7]]
    stored = ig.read_details(spark, path)
    assert dict(stored.dtypes)["startmetal"] == "double"
    got = {r["id"]: r for r in stored.collect()}
    assert [got[i]["startmetal"] for i in "abc"] == [500.0, 70000.0, 1.5]
    assert [got[i]["raptor_spawntimemult"] for i in "abc"] == [2.0, None, 2.0]
    shown = {r["id"]: r for r in cast_matches(stored).collect()}
    assert shown["b"]["startmetal"] == 70000 and [shown[i]["raptor_spawntimemult"] for i in "ac"] == [0.5, 2.0]


def test_attach_details(spark):
    good = [humans(True, (1, 0)), bots(False, RAPTOR)]
    root = frame(spark, [match("a", good, name="A"), match("x", good, duration=0)]).select(*[F.col(f"`{c}`") for c in la.ROOT_COLUMNS])
    details = frame(spark, [match("a", good, name="New", given=awards(0, 1.0, 0))])
    got = ig.attach_details(root, details).collect()
    assert [(r["id"], r["Map Name"], r["raptors"]) for r in got] == [("a", "New", True)]
    assert got[0]["AllyTeamsList"] is not None and got[0]["AllyTeams"] is not None


def test_stream_ingest_twice(spark, tmp_path):
    landing, table = tmp_path / "landing", str(tmp_path / "table")
    landing.mkdir()

    def land(name, *ids):
        lines = [json.dumps({"id": i, "startTime": "2024-07-01T00:00:00.000Z", "durationMs": 5, "Map": {"scriptName": "Foo v1"}, "AllyTeams": []}) for i in ids]
        (landing / name).write_text("\n".join(lines))

    land("one.json", "a", "b")
    ingest_stream(spark, str(landing), table, str(tmp_path / "state")).awaitTermination()
    land("two.json", "b", "c")
    ingest_stream(spark, str(landing), table, str(tmp_path / "state")).awaitTermination()
    rows = stored_rows(spark, table, spark.read.parquet(table).schema)
    assert sorted(r["id"] for r in rows.collect()) == ["a", "b", "c"]
    # A stream that starts over finds everything already there.
    ingest_stream(spark, str(landing), table, str(tmp_path / "other")).awaitTermination()
    assert stored_rows(spark, table, rows.schema).count() == 3
    assert {r["Map Name"] for r in rows.collect()} == {"Foo"}


def test_lobby_change_detection(spark):
    batch = spark.createDataFrame([("l", 3, "x"), ("l", 4, "y"), ("l", 5, "y"), ("m", 1, "x")], "lobby string, at int, s string")
    empty = spark.createDataFrame([], "lobby string, at int, state binary")
    got = changed_lobbies(batch, empty, ["s"])
    assert sorted((r["lobby"], r["at"]) for r in got.collect()) == [("l", 3), ("l", 4), ("m", 1)]
    last = got.where("s = 'x'").select("lobby", "at", "state")
    again = spark.createDataFrame([("l", 9, "x"), ("m", 9, "z")], "lobby string, at int, s string")
    assert [(r["lobby"], r["at"]) for r in changed_lobbies(again, last, ["s"]).collect()] == [("m", 9)]


def test_lobby_table_and_ai(spark):
    df = spark.createDataFrame([("Scavengers Horde",), ("RaptorsAI",), ("BARb 3",)], "t string")
    assert [r[0] for r in df.select(lobby_ai(F.col("t"))).collect()] == ["Scavengers", "Raptors", "Barbarian"]
    near = spark.createDataFrame([(50.0, 1.0), (70.0, 2.0)], "Difficulty double, distance double")
    ratings = spark.createDataFrame([("ann", 3.0), ("bob", 4.5)], "Player string, `PVE Rating` double")
    lobby = spark.createDataFrame([("ann",), ("Host[1]",)], "Player string")
    rows = lobby_table(near, ratings, lobby).orderBy("distance").collect()
    assert [(r["Difficulty"], r["Player"], r["PVE Rating"]) for r in rows] == [("50.0", "ann", "3"), ("70.0", "", "")]


def test_knn_paths_agree(spark):
    base = spark.range(200).select(F.col("id").alias("base_id"), F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10)).cast("double") for i in range(3)]).alias("vector"))
    queries = base.where("base_id < 20").select(F.col("base_id").alias("query_id"), "vector")
    near = sorted(map(tuple, knn(queries, base, 5).collect()))
    blocks = sorted(map(tuple, knn(queries, base, 5, max_queries=6, block_rows=30).collect()))
    assert near == blocks and len(near) == 100


def test_skewed_join_keeps_every_row(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(700).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi"):
        plain = sorted(map(str, left.join(right, ["k"], how).collect()))
        salted = sorted(map(str, join_skewed(left, right, ["k"], how, hot_rows=100).collect()))
        assert plain == salted


def test_key_hot_on_both_sides_is_cut_by_product(spark):
    left = spark.range(900).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(700).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    joined = join_skewed(left, right, ["k"], hot_rows=100)
    assert sorted(map(str, joined.collect())) == sorted(map(str, left.join(right, ["k"]).collect()))
    # 600 rows in 6 parts meet 400 in 4: 24 tasks' worth of keys instead of one.
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt_l" in plan and "_salt_r" in plan


def test_backup_scan_finds_by_name(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "id string, v int").coalesce(1).write.parquet(str(tmp_path / "x" / "replays.parquet"))
    files = list((tmp_path / "x" / "replays.parquet").glob("part-*.parquet"))
    named = tmp_path / "y"
    named.mkdir()
    (named / "old_replays_1.parquet").write_bytes(files[0].read_bytes())
    (named / "other.parquet").write_bytes(files[0].read_bytes())
    got = ta.read_backups(spark, str(named))
    assert got.count() == 1 and got.first()["_file"].endswith("old_replays_1.parquet")


def test_repair_takes_first_backup(spark):
    schema = "id string, awards struct<fightingUnitsDestroyed:array<struct<teamId:int,value:double>>>, Map struct<scriptName:string>, `Map Name` string"
    main = spark.createDataFrame([("a", None, None, None), ("b", ([(0, 1.0)],), ("m",), "kept")], schema)
    backups = spark.createDataFrame(
        [(2, "a", ([(0, 2.0)],), ("m2",), "two"), (1, "a", ([],), ("m1",), None), (3, "b", ([(0, 9.0)],), ("z",), "z")],
        "n int, " + schema,
    )
    got = {r["id"]: r for r in jo.repair(main, backups, "n").collect()}
    assert got["a"]["awards"][0][0]["value"] == 2.0 and got["a"]["Map"]["scriptName"] == "m1" and got["a"]["Map Name"] == "two"
    assert got["b"]["awards"][0][0]["value"] == 1.0 and got["b"]["Map Name"] == "kept"


def test_wide_lookup_is_not_broadcast(spark):
    """Few rows of wide texts, binaries or lists are beyond the bytes that may be broadcast; their sizes alone are read."""
    left = spark.range(40).selectExpr("id % 10 k", "id")
    narrow = spark.range(10).selectExpr("id k", "cast(null as string) text")
    assert fits_broadcast(narrow, max_bytes=10_000)
    assert not fits_broadcast(narrow, max_rows=9)
    assert fits_broadcast(narrow.limit(0), max_bytes=0)
    for wide in ("repeat('\u00e9', 5000)", "cast(repeat('x', 10000) as binary)", "sequence(1, 4000)"):
        right = spark.range(10).selectExpr("id k", f"{wide} text")
        assert not fits_broadcast(right, max_bytes=90_000)
        joined = join_lookup(left, right, ["k"], max_bytes=90_000)
        assert joined.count() == 40 and joined.where("text is null").count() == 0
    seen = row_bytes(spark.range(1).selectExpr("id", "repeat('\u00e9', 5) t"))
    assert spark.range(1).selectExpr("id", "repeat('\u00e9', 5) t").select(seen).first()[0] == 26


def test_wide_lookup_is_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(40).selectExpr("id % 10 k", "id")
        right = spark.range(10).selectExpr("id k", "repeat('x', 10000) text")
        plans = [join_lookup(left, right, ["k"], max_bytes=b)._jdf.queryExecution().executedPlan().toString() for b in (90_000, 200_000)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plans[0] and "BroadcastHashJoin" in plans[1]


def test_recent_games_make_the_view_once(spark, tmp_path, monkeypatch):
    """Records, replay lists and difficulties come from one stored match view."""
    from siegeboard.catalog import matchview, record_queries

    day = "timestamp'2024-01-0{}'"
    frames = {
        "customer": "select * from values (1L, 'BUILDING'), (2L, 'AUTO') as t(c_custkey, c_mktsegment)",
        "orders": "select * from values "
        + ", ".join(f"({k}L, {1 + k % 2}L, 'P', {50000.0 + k}D, {day.format(k)}, '1-URGENT')" for k in (1, 2, 4, 5))
        + " as t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)",
        "lineitem": "select * from values "
        + ", ".join(f"({k}L, {s}L, {s}, {s}D, {1000.0 * s + k}D)" for k in (1, 2, 4, 5) for s in (1, 2, 3))
        + " as t(l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice)",
    }
    for name, text in frames.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    calls = []

    def counted(*args):
        calls.append(args)
        return view(*args)

    view = matchview.match_view
    monkeypatch.setattr(matchview, "match_view", counted)
    monkeypatch.setattr(record_queries, "match_view", counted)
    rows = record_queries.recent_games(spark, str(tmp_path)).collect()
    assert [r["id"] for r in rows] == ["5", "4", "2", "1"] and all(r["difficulty"] is not None for r in rows)
    assert {r["crew"] for r in rows} == {"player 1, player 2, player 3"}
    assert len(calls) == 1
