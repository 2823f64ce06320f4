"""Cleaning, filters and derivations on hand-written records."""

import math

import pytest
from pyspark.sql import functions as F

from siegeboard.functions.numeric import normalize_spawn_mult, quantize_1dp, required_teammates
from siegeboard.functions.ordinals import ordinal
from siegeboard.functions.text import hyperlink, normalize_map_name
from siegeboard.operators import clean as cl
from siegeboard.operators import columns as co
from siegeboard.operators import filters as fi
from siegeboard.operators.settings import ai_roles

from records import awards, bots, frame, humans, match

RAPTOR = ("RaptorsAI", 0)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_eligibility_one_row_each(spark):
    good = [humans(True, (1, 0)), bots(False, RAPTOR)]
    rows = [
        match("good", good),
        match("other_ai", [humans(True, (1, 0)), bots(False, ("NullAI", 0))]),
        match("no_time", good, duration=0),
        match("no_winner", [humans(False, (1, 0)), bots(False, RAPTOR)]),
        match("three", [*good, bots(False)]),
        match("mixed", [(True, [(0, 1, "a", 0)], [RAPTOR]), bots(False, RAPTOR)]),
        match("no_teams", None),
    ]
    assert ids(fi.eligible_matches(frame(spark, rows))) == ["good"]


def test_handicap_filter(spark):
    rows = [
        match("fair", [humans(True, (1, 0)), bots(False, RAPTOR)]),
        match("eased", [humans(True, (1, 0), (2, 10)), bots(False, RAPTOR)]),
    ]
    assert ids(fi.no_player_handicap(frame(spark, rows))) == ["fair"]


def test_flags_players_and_barbarian(spark):
    barbs = [("BARb", 10), ("BARb", 20), ("BARb", 25)]
    rows = [
        match("won", [humans(True, (7, 0), (8, 0)), bots(False, *barbs)]),
        match("lost", [humans(False, (7, 0)), bots(True, RAPTOR)]),
        match("alone", [bots(True, *barbs), bots(False, RAPTOR)]),
    ]
    got = {r["id"]: r for r in cl.derive_barbarian(cl.derive_players(cl.derive_ai_flags(frame(spark, rows)))).collect()}
    assert got["won"]["barbarian"] and not got["won"]["barbarian_win"]
    assert got["won"]["winners"] == [7, 8] and got["won"]["players"] == [7, 8]
    assert got["won"]["Barbarian Handicap"] == 18 and got["won"]["Barbarian Per Player"] == 1.5
    assert got["lost"]["raptors_win"] and got["lost"]["winners"] == [] and got["lost"]["players"] == [7]
    assert got["lost"]["Barbarian Handicap"] is None and got["lost"]["Barbarian Per Player"] == 0
    assert math.isinf(got["alone"]["Barbarian Per Player"])


def test_awards(spark):
    teams = [humans(True, (7, 0), (8, 0)), bots(False, RAPTOR)]
    twice = [(True, [(0, 7, "a", 0), (0, 9, "b", 0)], []), bots(False, RAPTOR)]
    rows = [
        match("full", teams, given=awards(1, 55.9, 0)),
        match("unknown", teams, given=awards(5, 55.0, 0)),
        match("empty", teams, given=awards(None, None, 1)),
        match("none", teams),
        match("twice", twice, given=awards(0, 1.0, 0)),
    ]
    got = {r["id"]: r["damage_eco_award"] for r in cl.derive_awards(frame(spark, rows)).collect()}
    assert tuple(got["full"]) == (8, 55, 7)
    assert tuple(got["unknown"]) == (None, None, 7)
    assert tuple(got["empty"]) == (None, None, 8)
    assert got["none"] is None
    assert tuple(got["twice"]) == (9, 1, 9)


def test_map_names(spark):
    names = ["Foo Bar_v1.2", "Foo 12", "Foo", "Foo V2b", "All That Glitters v2.2.1"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(normalize_map_name(F.col("n"))).collect()]
    assert got == ["Foo Bar", "Foo", "Foo", "Foo", "All That Glitters"]
    rows = [match("a", None), match("b", None, name="Kept")]
    filled = {r["id"]: r["Map Name"] for r in cl.backfill_map_name(frame(spark, rows)).collect()}
    assert filled == {"a": "Foo Bar", "b": "Kept"}


def test_spawn_inversion_boundary(spark):
    rows = [(d, v) for d in ("2024-06-05 23:00:00", "2024-06-06 00:00:00") for v in (2.0, 0.0, None)]
    df = spark.createDataFrame(rows, "t string, v double")
    got = [r[0] for r in df.select(normalize_spawn_mult(F.col("v"), F.col("t").cast("timestamp"))).collect()]
    assert got == [0.5, 1.0, 1.0, 2.0, 0.0, 1.0]


def test_strict_errors(spark):
    df = spark.createDataFrame([("hard",), (None,), ("weird",)], "v string")
    levels = ("easy", "hard")
    fine = df.where("v is null or v = 'hard'").select(ordinal(F.col("v"), levels).alias("o")).collect()
    assert [r["o"] for r in fine] == [1, None]
    with pytest.raises(Exception, match="unknown level"):
        df.select(ordinal(F.col("v"), levels).alias("o")).collect()
    with pytest.raises(Exception):
        spark.createDataFrame([("not a time",)], "t string").select(cl.parse_start_time(F.col("t"))).collect()
    assert co.schema_drift(df, ["v"]).count() == 0
    with pytest.raises(ValueError):
        co.schema_drift(df, [], mode="fail")


def test_numbers(spark):
    df = spark.createDataFrame([(1.25, 1), (0.04, 2), (-0.15, 16)], "x double, n int")
    assert [r[0] for r in df.select(quantize_1dp(F.col("x"))).collect()] == [1.3, 0.0, -0.2]
    needed = [r[0] for r in df.select(required_teammates(F.col("n"))).collect()]
    assert needed[0] == pytest.approx(1.232, abs=1e-3) and needed[2] == pytest.approx(40, abs=0.05)


def test_narrow_integers(spark):
    df = spark.createDataFrame(
        [("1", 300, 2**40, "1.5", "x"), ("-3", None, 1, "2", "1")], "a string, b bigint, c bigint, d string, e string"
    )
    kinds = dict(co.narrow_integers(df, ["a", "b", "c", "d", "e", "missing"]).dtypes)
    assert kinds == {"a": "tinyint", "b": "smallint", "c": "bigint", "d": "double", "e": "string"}


def test_column_order_and_constants(spark):
    df = spark.createDataFrame([(1, "", 1, None, 5), (2, "", 1, None, 5)], "a int, tweakdefs string, multiplier_x int, n int, k int")
    kept, told = co.drop_constant_columns(df, ["tweakdefs", "multiplier_x", "n", "k", "a"])
    assert kept.columns == ["a"] and told == {"n": None, "k": 5}
    assert co.reorder_column(df, 0, "k").columns[0] == "k"
    assert co.reorder_column(df, 0, "absent").columns == df.columns
    assert co.tweaks_in_order(["a", "tweakdefs", "tweakunits", "tweakunits1", "z"]) == ["a", "tweakunits", "tweakunits1", "tweakdefs", "z"]
    assert co.drop_empty_columns(df).columns == ["a", "multiplier_x", "k"]


def test_cast_matches(spark):
    rows = [("2024-07-01T00:00:00.000Z", "3000", None, "2.04", "epic", None, None), ("2024-07-02T00:00:00.000Z", "10", "x", "1", "easy", "2", "9")]
    df = spark.createDataFrame(
        rows,
        "startTime string, startmetal string, tweakdefs1 string, multiplier_buildpower string, raptor_difficulty string, "
        "unit_restrictions_noair string, evocomlevelcap string",
    )
    got = cl.cast_matches(df)
    kinds = dict(got.dtypes)
    assert kinds["startTime"] == "timestamp" and kinds["startmetal"] == "smallint" and kinds["multiplier_buildpower"] == "double"
    first = got.orderBy("startTime").first()
    assert first["tweakdefs1"] == "" and first["unit_restrictions_noair"] == 0 and first["evocomlevelcap"] == 10
    assert first["multiplier_buildpower"] == 2.0


def test_label_hp_checks_key(spark):
    df = spark.createDataFrame([("a",), ("b",)], "tweakdefs1 string")
    tweaks = spark.createDataFrame([("a", "Epic")], "tweakdefs1 string, nuttyb_hp string")
    got = {r["tweakdefs1"]: r["nuttyb_hp"] for r in cl.label_hp(df, tweaks).collect()}
    assert got == {"a": "Epic", "b": None}
    with pytest.raises(ValueError, match="unique"):
        cl.label_hp(df, tweaks.union(tweaks))


def test_roles():
    raptors, barbarian = ai_roles("Raptors"), ai_roles("Barbarian")
    assert not any(c.startswith("scav_") for c in raptors.settings)
    assert "nuttyb_hp" in raptors.optional and "raptor_spawntimemult" in raptors.higher
    evocom = next(g for g in raptors.gates if g.switch == "evocom")
    assert "evocom" not in evocom.members and "evocomlevelupmethod" in evocom.members
    assert "evocom" in next(g for g in barbarian.gates if g.switch == "evocom").members
    assert barbarian.higher == ("Barbarian Per Player", "Barbarian Handicap")


def test_hyperlink(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "ids array<string>")
    got = [r[0] for r in df.select(hyperlink(F.col("ids"), "https://r.example/")).collect()]
    assert got == ['=hyperlink("https://r.example/a";"a, b")', " ", " "]
