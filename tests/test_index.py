"""Cell index, sparse encoding, and keyed tables of streams against plain versions."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siegeboard.operators import encode as en
from siegeboard.operators.cells import build_cells, search_cells, visits
from siegeboard.streaming.ingest import ingest_rows, stored_rows
from siegeboard.streaming.keyed import KeyedTable
from siegeboard.streaming.lobby import score_lobby_stream


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    hubs = rng.normal(0, 10, (12, 6))
    base = np.round(hubs[rng.integers(0, 12, 900)] + rng.normal(0, 1, (900, 6)), 3)
    base[300:420] = base[0]  # a group of equal rows
    queries = np.round(hubs[rng.integers(0, 12, 25)] + rng.normal(0, 2, (25, 6)), 3)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)] + [(5000, None)], "base_id bigint, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)] + [(0, queries[0].tolist()), (99, None)], "query_id bigint, vector array<double>")
    return base, queries, frame, asked


def brute(base, queries, k):
    out = {}
    for q, v in enumerate(queries):
        gap = base - v
        distance = np.einsum("ij,ij->i", gap, gap)
        out[q] = np.lexsort((np.arange(len(base)), distance))[:k].tolist()
    return out


def answers(found):
    out = {}
    for r in found.orderBy("query_id", "place").collect():
        out.setdefault(r["query_id"], []).append(r["base_id"])
    return out


def test_cells_are_exact_and_prune(spark, points):
    base, queries, frame, asked = points
    index = build_cells(frame, cells=16)
    assert index.counts.sum() == 900
    near = search_cells(index, asked, 8, block_rows=50, query_rows=3)
    assert answers(near) == brute(base, queries, 8)
    bounds = near.where("place = 8").select("query_id", F.col("distance").alias("bound"))
    distinct = asked.dropDuplicates(["query_id"]).where("vector is not null")
    read = visits(index, distinct, 8).count() + visits(index, distinct.join(bounds, "query_id"), 8).count()
    assert read < 25 * (index.counts > 0).sum() / 2


def test_cells_with_probes_keep_k_rows(spark, points):
    base, queries, frame, asked = points
    found = answers(search_cells(build_cells(frame, cells=16), asked, 8, probes=4))
    wanted = brute(base, queries, 8)
    assert all(len(v) == 8 for v in found.values()) and set(found) == set(wanted)
    # Any of the equal rows is as near as another, so recall counts vectors.
    hits = sum(len({tuple(base[i]) for i in found[q]} & {tuple(base[i]) for i in wanted[q]}) / len({tuple(base[i]) for i in wanted[q]}) for q in wanted)
    assert hits / len(wanted) >= 0.9


def test_cells_of_few_or_no_rows(spark, points):
    _, _, frame, asked = points
    assert search_cells(build_cells(frame.limit(0)), asked).count() == 0
    few = search_cells(build_cells(frame.where("base_id < 3")), asked, 8)
    assert {r["count"] for r in few.groupBy("query_id").count().collect()} == {3}


def test_sparse_encoding(spark):
    rows = [("a", 1.0, 4, "x"), ("b", None, 4, "y"), ("c", 4.0, 4, "x"), ("d", 7.0, 4, None)]
    df = spark.createDataFrame(rows, "id string, p double, q int, t string")
    scales = en.fit_scales(df, ["p", "q"])
    filled = np.array([1.0, 4.0, 4.0, 7.0])
    assert scales["p"].mean == 4.0 and scales["p"].spread == pytest.approx(filled.std())
    cells = {(r["id"], r["column"]): r["value"] for r in en.number_cells(df, "id", scales).collect()}
    assert cells["b", "p"] == 0.0 and cells["a", "q"] == 0.0
    assert cells["d", "p"] == pytest.approx(3 / filled.std())
    book = en.levels(df, ["t"])
    assert sorted((r["level"], r["index"], r["common"]) for r in book.collect()) == [("x", 0, True), ("y", 1, False)]
    other = df.unionByName(spark.createDataFrame([("e", 0.0, 0, "new")], df.schema))
    ones = {(r["id"], r["level"]) for r in en.level_cells(other, "id", ["t"], book).collect()}
    assert ones == {("a", "x"), ("b", "y"), ("c", "x"), ("d", "x")}


def test_components_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    x[:, 2] += 2 * x[:, 0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    scales = en.fit_scales(df, ["a", "b", "c"])
    variance, loadings = en.components(df, scales)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert variance == pytest.approx(np.sort(np.linalg.eigvalsh(z.T @ z / len(z)))[::-1])
    again, same = en.components(df.repartition(7), scales)
    assert np.allclose(loadings, same) and np.allclose(variance, again)
    assert (loadings[np.arange(3), np.abs(loadings).argmax(axis=1)] > 0).all()
    turned = {(r["id"], r["column"]): r["value"] for r in en.rotated_cells(df, "id", scales, loadings).collect()}
    assert turned[5, "PC2"] == pytest.approx(float(z[5] @ loadings[1]))


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def test_ingest_over_batches_and_streams(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "table")
    schema = T.StructType.fromDDL("id bigint, v string")
    for rows in ([(1, "a"), (2, "b"), (2, "b")], [(2, "late"), (3, "c")], [(1, "late"), (4, "d")]):
        stream = arrive(spark, landing, rows, schema)
        ingest_rows(stream, table, str(tmp_path / "state"), "id", buckets=4).awaitTermination()
    got = sorted(map(tuple, stored_rows(spark, table, schema).collect()))
    assert got == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    # A fresh stream finds its keys in the table, even if the key folder is of no use.
    ingest_rows(stream, table, str(tmp_path / "other"), "id", buckets=4).awaitTermination()
    assert stored_rows(spark, table, schema).count() == 4


def test_keyed_table_prunes_and_compacts(spark, tmp_path):
    schema = T.StructType.fromDDL("k bigint, at int, v string")
    kept = KeyedTable(str(tmp_path / "kept"), schema, ["k"], ["at"], buckets=8)
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "one")
    kept.write(spark.createDataFrame([(i, 1, "old") for i in range(40)], schema), 0)
    kept.write(spark.createDataFrame([(i, 2, "new") for i in range(10)] + [(3, 1, "late")], schema), 1)
    want = [(i, 2, "new") if i < 10 else (i, 1, "old") for i in range(40)]
    assert sorted(map(tuple, kept.read(spark).collect())) == want
    assert {r["v"] for r in kept.read(spark, before=1).collect()} == {"old"}
    own = kept.touched(spark.createDataFrame([(7, 0, "")], schema))
    part = kept.read(spark, touched=own)
    assert len(own) == 1 and 7 in {r["k"] for r in part.collect()}
    assert part.count() == sum(1 for r in kept.read(spark).select(kept.bucket().alias("b")).collect() if r["b"] == own[0])
    assert re.search(r"PartitionFilters: \[[^\]]*key_bucket", part._jdf.queryExecution().toString())
    kept.compact(spark, 2)
    assert sorted(map(tuple, kept.read(spark).collect())) == want
    assert len(kept._folders(spark)) == 1
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)


def test_lobby_stream_drops_late_and_repeated_rows(spark, tmp_path):
    schema = T.StructType.fromDDL("lobby string, at int, s string")
    batches = [
        [("l", 1, "x"), ("l", 2, "x"), ("l", 4, "y"), ("m", 1, "x")],
        [("l", 3, "z"), ("l", 4, "y"), ("l", 5, "y"), ("m", 2, "q")],  # 3 is late, 4 repeated
        [("l", 6, "x"), ("l", 6, "x"), ("n", 1, None)],
    ]
    for rows in batches:
        stream = arrive(spark, str(tmp_path / "landing"), rows, schema)
        score_lobby_stream(stream, ["s"], lambda c: c.select("lobby", "at"), str(tmp_path / "out"), str(tmp_path / "last"), str(tmp_path / "state"), buckets=4).awaitTermination()
    got = sorted((r["lobby"], r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("l", 1), ("l", 4), ("l", 6), ("m", 1), ("m", 2), ("n", 1)]
