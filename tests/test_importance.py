"""Split by hash, held-out error and permutation importance against what was planted."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siegeboard.operators import importance as im


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        a, b = float(rng.integers(0, 6)), float(rng.integers(0, 6))
        t = ["x", "y"][int(rng.integers(0, 2))]
        rows.append((f"k{i}", a, b, t, 3 * a + (4.0 if t == "y" else 0.0)))
    return spark.createDataFrame(rows, "key string, a double, b double, t string, y double").cache()


def test_split_follows_the_hash(planted):
    train, test = im.hash_split(planted, "key", 0.2)
    held = {r["key"] for r in test.collect()}
    cut = f"{int(0.2 * 16**8):08x}"
    assert held == {f"k{i}" for i in range(400) if hashlib.md5(f"k{i}".encode()).hexdigest()[:8] < cut}
    assert train.count() + len(held) == 400 and 40 < len(held) < 120


def test_report_beats_the_mean(planted):
    train, test = im.hash_split(planted, "key", 0.2)
    mean = train.agg(F.avg("y")).first()[0]
    got = im.holdout_report(planted, "key", ["a", "b"], ["t"], "y", trees=10).first()
    assert got["n_train"] == train.count() and got["n_test"] == test.count()
    assert got["baseline_mse"] == pytest.approx(np.mean([(r["y"] - mean) ** 2 for r in test.collect()]))
    assert got["mse"] < got["baseline_mse"] / 5


def test_importance_finds_what_counts_in_any_layout(planted):
    first = {r["Feature"]: r["increase"] for r in im.permutation_importance(planted, "key", ["a", "b"], ["t"], "y", trees=10).collect()}
    assert first["a"] > first["t"] > 10 * abs(first["b"])
    again = {r["Feature"]: r["increase"] for r in im.permutation_importance(planted.repartition(9, "b"), "key", ["a", "b"], ["t"], "y", trees=10).collect()}
    assert again == pytest.approx(first)


def test_importance_of_nothing_held_out(planted):
    train, _ = im.hash_split(planted, "key", 0.2)
    assert im.permutation_importance(train, "key", ["a", "b"], ["t"], "y", trees=3).count() == 0
