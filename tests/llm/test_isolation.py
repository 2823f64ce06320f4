"""Rule counts against a word-by-word version; the forest on planted rows, without labels and on nothing."""

import random
import re

import numpy as np
import pytest

from siegeboard.llm import isolation

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = n < 10 or 100 * len(inside) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


@pytest.mark.parametrize("seed", range(5))
def test_statistics_by_words(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", "Ü", "#", " ", " ", "\n", "\t", " ", "\u0085"]) for _ in range(rng.randint(0, 120)))
        assert isolation.statistics(text)[:6] == counted(text)
    assert isolation.statistics(None)[:6] == (0, 0, 0, 0, 0, True)


def make(n, bad):
    rng = random.Random(n)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(30, 90))]
        out.append((i, " ".join(w + "%$#"[j % 3] * rng.randint(1, 4) for j, w in enumerate(words)) if i < bad else " ".join(words)))
    return out


SCHEMA = "doc_id bigint, text string, score double, kept string"


def test_forest_catches_planted_rows(spark):
    rows = make(600, 30)
    docs = spark.createDataFrame([(i, t, 0.0, "x") for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(0, 600, 2)] + [(None, 0), (3, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in isolation.isolate(docs, "doc_id", labels, max_loss=0.03).collect()}
    assert len(got) == 600 and sum(got[i].kept for i in range(30)) <= 3
    assert sum(got[i].kept for i in range(30, 600)) >= 0.95 * 570
    again = {r.doc_id: r for r in isolation.isolate(docs.repartition(7), "doc_id", labels.repartition(3), max_loss=0.03).collect()}
    assert got == again


def test_counts_nulls_repeats_and_no_labels(spark, tmp_path, docs, rows, none):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = isolation.op12_isolation_rules(spark, str(tmp_path)).collect()
    names = ("doc_id", *isolation.COUNTS, "base_failed", "kept")
    want = [(r[0], *(c := counted(r[1])), not c[-1]) for r in rows]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got) == sorted(map(repr, want))
    assert {r.score for r in got} == {None}
    labels = spark.createDataFrame([(0, 1)], "doc_id bigint, quality int")
    one = isolation.isolate(docs, "doc_id", labels).collect()
    assert [r.kept for r in one] == [not r.base_failed for r in one] and all(0 <= r.score <= 1 for r in one)
    assert isolation.isolate(none, "doc_id", labels).count() == 0


def test_cut_loses_no_more_than_allowed():
    good, bad = np.zeros(101, int), np.zeros(101, int)
    good[[10, 50, 90]] = [900, 95, 5]
    bad[[40, 95]] = [10, 30]
    assert isolation.threshold(good, bad, 0.005) == 51 and isolation.threshold(good, bad, 0.1) == 11
    assert isolation.threshold(good, bad, 0.0) == 91 and isolation.threshold(good * 0, bad) == isolation.threshold(good, bad * 0) == 101


def test_paths_are_as_long_as_the_trees_say():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    forest = isolation.grow(x, trees=20, sample=64)
    far = forest.score(np.array([[9.0, 9.0], [0.0, 0.0]]))
    assert far[0] > 0.6 > far[1]

    def walk(t, row):
        node = 0
        while forest.feature[t, node] >= 0:
            node = 2 * node + 1 + (row[forest.feature[t, node]] >= forest.cut[t, node])
        return forest.path[t, node]

    for row in x[:10]:
        mean = np.mean([walk(t, row) for t in range(20)])
        assert forest.score(row[None])[0] == pytest.approx(2 ** (-mean / float(isolation.mean_path(np.array(64)))))
