"""Merkle manifest and multiproofs against a plain tree, on repeated rows, nulls, one-leaf and empty groups."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siegeboard.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, place):
    out = []
    for level in tree[:-1]:
        lo = place // 8 * 8
        out.append(("".join(level[lo:place]), "".join(level[place + 1 : lo + 8])))
        place //= 8
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for j, g in enumerate(order):
        for p, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = way(trees[g], p) + way(top, j)
            fold = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                fold = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for a, b in path:
                fold = H(a, fold, b)
            root = top[-1][0]
            out.append((r[0], own, trees[g][-1][0], root, H(*(a + b for a, b in path)), fold, fold == root))
    return out


def folder(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("count", [0, 1, 9, 700])
def test_manifest_agrees_with_a_plain_tree(spark, tmp_path, rows, count):
    some = [r[:5] for r in rows[:17]] if count == 9 else [(i, f"Text {i}" if i % 7 else None, "ab"[i % 2], None, i) for i in range(count)]
    some += some[:1] * (3 if count == 700 else 0)
    got = manifest.op13_merkle_manifest(spark, folder(spark, tmp_path, some, SCHEMA)).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(some)))


def test_sql_agrees(spark, tmp_path):
    some = [(i, f"Tëxt {i}" if i % 7 else None, [None, "b", "a", "Z"][i % 4], "s", i) for i in range(150)]
    base = folder(spark, tmp_path, some, SCHEMA)
    got = manifest.op13_merkle_manifest(spark, base).select(*COLUMNS).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{base}/documents.parquet/*.parquet')")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({manifest.ORACLE})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_missing_nodes_are_minimal_and_enough():
    rng = np.random.default_rng(4)
    for n in (1, 2, 8, 9, 64, 65, 1000):
        leaves = [H(str(i)) for i in range(n)]
        tree = levels(leaves)
        for size in {1, min(3, n), min(40, n), n}:
            own = sorted(rng.choice(n, size, replace=False).tolist())
            need = manifest.missing_nodes(np.array(own), n)
            assert len(set(need)) == len(need)
            # None of the fetched nodes lies over a leaf of the partition, so none could be derived.
            assert not any(p // 8**level == i for level, i in need for p in own)
            known = {(0, p): leaves[p] for p in own} | {(level, i): tree[level][i] for level, i in need}
            proofs = manifest.expand(own, n, known)
            assert all([(s["left"], s["right"]) for s in proof] == way(tree, p) for p, proof in zip(own, proofs, strict=True))
            assert known[len(tree) - 1, 0] == tree[-1][0]
            for gone in need[:3]:
                with pytest.raises(KeyError):
                    manifest.expand(own, n, {k: v for k, v in known.items() if k != gone and (k[0] == 0 or k in need)})


def test_some_leaves_and_clashing_columns(spark):
    """Proofs of a few leaves of a larger tree, with further columns named as the code names its own."""
    rows = spark.range(500).select(
        F.lit("g").alias("grp"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(1).alias("level"), F.lit(2).alias("_first")
    )
    leaves, nodes, crowns = manifest.manifest(rows.select("grp", "id", "digest"), ["id"])
    got = manifest.multiproofs(leaves, leaves.where("id % 50 = 7").withColumn("level", F.lit(5)).withColumn("width", F.lit(0)), nodes, crowns).collect()
    tree = levels([H(str(i)) for i in range(500)])
    assert len(got) == 10 and all([(s.left, s.right) for s in r.proof] == way(tree, r.id) and r.subroot == r.root == tree[-1][0] and r.crown == [] for r in got)
