"""Merkle manifest of a table, with octopus multiproofs.

A row's leaf is the digest of its columns. The leaves of a group lie in key
order; runs of ``FAN`` neighbours are digested into a node of the next level
until one is left, the group's subroot, and the subroots are the leaves of one more
tree. Interior nodes are stored once, as rows (group, level, place, digest).

Proofs are made for whole leaf partitions, runs of neighbouring leaves. A
partition works out which nodes its leaves' proofs need and which of these
follow from its own leaves; the rest, the minimal union of missing coordinates,
is fetched by one join. Interiors that several leaves share are derived once, and the
proof of each leaf is expanded from them in place.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import release, stored, table

FAN = 8
#: Levels that one task builds from FAN ** LEVELS neighbouring leaves; so many leaves are a leaf partition too.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """sha256 of all values, each as its UTF-8 byte count, a colon and its text, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def depth(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves; none above a lone leaf."""
    levels = 0
    while n > 1:
        n = -(-n // FAN)
        levels += 1
    return levels


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, gapless from 0 in each ``grp`` by ``order`` (nulls first), and ``n``, the rows of the group.

    Range partitions are sorted and counted, and only their counts meet in a
    window. ``tie`` (unique) parts rows that are equal otherwise.
    """
    by = [F.col(c).asc_nulls_first() for c in ["grp", *order, "tie"]]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy(F.col("grp").alias("_grp"), part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("_grp")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("n", F.sum("_rows").over(whole))
    here = F.col("grp").eqNullSafe(F.col("_grp")) & (F.shiftright("_at", 33) == F.col("_part"))
    out = placed.join(starts, here).withColumn("pos", F.col("_start") + F.col("_at") - F.col("_first"))
    return out.drop("_at", "_grp", "_part", "_first", "_rows", "_start", "tie")


def _climb(pdf: pd.DataFrame) -> pd.DataFrame:
    """Up to LEVELS levels over one run of neighbouring nodes of a level."""
    pdf = pdf.sort_values("idx")
    level, width = int(pdf["level"].iloc[0]), int(pdf["width"].iloc[0])
    first, digests = int(pdf["idx"].iloc[0]), pdf["digest"].tolist()
    out: list[tuple] = []
    for up in range(1, LEVELS + 1):
        if width == 1:
            break
        digests = [digest("".join(digests[i : i + FAN])) for i in range(0, len(digests), FAN)]
        first, width = first // FAN, -(-width // FAN)
        out += [(level + up, first + i, d, width) for i, d in enumerate(digests)]
    made = pd.DataFrame(out, columns=["level", "idx", "digest", "width"]).astype({"level": "int32", "idx": "int64", "width": "int64"})
    made.insert(0, "grp", pd.Series([pdf["grp"].iloc[0]] * len(made), dtype=object))
    return made


def tree(leaves: DataFrame) -> DataFrame:
    """Nodes above the leaves (``grp``, ``pos``, ``digest``, ``n``): ``grp``, ``level`` from 1, ``idx``, ``digest``, ``width`` of the level."""
    schema = "grp string, level int, idx bigint, digest string, width bigint"
    top = leaves.agg(F.max("n")).first()[0] or 0
    here = leaves.select("grp", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest", F.col("n").alias("width"))
    made = []
    for low in range(0, max(1, depth(top)), LEVELS):
        run = F.floor(F.col("idx") / FAN**LEVELS).alias("run")
        block = stored(here.where((F.col("level") == low) & (F.col("width") > 1)).groupBy("grp", run).applyInPandas(_climb, schema))
        made.append(block)
        here = block
    nodes = made[0]
    for block in made[1:]:
        nodes = nodes.unionByName(block)
    return nodes


def missing_nodes(positions: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, place) that proofs of these leaves of ``n`` need and that do not follow from the leaves."""
    out = []
    have, level = np.unique(positions), 0
    while n > 1:
        runs = np.unique(have // FAN)
        members = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        members = members[members < n]
        out += [(level, int(i)) for i in np.setdiff1d(members, have, assume_unique=True)]
        have, n, level = runs, -(-n // FAN), level + 1
    return out


def expand(positions: list[int], n: int, known: dict[tuple[int, int], str]) -> list[list[dict[str, str]]]:
    """The proof of each leaf from the leaves and fetched nodes; ``known`` gains the interiors derived on the way."""
    sides: list[dict[int, dict[str, str]]] = []
    have, level = sorted(set(positions)), 0
    while n > 1:
        sides.append({})
        runs = sorted({i // FAN for i in have})
        wanted = set(have)
        for run in runs:
            children = [known[level, i] for i in range(run * FAN, min(n, (run + 1) * FAN))]
            for slot in range(len(children)):
                if run * FAN + slot in wanted:
                    sides[-1][run * FAN + slot] = {"left": "".join(children[:slot]), "right": "".join(children[slot + 1 :])}
            known[level + 1, run] = digest("".join(children))
        have, n, level = runs, -(-n // FAN), level + 1
    return [[side[p // FAN**k] for k, side in enumerate(sides)] for p in positions]


PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def multiproofs(leaves: DataFrame, wanted: DataFrame, nodes: DataFrame, over: DataFrame) -> DataFrame:
    """Add ``proof`` and the columns of ``over`` (by ``grp``, one row each) to the rows of ``wanted``.

    ``wanted`` are all or some rows of ``leaves`` (``grp``, ``pos``, ``n``, ``digest``), with any further columns.
    A proof has a step for each level, bottom up: the siblings' digests ``left`` and
    ``right`` of the way. A lone leaf's has none.
    """
    extra = [c for c in over.columns if c != "grp"]
    block = F.floor(F.col("pos") / FAN**LEVELS).alias("block")

    def missing(pdf: pd.DataFrame) -> pd.DataFrame:
        need = missing_nodes(pdf["pos"].to_numpy(), int(pdf["n"].iloc[0]))
        head = pdf[["grp", "block"]].iloc[[0] * len(need)].reset_index(drop=True)
        return head.assign(level=np.array([x for x, _ in need], dtype=np.int32), idx=np.array([i for _, i in need], dtype=np.int64))

    parts = wanted.select("*", block)
    need = parts.select("grp", "block", "pos", "n").groupBy("grp", "block").applyInPandas(missing, "grp string, block bigint, level int, idx bigint")
    all_nodes = nodes.select("grp", "level", "idx", "digest").unionByName(
        leaves.select("grp", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest")
    )
    found = all_nodes.select(F.col("grp").alias("_grp"), F.col("level").alias("_level"), F.col("idx").alias("_idx"), "digest")
    same = (F.col("level") == F.col("_level")) & (F.col("idx") == F.col("_idx")) & F.col("grp").eqNullSafe(F.col("_grp"))
    fetched = need.join(found, same).select("grp", "block", "level", "idx", "digest", *[F.lit(None).cast(over.schema[c].dataType).alias(c) for c in extra])
    above = over.withColumnRenamed("grp", "_grp")
    crowns = parts.select("grp", "block").distinct().join(above, F.col("grp").eqNullSafe(F.col("_grp")))
    fetched = fetched.unionByName(crowns.select("grp", "block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(None).cast("string").alias("digest"), *extra))

    kinds = parts.schema.names

    def prove(own: pa.Table, other: pa.Table) -> pa.Table:
        known = dict(zip(zip(other["level"].to_pylist(), other["idx"].to_pylist(), strict=True), other["digest"].to_pylist(), strict=True))
        crown = other.filter(pa.compute.equal(other["level"], -1)).select(extra)
        positions = own["pos"].to_pylist()
        known |= {(0, p): d for p, d in zip(positions, own["digest"].to_pylist(), strict=True)}
        out = own.append_column("proof", pa.array(expand(positions, own["n"][0].as_py(), known), type=PROOF))
        zero = pa.array(np.zeros(own.num_rows, dtype=np.int64))
        for c in extra:
            out = out.append_column(c, crown[c].combine_chunks().take(zero))
        return out.select([*kinds, "proof", *extra])

    result = parts.limit(0).select("*", F.lit(None).cast("array<struct<left string, right string>>").alias("proof")).schema
    for c in extra:
        result = result.add(over.schema[c])
    return parts.groupBy("grp", "block").cogroup(fetched.groupBy("grp", "block")).applyInArrow(prove, result).drop("block")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def siblings_digest(proof: Column) -> Column:
    """sha256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def manifest(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves, nodes and crowns of rows with ``grp`` (string), ``digest`` and the columns of ``order``.

    Leaves are the rows with ``pos`` and ``n``. Equal rows are leaves side by side.
    Crowns hold for each group its ``subroot``, the ``root`` of all, and ``crown``, the proof that leads from
    one to the other; groups are in bytewise order, null first. No rows make three empty tables.
    """
    leaves = stored(numbered(stored(rows.withColumn("tie", F.monotonically_increasing_id())), [*order, "digest"]))
    nodes = tree(leaves)
    tops = nodes.where("width = 1").select("grp", "digest").unionByName(leaves.where("n = 1").select("grp", "digest"))
    # Subroots are leaves of a tree of one group; the old group is its key.
    below = tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", F.monotonically_increasing_id().alias("tie"))
    subroots = stored(numbered(stored(below), ["key"]))
    upper = tree(subroots)
    root = upper.where("width = 1").select("grp", F.col("digest").alias("root")).unionByName(
        subroots.where("n = 1").select("grp", F.col("digest").alias("root"))
    )
    crowns = stored(multiproofs(subroots, subroots, upper, root).select(F.col("key").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("crown")))
    release(subroots, upper)
    return leaves, nodes, crowns


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and check of every document; leaves are grouped by ``lang``.

    Rows of one language and id are ordered by their leaves. A null id comes first and counts as not tampered with.
    """
    docs = table(spark, sf_dir, "documents")
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(
        F.col("lang").cast("string").alias("grp"),
        "doc_id",
        leaf_of([F.col(c) for c in FIELDS]).alias("digest"),
        F.when(hit, leaf_of([small if c == "text" else F.col(c) for c in FIELDS])).alias("tampered"),
    )
    leaves, nodes, crowns = manifest(rows, ["doc_id"])
    whole = multiproofs(leaves, leaves, nodes, crowns).withColumn("way", F.concat("proof", "crown"))
    return whole.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        siblings_digest(F.col("way")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("way")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 8, top_levels: int = 4) -> str:
    """DuckDB SQL for the query, for up to FAN ** levels rows a language and FAN ** top_levels languages."""

    def field(name: str) -> str:
        return f"case when {name} is null then '-' else strlen({name}::varchar)::varchar || ':' || {name}::varchar end"

    def climb(name: str, levels: int, group: str) -> list[str]:
        return [
            f"{name}{k} as (select {group}, i // {FAN} as i, sha256(string_agg(h, '' order by i)) as h "
            f"from (select *, count(*) over (partition by {group}) as width from {name}{k - 1}) where width > 1 group by all)"
            for k in range(1, levels + 1)
        ]

    def side(name: str, k: int, group: str, way: str) -> str:
        order = "s.i < t.p" if way == "l" else "s.i > t.p"
        return (
            f"coalesce((select string_agg(s.h, '' order by s.i) from {name}{k} s where s.{group} is not distinct from t.{group} "
            f"and s.i // {FAN} = t.p // {FAN} and {order}), '')"
        )

    def walk(name: str, levels: int, group: str, last: str) -> tuple[list[str], str]:
        out = []
        for k in range(levels):
            # Above the root there are neither siblings nor a step.
            out.append(
                f"{last}_{name}{k} as (select t.* exclude (p, w, f, l, r, step), t.p // {FAN} as p, t.w || t.l || t.r as w, "
                f"case when t.step then sha256(t.l || t.f || t.r) else t.f end as f from "
                f"(select t.*, {side(name, k, group, 'l')} as l, {side(name, k, group, 'r')} as r, "
                f"exists (select 1 from {name}{k + 1} s where s.{group} is not distinct from t.{group}) as step "
                f"from {f'{last}_{name}{k - 1}' if k else last} t) t)"
            )
        return out, f"{last}_{name}{levels - 1}"

    leaf = "sha256(" + " || ".join(field(c) for c in FIELDS) + ")"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    low = "sha256(" + " || ".join(field(c) if c != "text" else field(c).replace("text::varchar", f"{small}::varchar") for c in FIELDS) + ")"
    bit = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    crc = (
        "xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint), lambda a, b: "
        f"list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::bigint[], lambda c, z: {bit}, xor(a, b)), 4294967295::bigint), 4294967295)"
    )
    ways, last = walk("a", levels, "lang", "rows0")
    more, end = walk("b", top_levels, "u", "rows1")
    return ",\n".join(
        [
            f"with d as (select doc_id, lang, {leaf} as leaf, case when {crc} % 3 = 0 then {low} end as low from documents)",
            "placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from d)",
            "a0 as (select lang, i, leaf as h from placed)",
            *climb("a", levels, "lang"),
            "subroots as (select lang, h from (" + " union all ".join(f"select *, count(*) over (partition by lang) as n from a{k}" for k in range(levels + 1)) + ") where n = 1)",
            "b0 as (select 0 as u, row_number() over (order by lang nulls first) - 1 as i, h, lang from subroots)",
            *climb("b", top_levels, "u"),
            "root as (select h from (" + " union all ".join(f"select h, count(*) over () as n from b{k}" for k in range(top_levels + 1)) + ") where n = 1)",
            "rows0 as (select doc_id, lang, leaf, i as p, '' as w, coalesce(low, leaf) as f from placed)",
            *ways,
            f"rows1 as (select t.* exclude (p), b0.u, b0.i as p, b0.h as subroot from {last} t join b0 on t.lang is not distinct from b0.lang)",
            *more,
        ]
    ) + f"\nselect doc_id, leaf, subroot, root.h as root, sha256(w) as proof_sha256, f as folded_root, f = root.h as verified from {end}, root"


ORACLE = _oracle()
