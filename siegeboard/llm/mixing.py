"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source has an exact quota of words: its share of all words by weight, at
most ``max_repeats`` times its own size. A quota is whole passes over the source
and a part of one more. The documents of a source lie in blocks, dealt by hash,
so that their order is a permutation. Block copies are the units of the tree:
output shards are halved again and again, and how many block copies of each
source go to either half is drawn from the multivariate hypergeometric law
with the halves' sizes exact. The leaves are block quotas of shards; shards draw
disjoint runs of the permuted block copies, and documents are shuffled inside a shard.

Hashes and draws are seeded, so every run gives the same mixture.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shards import hypergeometric
from .shared import WORD, release, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SHARDS = 16
SEED = 77
#: Documents in a block, and the most blocks of all sources together (beyond one each): the driver holds a row for each.
BLOCK_DOCS = 2000
MAX_BLOCKS = 32_768


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    docs: int
    target: float
    quota: int
    blocks: int


def targets(sizes: list[int], weights: list[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Share all words by weight; what lies above ``max_repeats`` times a size is shared again among the rest."""
    total = float(sum(sizes))
    capped: set[int] = set()
    while True:
        left = total - sum(max_repeats * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        out = [float(max_repeats * n) if i in capped else left * weights[i] / weight for i, n in enumerate(sizes)]
        over = {i for i, n in enumerate(sizes) if i not in capped and out[i] > max_repeats * n}
        if not over:
            return out
        capped |= over


def split_tree(units: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Units of each source (columns) for each shard (rows): exact halves at every node, sources drawn without replacement."""
    if shards == 1:
        return units[None, :]
    low = shards // 2
    take = int(units.sum()) * low // shards
    left = np.zeros_like(units)
    rest = int(units.sum())
    for i, n in enumerate(units):
        rest -= int(n)
        left[i] = hypergeometric(rng, int(n), rest, take)
        take -= int(left[i])
    return np.concatenate([split_tree(left, low, rng), split_tree(units - left, shards - low, rng)])


def _hash(seed: int, columns: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])


@dataclass(frozen=True)
class Deal:
    """What the mixture takes of every source and block: ``plan`` has a row for each source, ``blocks`` one for each block."""

    plan: DataFrame
    blocks: DataFrame
    identity: list[str]
    max_repeats: int
    seed: int

    def placed(self, docs: DataFrame) -> DataFrame:
        """Rows with what is known of their source and block; ``_ends`` marks the block of a source in which its quota ends."""
        return (
            docs.withColumnRenamed("source", "_name")
            .join(F.broadcast(self.plan), F.col("_name").eqNullSafe(F.col("source")))
            .drop("_name")
            .withColumn("_block", F.pmod(_hash(self.seed, self.identity), F.col("_blocks")).cast("int"))
            .join(F.broadcast(self.blocks), ["_source", "_block"])
        )

    def before(self) -> Column:
        """Words of the rows before a row in the order of its block; all rows of the block must be there."""
        order = [_hash(self.seed + 1, self.identity), *self.identity]
        rows = Window.partitionBy("_source", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("size").over(rows), F.lit(0))

    def drawn(self, placed: DataFrame, before: Column) -> DataFrame:
        """Add ``taken`` and ``draws``. In a block in which no quota ends every row is wanted or none, whatever stands ``before``."""
        rows = (
            placed.withColumn("_run", before)
            .withColumn("_rest", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_part") - F.col("_start") - F.col("_run"))))
            .withColumn("taken", (F.col("size") * F.col("_whole") + F.col("_rest")).cast("long"))
        )
        order = _hash(self.seed + 2, self.identity)
        draws = F.transform(
            F.sequence(F.lit(0), F.lit(self.max_repeats)),
            lambda c: F.struct(
                F.get("_shards", c).alias("shard"),
                F.xxhash64(order, c).alias("place"),
                F.when(c < F.col("_whole"), F.col("size")).when(c == F.col("_whole"), F.col("_rest")).otherwise(F.lit(0)).cast("long").alias("words"),
            ),
        )
        return rows.withColumn("draws", F.filter(draws, lambda d: d["words"] > 0)).drop(
            "_source", "_block", "_blocks", "_whole", "_part", "_run", "_start", "_shards", "_ends", "_rest"
        )


def deal(docs: DataFrame, identity: list[str], weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, shards: int = SHARDS, seed: int = SEED) -> Deal:
    """Draw how the blocks of all sources of ``docs`` (``source``, ``size``) go to the shards; the driver holds no document."""
    spark = docs.sparkSession
    found = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"] or 0) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], max_repeats) if found else []
    per_block = max(BLOCK_DOCS, -(-sum(r["docs"] for r in found) // MAX_BLOCKS))
    sources = [
        Source(r["source"], n, r["docs"], t, min(round(t), max_repeats * n), max(1, -(-r["docs"] // per_block)))
        for r, n, t in zip(found, sizes, goal, strict=True)
    ]
    plan = spark.createDataFrame(
        [(i, s.name, s.size, s.target, s.quota // s.size if s.size else 0, s.quota % s.size if s.size else 0, s.blocks) for i, s in enumerate(sources)],
        "_source int, source string, source_size bigint, target double, _whole bigint, _part bigint, _blocks int",
    )
    rows = (
        docs.withColumnRenamed("source", "_name")
        .join(F.broadcast(plan), F.col("_name").eqNullSafe(F.col("source")))
        .drop("_name")
        .withColumn("_block", F.pmod(_hash(seed, identity), F.col("_blocks")).cast("int"))
    )
    held = {(r["_source"], r["_block"]): int(r["size"]) for r in rows.groupBy("_source", "_block").agg(F.sum("size").alias("size")).collect()}
    # Block copies of each source in permuted order, then dealt to shards by the tree's quotas.
    rng = np.random.default_rng(seed)
    copies: list[list[tuple[int, int]]] = []
    starts: dict[tuple[int, int], int] = {}
    ends: set[tuple[int, int]] = set()
    for i, s in enumerate(sources):
        at, units = 0, []
        whole, part = (s.quota // s.size, s.quota % s.size) if s.size else (0, 0)
        for b in range(s.blocks):
            starts[i, b] = at
            if at < part and held.get((i, b)):
                units.append((b, whole))
            if at < part < at + held.get((i, b), 0):
                ends.add((i, b))
            at += held.get((i, b), 0)
            units += [(b, c) for c in range(whole)]
        copies.append([units[j] for j in rng.permutation(len(units))] if units else [])
    quota = split_tree(np.array([len(u) for u in copies], dtype=np.int64), shards, rng)
    home: dict[tuple[int, int], dict[int, int]] = {}
    for i, units in enumerate(copies):
        for (b, c), shard in zip(units, np.repeat(np.arange(shards), quota[:, i]), strict=True):
            home.setdefault((i, b), {})[c] = int(shard)
    blocks = spark.createDataFrame(
        [(i, b, at, [home.get((i, b), {}).get(c, -1) for c in range(max_repeats + 1)], (i, b) in ends) for (i, b), at in starts.items()],
        "_source int, _block int, _start bigint, _shards array<int>, _ends boolean",
    )
    return Deal(plan, blocks, identity, max_repeats, seed)


def mix(docs: DataFrame, identity: list[str], weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add ``source_size``, ``target``, ``taken`` and ``draws`` to rows with ``source`` and ``size`` (words).

    ``draws`` lists what the mixture takes of a row, one entry for each copy:
    its shard, its place in the shard's shuffle, and the number of words from
    the start of the text (less than ``size`` only in the one document where the
    quota ends). Rows that are not taken have none.

    Sources are ordered by code point, null last, and get the weights in turn.
    ``identity`` tells rows apart; equal rows lie side by side and may share the
    end of the quota in either order. Rows without words are never taken. The
    driver holds one row for each source and block, never a document.
    """
    dealt = deal(docs, identity, weights, max_repeats, shards, seed)
    return dealt.drawn(dealt.placed(docs), dealt.before())


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its first ``n`` words, which are fewer than all."""
    space = r"[\x20\x09-\x0D]+"
    parts = F.split(text, space, (n + 1 + F.when(text.rlike("^" + space), 1).otherwise(0)).cast("int"))
    rest = F.char_length(F.element_at(parts, -1))
    return F.regexp_replace(F.substring(text, F.lit(1), (F.char_length(text) - rest).cast("int")), space + "$", "")


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mixture takes of each, and the shards of its copies."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(stored(rows), ["doc_id", "size"]).select(
        "doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards")
    )


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row for each copy that the mixture takes, in shards and in shuffled order inside them.

    Columns are those of ``docs``. Only the document in which a source's quota
    ends is cut, after the words that are still wanted; its ``n_chars`` follows.
    Rows equal in every column share a key; each of their draws gives one copy.

    What is taken of a row follows from its source and block alone, but in the blocks in which a
    quota ends; only rows of these meet their draws by key, so that a text is shuffled once, into its shard.
    """
    parts = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    row = docs.select(
        F.struct(*docs.columns).alias("row"),
        "source",
        F.xxhash64(F.lit(1), *parts).alias("key"),
        F.xxhash64(F.lit(2), *parts).alias("key2"),
        word_count(F.col("text")).alias("size"),
    )
    keys = ["key", "key2"]
    sized = stored(row.drop("row"))
    dealt = deal(sized, keys)
    at_end = dealt.drawn(dealt.placed(sized).where("_ends"), dealt.before())
    ends = stored(at_end.select(*keys, F.explode("draws").alias("draw")))
    release(sized)
    placed = dealt.placed(row)
    whole = dealt.drawn(placed.where(~F.col("_ends")), F.lit(0)).select("row", F.explode("draws").alias("draw"))
    # Equal rows are one text here, so that a draw meets it once.
    ended = placed.where("_ends").select("row", *keys).dropDuplicates(keys).join(ends, keys).select("row", "draw")
    text, wanted = F.col("row.text"), F.col("draw.words")
    cut = F.when(wanted < word_count(text), first_words(text, wanted)).otherwise(text)
    shorter = F.char_length("cut") < F.char_length(text)
    columns = [
        F.col("cut").alias(c)
        if c == "text"
        else F.when(shorter, F.char_length("cut").cast(docs.schema[c].dataType)).otherwise(F.col(f"row.{c}")).alias(c)
        if c == "n_chars"
        else F.col(f"row.{c}")
        for c in docs.columns
    ]
    out = whole.withColumn("cut", text).unionByName(ended.withColumn("cut", cut)).select(F.struct(*columns).alias("row"), "draw.shard", "draw.place")
    # Shards go out in pieces of their shuffled order, so that no shard is one task.
    return (
        out.withColumn("piece", F.shiftrightunsigned("place", 58))
        .repartition("shard", "piece")
        .sortWithinPartitions("shard", "piece", "place")
        .select("row.*")
    )
