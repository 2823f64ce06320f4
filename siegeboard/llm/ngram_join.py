"""Jaccard self-join of 5-word shingle sets by a size-aware heavy-light scheme.

Documents of equal sets are one class, and classes are joined. For a small set
(light) all subsets of a fixed size are keys: a set of a shingles shares at
least ceil(8a/9) with any partner of its size or more, so a partner makes one
of the same subsets. For a large set (heavy) the keys are its inverted-list
entries under a prefix: of n shingles, any n - ceil(4n/5) + 1 contain one of
every partner's such prefix, if both follow one order. Frequent shingles come
last in that order, so lists stay short; which ones are frequent need not be
exact, since any order gives all partners. The boundary between light and heavy
is where the number of keys, with the reading of lists weighed in, is least.

Lists of equal members are one. Each list's members are first compared with
its first member, if their sizes allow a link, the likeliest pair of a member before its others, and
connected components are formed. In lists that
still hold several components near in size, only members of different components meet, in
blocks of bounded size. A bitmap of set parities gives an upper bound of the
overlap, which ends most comparisons; the rest compare whole sets. A pair that
fails does not come again, and rounds go on until no list has an untried pair
between components, so no link is lost while copies are never paired off.

Shingles and sets have 64-bit hashes: two sets among N that differ go for one
with probability about N^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, byte_slices, flagged, record_batch, release, stored, table, tidy

WORDS = 5
#: 100 * intersection >= 80 * union is 9 * intersection >= 4 * (sum of sizes).
MOST_LIGHT = 12
#: Reading one inverted-list entry costs as much as making so many subsets.
SCAN_COST = 2.0
#: Shingles in at least this share of the documents of a slice are counted as frequent.
FREQUENT = 0.01
MOST_FREQUENT = 1_000_000
BLOCK = 2048
#: Members of lists that one task compares, besides a block pair that is larger.
BUCKET_ROWS = 8192
FILTER_BITS = 27
#: Parity bits for each shingle, at least.
PARITY = 4
#: Sizes that differ by a factor of at most 5/4 lie in the same or in neighbouring bands of this factor; a bit more, for rounding.
BAND = 1.26
#: So many links are few enough for one task to find their components.
FEW = 1 << 16
#: After so many rounds all untried pairs between components are tried at once.
ROUNDS = 5

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_LETTER = np.random.default_rng(31).integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
for _b in range(ord("A"), ord("Z") + 1):
    _LETTER[_b] = _LETTER[_b + 32]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x2545F4914F6CDD1D)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and where each text's words begin."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begins[first] = solid[first]
    at = np.flatnonzero(solid)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    place = np.searchsorted(at, starts)
    sizes = np.diff(np.concatenate([place, [len(at)]]))
    inside = np.arange(len(at)) - np.repeat(place, sizes)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), _STEP)]))
    sums = np.add.reduceat(_LETTER[data[at]] * powers[inside], place)
    return mixed(sums + sizes.astype(np.uint64)), np.searchsorted(starts, ends)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted set of shingle hashes of every text; fewer than five words are one shingle, none are none."""
    for lo, hi, data, ends in byte_slices(column):
        words, begin = word_hashes(data, ends)
        n = len(words)
        run = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
        for k in range(WORDS):
            run += words[k : k + len(run)] * _C[k]
        run = mixed(run)
        for i in range(hi - lo):
            a, b = int(begin[i]), int(begin[i + 1])
            if b - a >= WORDS:
                own = np.sort(run[a : b - WORDS + 1])
                yield lo + i, own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield lo + i, mixed((words[a:b] * _C[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield lo + i, np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> int:
    if not len(shingles):
        return 0
    total = mixed(shingles ^ _C[0]).sum(keepdims=True) + np.full(1, len(shingles), dtype=np.uint64) * _C[1]
    return int(total.astype(np.int64)[0])


def needed(a: int) -> int:
    """What a set of ``a`` shingles shares at least with a partner of its size or more."""
    return -(-8 * a // 9)


def light_keys(n: int, boundary: int) -> int:
    return sum(comb(n, needed(a)) for a in range(max(1, -(-4 * n // 5)), min(n, boundary) + 1))


def prefix_size(n: int) -> int:
    return n - (-(-4 * n // 5)) + 1


def choose_boundary(sizes: dict[int, int], most: int = MOST_LIGHT, scan_cost: float = SCAN_COST) -> int:
    """The largest light size: total cost of subsets and of list entries over the sizes of all classes is least."""

    def cost(b: int) -> float:
        return sum(c * (light_keys(n, b) + (scan_cost * prefix_size(n) if n > b else 0)) for n, c in sizes.items() if n)

    return min(range(most + 1), key=cost)


def keys_of(shingles: np.ndarray, boundary: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Light and heavy keys of a set."""
    n = len(shingles)
    out = []
    for a in range(max(1, -(-4 * n // 5)), min(n, boundary) + 1):
        subsets = np.array(list(combinations(range(n), needed(a))))
        out.append(mixed(mixed(shingles ^ _C[3])[subsets].sum(axis=1) + np.full(1, a, dtype=np.uint64) * _C[4]))
    if n > boundary:
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
            order = np.where(frequent[at] == shingles, rank[at], 0)
            if order.any():
                shingles = shingles[np.lexsort((shingles, order))]
        out.append(shingles[: prefix_size(n)])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def parity_width(n: int) -> int:
    """Bits of the parities of ``n`` shingles: so many that bounds at a similarity below about 0.79 rule a link out."""
    return max(64, PARITY * (1 << max(0, n - 1).bit_length()))


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, more than shingles, set where an odd number fall."""
    bits = parity_width(len(shingles))
    odd = np.bincount((mixed(shingles ^ _C[2]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(n: np.ndarray, bits: np.ndarray, own_n: int, own_bits: np.ndarray) -> np.ndarray:
    """The overlap is at most (|A| + |B| - differing parities) / 2."""
    return (n + own_n - np.bitwise_count(bits ^ own_bits).sum(axis=1).astype(np.int64)) // 2


def folded(bits: np.ndarray) -> np.ndarray:
    half = len(bits) // 2
    return bits[:half] ^ bits[half:]


CLASSES = "n_shingles bigint, cid bigint, often array<bigint>, times array<bigint>"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, cid, often, times = [], [], [], []
        held: list[np.ndarray] = []
        held_n = docs = 0
        for _, s in shingle_sets(batch.column("text")):
            size.append(len(s))
            cid.append(set_id(s))
            often.append(None)
            times.append(None)
            held.append(s)
            held_n += len(s)
            docs += 1
            if held_n > 200_000 or len(size) == batch.num_rows:
                value, count = np.unique(np.concatenate(held), return_counts=True)
                some = count >= max(4, FREQUENT * docs)
                if some.any():
                    often[-1], times[-1] = value[some].astype(np.int64), count[some]
                held, held_n, docs = [], 0, 0
        columns = record_batch(CLASSES, size, cid, often, times).columns
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], names=["doc", *(x.split()[0] for x in CLASSES.split(", "))])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of the few links of one task, each with the smallest node they reach."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            for x in (a, b):
                above.setdefault(x, x)
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    yield record_batch("node bigint, comp bigint", list(above), [top(x) for x in above])


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node that links reach, for every node of ``links`` (a, b).

    Each round moves the ends of all links to their smallest neighbour and keeps
    what is still a link; the moves are put together afterwards. At most ``FEW``
    links need no rounds, each of them several jobs: one task unites their ends.
    """
    links = stored(links.select("a", "b").where("a <> b").distinct())
    moves: list[DataFrame] = []
    while links.count() > FEW:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        moves.append(move)
        at_a = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        at_b = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        before, links = links, stored(
            links.join(at_a, "a").join(at_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        release(before)
    comp = stored(links.coalesce(1).mapInArrow(_united, "node bigint, comp bigint"))
    if not moves:
        release(links)
        return comp
    moves.append(comp.withColumnRenamed("comp", "to"))
    out = moves[0].select("node", F.col("to").alias("comp"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("comp"), "to")
        out = out.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    out = stored(out)
    release(links, comp, *moves)
    return out


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    side = {x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab"}
    both = pairs.join(side["a"], "a", "left").join(side["b"], "b", "left")
    return both.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")


def open_bands(live: DataFrame) -> DataFrame:
    """``list`` and ``band`` of the members that can still link to another component of their list.

    Partners differ in size by a quarter at most, so they lie in the same band of
    sizes or in the next one: bands whose neighbourhood is of one component are done with.
    """
    ends = live.groupBy("list", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    near = ends.select("list", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"), "lo", "hi")
    return near.groupBy("list", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("list", "band")


def _close(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Attach a column of ``sets`` for both ends of pairs."""
    side = {x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"v_{x}")) for x in "ab"}
    return pairs.join(side["b"], "b").join(side["a"], "a")


MAY = "a bigint, b bigint, bound double"


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, bound = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "v_a", "v_b"))
        for x, y, n, m, s, t in zip(*columns, strict=True):
            u, v = np.frombuffer(s, dtype="<u8"), np.frombuffer(t, dtype="<u8")
            while len(u) > len(v):
                u = folded(u)
            while len(v) > len(u):
                v = folded(v)
            most = int(overlap_bound(np.array([n]), u[None, :], m, v)[0])
            if 9 * most >= 4 * (n + m):
                a.append(x)
                b.append(y)
                bound.append(most / (n + m))
        yield record_batch(MAY, a, b, bound)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for s, t in zip(batch.column("v_a").to_pylist(), batch.column("v_b").to_pylist(), strict=True):
            u, v = np.frombuffer(s, dtype="<u8"), np.frombuffer(t, dtype="<u8")
            shared = len(np.intersect1d(u, v, assume_unique=True))
            ok.append(9 * shared >= 4 * (len(u) + len(v)))
        yield record_batch("a bigint, b bigint, ok boolean", batch.column("a"), batch.column("b"), ok)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b`` and whether they link, by their whole sets."""
    return stored(_close(pairs.distinct(), sets, "members").mapInArrow(_linked, "a bigint, b bigint, ok boolean").distinct())


def _emitter(ddl: str, made, flags):
    """Rows ``made`` of the shingle sets of those texts whose key ``k`` a shared bitmap holds."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(flagged(flags.value, batch.column("k").to_numpy())))
            rows, size = [], 0
            for _, s in shingle_sets(some.column("text")):
                rows.append(made(s))
                size += len(s)
                if size > 500_000:
                    yield record_batch(ddl, *zip(*rows, strict=True))
                    rows, size = [], 0
            if rows:
                yield record_batch(ddl, *zip(*rows, strict=True))

    return emit


PARITIES = "cid bigint, n bigint, bits binary"
WHOLE = "cid bigint, n bigint, members binary"


def meet(n: list[int], cid: list[int], comp: list[int], block: list[int] | None, bits: list[int], tried: set[tuple[int, int]], every: bool) -> list[tuple[int, int]]:
    """Untried pairs between the components of one list block whose parities leave a link possible.

    Members come by ascending size; parities are whole numbers of as many bits as
    ``width`` tells. Either a spanning forest of such pairs, or, with ``every``, all of them.
    """
    found = []
    width = [parity_width(x) for x in n]
    half = [(x ^ (x >> (w // 2))) & ((1 << (w // 2)) - 1) for x, w in zip(bits, width, strict=True)]
    for i in range(len(n)):
        most, ni, ci, wi, bi = n[i] * 5 // 4, n[i], cid[i], width[i], bits[i]
        for j in range(i + 1, len(n)):
            if n[j] > most:
                break
            if comp[j] == comp[i] or (block is not None and block[i] == block[j]):
                continue
            apart = (bi ^ (bits[j] if width[j] == wi else half[j])).bit_count()
            both = ni + n[j]
            if 9 * ((both - apart) // 2) < 4 * both:
                continue
            pair = (ci, cid[j]) if ci < cid[j] else (cid[j], ci)
            if pair in tried:
                continue
            found.append(pair)
            if not every:
                old, new = comp[j], comp[i]
                comp = [new if c == old else c for c in comp]
    return found


KEYS = "key bigint, cid bigint, n int"
MEMBERS = "bucket int, list bigint, r1 int, r2 int, cid bigint, comp bigint, block int, other bigint, n bigint, bits binary"
FOUND = "list bigint, r1 int, r2 int, a bigint, b bigint"


def _meetings(every: bool):
    def in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        """All list blocks of a bucket; rows with ``n`` 0 are tried pairs."""
        pdf = pdf.sort_values(["list", "r1", "r2", "n", "cid"], ignore_index=True)
        key = pdf[["list", "r1", "r2"]].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
        columns = {c: pdf[c].tolist() for c in ("n", "cid", "comp", "block", "other")}
        bits = [int.from_bytes(x, "little") if x is not None else 0 for x in pdf["bits"]]
        out = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            n, cid, comp, block, other = (columns[c][lo:hi] for c in ("n", "cid", "comp", "block", "other"))
            first = sum(1 for x in n if x == 0)
            tried = set(zip(cid[:first], other[:first], strict=True))
            rows = [i for i in range(first, hi - lo) if i == first or cid[i] != cid[i - 1]]
            head = key[lo].tolist()
            own = ([x[i] for i in rows] for x in (n, cid, comp, block))
            n, cid, comp, block = own
            cross = block if head[1] != head[2] else None
            out += [(*head, a, b) for a, b in meet(n, cid, comp, cross, [bits[lo + i] for i in rows], tried, every)]
        return pd.DataFrame(out, columns=["list", "r1", "r2", "a", "b"]).astype("int64")

    return in_bucket


def shingle_classes(docs: DataFrame, id_column: str) -> DataFrame:
    """``doc``, ``n_shingles``, ``cid`` (id of its set; 0 for the empty set) and now and then frequent shingles of a slice."""
    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("doc"), "text")
    return stored(texts.mapInArrow(_classes, f"doc {kind}, {CLASSES}"))


def link_classes(docs: DataFrame, id_column: str, classes: DataFrame) -> DataFrame:
    """Links between classes (a, b) that leave no component apart; not all links inside a component are among them."""
    spark = docs.sparkSession
    context = spark.sparkContext
    sizes = {
        r["n_shingles"]: r["count"]
        for r in classes.where(F.col("n_shingles") <= 2 * MOST_LIGHT).select("cid", "n_shingles").distinct().groupBy("n_shingles").count().collect()
    }
    boundary = choose_boundary(sizes)
    # At most MOST_FREQUENT shingles reach the driver; they only order prefixes.
    often = (
        classes.where(F.col("often").isNotNull())
        .select(F.explode(F.arrays_zip("often", "times")).alias("x"))
        .groupBy(F.col("x.often").alias("shingle"))
        .agg(F.sum("x.times").alias("times"))
        .orderBy(F.desc("times"), "shingle")
        .limit(MOST_FREQUENT)
        .toPandas()
    )
    frequent = often["shingle"].to_numpy(np.int64).astype(np.uint64)
    by = np.argsort(frequent)
    rank = 1 + np.log2(np.maximum(often["times"].to_numpy(np.float64), 1)).astype(np.int64)
    shared = context.broadcast((frequent[by], rank[by]))

    def emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, cid, size, seen = [], [], [], set()
            for _, s in shingle_sets(batch.column("text")):
                if not len(s) or (c := set_id(s)) in seen:
                    continue
                seen.add(c)
                own = keys_of(s, boundary, *shared.value)
                key.append(own.astype(np.int64))
                cid.append(np.full(len(own), c, dtype=np.int64))
                size.append(np.full(len(own), len(s), dtype=np.int32))
                if sum(map(len, key[-200:])) > 100_000:
                    yield record_batch(KEYS, np.concatenate(key), np.concatenate(cid), np.concatenate(size))
                    key, cid, size = [], [], []
            if key:
                yield record_batch(KEYS, np.concatenate(key), np.concatenate(cid), np.concatenate(size))

    texts = docs.select("text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    postings = texts.mapInArrow(emit_keys, KEYS).select("key", "cid").repartition(parts, "key").dropDuplicates(["key", "cid"])
    lists = postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64("cid")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y"),
    )
    shared_lists = lists.where("m > 1").groupBy("m", "x", "y").agg(F.min("key").alias("key"))
    shared_lists = stored(shared_lists)
    tidy(spark)  # the shuffle of all keys is done with
    kept = bitmap(shared_lists, "key", FILTER_BITS)
    lists_flags = context.broadcast(kept)

    def emit_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emit_keys(batches):
            yield batch.filter(pa.array(flagged(lists_flags.value, batch.column("key").to_numpy())))

    members = (
        texts.mapInArrow(emit_members, KEYS)
        .dropDuplicates(["key", "cid"])
        .join(shared_lists.select("key", "m"), "key")
        .select(F.col("key").alias("list"), "cid", "n", "m")
    )
    members = stored(members)
    lists_flags.destroy()
    shared.destroy()
    del kept, often, frequent, rank
    release(shared_lists)
    # One document for each class in a list stands for it. Its parities are kept, its whole set only while pairs with it are compared.
    bearers = stored(
        classes.join(members.select("cid").distinct(), "cid").groupBy("cid").agg(F.xxhash64(F.min("doc")).alias("k"))
    )
    keyed = docs.select(F.xxhash64(F.col(id_column)).alias("k"), "text")

    def texts_of(cids: DataFrame, ddl: str, made) -> DataFrame:
        flags = context.broadcast(bitmap(bearers.join(cids, "cid", "left_semi").select("k"), "k", FILTER_BITS))
        out = stored(keyed.mapInArrow(_emitter(ddl, made, flags), ddl))
        flags.destroy()
        return out

    def whole_sets(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        return texts_of(ends, WHOLE, lambda s: (set_id(s), len(s), s.tobytes()))

    sets = texts_of(bearers.select("cid"), PARITIES, lambda s: (set_id(s), len(s), parity_bits(s)))
    # First every list's members with its first one.
    heads = members.groupBy("list").agg(F.min("cid").alias("head"), F.min_by("n", "cid").alias("n_head"))
    fit = (F.col("n") * 4 <= F.col("n_head") * 5) & (F.col("n_head") * 4 <= F.col("n") * 5)
    headed = members.join(heads, "list").where("cid <> head")
    # Sizes alone end most of these pairs, before any parities travel.
    stars = headed.where(fit).select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    may = stored(_close(stars, sets, "bits").mapInArrow(_may_link, MAY))
    # One pair for each member, the likeliest; then the other pairs whose ends are still apart.
    likeliest = may.groupBy("b").agg(F.max_by("a", F.struct("bound", "a")).alias("a")).select("a", "b")
    whole = whole_sets(may)
    told = verified(likeliest, whole)
    comps = connected(told.where("ok").select("a", "b"))
    rest = stored(apart(may.select("a", "b").join(told, ["a", "b"], "left_anti"), comps))
    release(comps)
    told = told.unionByName(verified(rest, whole))
    release(whole, rest, may)
    links = told.where("ok").select("a", "b")
    # Stars told apart by their bounds cannot link, so all pairs with a list's first member are done with.
    others = headed.drop("head", "n_head")
    tried = None
    failed_stars = stored(told.where("not ok").select("a", "b"))
    for turn in range(1, ROUNDS + 1):
        comps = connected(links)
        live = others.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        live = live.withColumn("band", F.floor(F.log("n") / F.lit(log(BAND))).cast("int"))
        open_ = stored(open_bands(live))
        live = stored(live.join(open_, ["list", "band"]))
        size = live.count()
        if not size:
            release(live, open_, comps)
            break
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        dealt = (
            live.join(sets.select("cid", "bits"), "cid")
            .withColumn("block", F.pmod(F.xxhash64("cid", "list"), blocks).cast("int"))
            .withColumn("x", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("r1", F.least("block", "x"))
            .withColumn("r2", F.greatest("block", "x"))
            .withColumn("other", F.lit(0).cast("bigint"))
        )
        bucket = F.pmod(F.xxhash64("list", "r1", "r2"), F.lit(-(-size // BUCKET_ROWS))).cast("int").alias("bucket")
        names = [x.split()[0] for x in MEMBERS.split(", ")][1:]
        rows = dealt.withColumn("n", F.col("n").cast("bigint")).select(bucket, *names)
        if tried is not None:
            done = tried.join(open_.select("list").distinct(), "list").select(
                "list", "r1", "r2", F.col("a").alias("cid"), F.lit(0).cast("bigint").alias("comp"), F.lit(0).alias("block"),
                F.col("b").alias("other"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("bits"),
            )
            rows = rows.unionByName(done.select(bucket, *names))
        found = stored(rows.groupBy("bucket").applyInPandas(_meetings(turn == ROUNDS), FOUND))
        release(live, open_, comps)
        if found.isEmpty():
            break
        asked = stored(found.select("a", "b").join(failed_stars, ["a", "b"], "left_anti").distinct())
        whole = whole_sets(asked)
        told = verified(asked, whole)
        good = told.where("ok").select("a", "b")
        links = links.unionByName(good)
        failed = found.join(good, ["a", "b"], "left_anti").select(*[x.split()[0] for x in FOUND.split(", ")])
        before, tried = tried, stored(failed if tried is None else tried.unionByName(failed))
        release(asked, whole, found, *([] if before is None else [before]))
    release(members, sets, bearers, failed_stars, *([] if tried is None else [tried]))
    return links


def near_duplicate_groups(docs: DataFrame, id_column: str) -> DataFrame:
    """``doc``, ``n_shingles`` and ``component_id``: the smallest id that links reach from a row, its own included.

    Rows without words (null or white space) are linked with nothing and are their
    own component, also where they repeat. Null ids join components but give
    their id to one only if it has no other. Rows come once each.
    """
    classes = shingle_classes(docs, id_column)
    comps = connected(link_classes(docs, id_column, classes))
    rows = classes.select("doc", "n_shingles", "cid").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    rows = stored(rows.select("doc", "n_shingles", F.coalesce("comp", "cid").alias("comp")))
    smallest = rows.where("n_shingles > 0").groupBy("comp").agg(F.min("doc").alias("component_id"))
    linked = rows.where("n_shingles > 0").join(smallest, "comp").select("doc", "n_shingles", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0").select("doc", "n_shingles", F.col("doc").alias("component_id")))


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a Jaccard similarity of 0.8 or more."""
    out = near_duplicate_groups(table(spark, sf_dir, "documents"), "doc_id")
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate group the document of the smallest id stays, once.

    Rows without words and rows with a null id stay; a row repeated with id and text stays once.
    """
    groups = stored(near_duplicate_groups(docs, "doc_id"))
    gone = groups.where("doc <> component_id").select(F.col("doc").alias("doc_id")).distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = stored(groups.where("n_shingles > 0").groupBy(F.col("doc").alias("doc_id")).count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)
