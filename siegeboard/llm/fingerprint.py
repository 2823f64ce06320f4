"""Homomorphic multiset fingerprints of documents, in built-in functions only.

A text is the multiset of its passages: paragraphs, cut further at sentence
ends. Every passage is hashed to a wide vector, and the fingerprint is the sum
of these vectors, lane by lane, modulo powers of two:

* lane 0: number of passages, modulo 2^32;
* lanes 1 to 8: 256 hash bits as eight numbers, added modulo 2^32. They decide equality;
* lanes 9 to 40: two counters each, modulo 2^31. Counter k counts the passages
  whose k-th hash bit is set. Read as +1 and -1 these 64 sums are a linear
  sketch: the mean square of their differences estimates the number of passages
  that two texts do not share.

Sums do not depend on order. ``insert`` and ``delete`` change a fingerprint by
that of the passages which come or go, without the rest of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import table

WIDE = 4  # 64-bit hashes, two lanes each
PACKED = 32  # lanes of two counters
LOW32 = (1 << 32) - 1
LOW31 = (1 << 31) - 1
ONE = 1 | 1 << 32
PASSAGE_END = r"[\r\n]+|(?<=[.!?]) +"

#: Bounds of the bucket list that the driver holds.
CELLS = 4096
MAX_BUCKETS = 16_384


def _lanes(passage: Column) -> list[Column]:
    """Sums that make the lanes of a group of passages; empty and null passages count nothing.

    No sum overflows: a text of 2^31 bytes has at most 2^30 passages.
    """
    some = passage != ""
    out = [F.count(F.when(some, 1)).cast("long")]

    def total(value: Column, mask: int) -> Column:
        return F.coalesce(F.sum(F.when(some, value)), F.lit(0)).bitwiseAND(F.lit(mask))

    for k in range(1, WIDE + 1):
        h = F.xxhash64(F.lit(k), passage)
        out += [total(h.bitwiseAND(F.lit(LOW32)), LOW32), total(F.shiftrightunsigned(h, 32), LOW32)]
    h = F.xxhash64(F.lit(0), passage)
    return out + [total(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(ONE)), LOW31 | LOW31 << 32) for j in range(PACKED)]


def fingerprints(df: DataFrame, texts: list[str]) -> DataFrame:
    """A row for each text column of each row: the other columns, ``text_no`` (place in ``texts``) and ``lanes`` (41 numbers).

    A null text counts as empty and has zeros.
    """
    kept = [c for c in df.columns if c not in texts]
    parts = [F.split(F.coalesce(F.col(c), F.lit("")), PASSAGE_END) for c in texts]
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    passages = rows.select(*kept, "_row", F.posexplode(F.array(*parts)).alias("text_no", "_parts")).select(
        *kept, "_row", "text_no", F.explode("_parts").alias("_passage")
    )
    sums = _lanes(F.col("_passage"))
    return (
        passages.groupBy(*kept, "_row", "text_no")
        .agg(*[x.alias(f"_lane{i}") for i, x in enumerate(sums)])
        .select(*kept, "text_no", F.array(*[F.col(f"_lane{i}") for i in range(len(sums))]).alias("lanes"))
    )


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    def combine(pair: Column, place: Column) -> Column:
        x, y = pair["x"], pair["y"]
        plain = (x + F.lit(sign) * y).bitwiseAND(F.lit(LOW32))
        low = (x.bitwiseAND(F.lit(LOW31)) + F.lit(sign) * y.bitwiseAND(F.lit(LOW31))).bitwiseAND(F.lit(LOW31))
        high = (F.shiftrightunsigned(x, 32) + F.lit(sign) * F.shiftrightunsigned(y, 32)).bitwiseAND(F.lit(LOW31))
        return F.when(place <= 2 * WIDE, plain).otherwise(low + F.shiftleft(high, 32))

    return F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), combine)


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return _lanewise(a, b, 1)


def delete(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the passages of ``b``."""
    return _lanewise(a, b, -1)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal multisets, near 0 for texts that share no passage: 1 - (passages not shared) / (all passages)."""
    n_a, n_b = F.element_at(a, 1), F.element_at(b, 1)
    first = 2 + 2 * WIDE

    def squares(x: Column, y: Column) -> Column:
        low = 2 * (x.bitwiseAND(F.lit(LOW31)) - y.bitwiseAND(F.lit(LOW31))) - (n_a - n_b)
        high = 2 * (F.shiftrightunsigned(x, 32) - F.shiftrightunsigned(y, 32)) - (n_a - n_b)
        return low.cast("double") * low.cast("double") + high.cast("double") * high.cast("double")

    spread = F.aggregate(
        F.zip_with(F.slice(a, first, PACKED), F.slice(b, first, PACKED), squares), F.lit(0.0), lambda acc, v: acc + v
    ) / F.lit(2.0 * PACKED)
    return (
        F.when(a == b, F.lit(1.0))
        .when(n_a + n_b == 0, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - spread / (n_a + n_b).cast("double")))
    )


def as_text(lanes: Column) -> Column:
    """Hexadecimal lanes, joined by dots."""
    return F.array_join(F.transform(lanes, lambda v: F.lower(F.hex(v))), ".")


def neighbours(df: DataFrame, key: str, rows_per_bucket: int = 1000) -> DataFrame:
    """Deal rows to buckets in which each row's follower by ``key`` is at hand; after the last row comes the first.

    Keys fall into buckets (``home``) of neighbouring values: equal cells of the
    key range, each cut evenly by its row count. The first row of a bucket is
    also sent to the bucket before it, as ``copy`` 1. In the order of home, copy
    and key every row of copy 0 is followed by its neighbour. Null keys come first.
    """
    spark = df.sparkSession
    x = F.col(key).cast("double")
    low, high, total = df.agg(F.min(x), F.max(x), F.count(F.lit(1))).first()
    if not total or low is None:
        low = high = 0.0
    span = (high - low) or 1.0
    rows_per_bucket = max(rows_per_bucket, -(-total // (MAX_BUCKETS - CELLS)))
    place = F.coalesce((x - F.lit(low)) / F.lit(span) * F.lit(float(CELLS)), F.lit(0.0))
    cell = F.least(F.floor(place), F.lit(CELLS - 1)).cast("int")
    # Neighbouring cells with few rows share a bucket, cells with many are cut; at most CELLS counts reach the driver.
    counts = {r["c"]: r["count"] for r in df.select(cell.alias("c")).groupBy("c").count().collect()}
    start, cuts, used, filled = [], [], 0, 0
    for c in range(CELLS):
        n = counts.get(c, 0)
        if n > rows_per_bucket:
            used += filled > 0
            start.append(used)
            cuts.append(-(-n // rows_per_bucket))
            used, filled = used + cuts[-1], 0
        else:
            if filled + n > rows_per_bucket:
                used, filled = used + 1, 0
            start.append(used)
            cuts.append(1)
            filled += n
    places = spark.createDataFrame(list(zip(range(CELLS), start, cuts, strict=True)), "_cell int, _start int, _cuts int")
    rows = (
        df.withColumn("_cell", cell)
        .withColumn("_place", place)
        .join(F.broadcast(places), "_cell")
        .withColumn("_bucket", F.col("_start") + F.least(F.floor((F.col("_place") - F.col("_cell")) * F.col("_cuts")), F.col("_cuts") - 1).cast("int"))
        .drop("_cell", "_place", "_start", "_cuts")
    )
    # At most MAX_BUCKETS rows reach the driver.
    firsts = (
        rows.groupBy("_bucket").agg(F.min(key).alias("first"), F.max(F.col(key).isNull()).alias("nulls")).orderBy("_bucket").collect()
    )
    before = [
        (r["_bucket"], None if r["nulls"] else r["first"], firsts[i - 1]["_bucket"]) for i, r in enumerate(firsts)
    ]
    key_type = df.schema[key].dataType.simpleString()
    edges = spark.createDataFrame(before, f"_bucket int, _first {key_type}, _before int")
    return rows.join(F.broadcast(edges), "_bucket").select(
        *df.columns,
        F.posexplode(
            F.when(F.col(key).eqNullSafe(F.col("_first")), F.array("_bucket", "_before")).otherwise(F.array("_bucket"))
        ).alias("copy", "home"),
    )


def op7_multiset_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    Null texts count as empty; rows of equal id follow each other by text; a lone document follows itself.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["copy", F.col("doc_id").asc_nulls_first(), "text"]
    window = Window.partitionBy("home").orderBy(*order)
    rows = neighbours(docs, "doc_id").select("*", F.lead("text").over(window).alias("following"), F.row_number().over(window).alias("place"))
    n = F.char_length("text").cast("long")
    kept = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - kept).cast("int")), F.substring("following", F.lit(1), kept))
    rows = rows.select(
        "doc_id", "home", "copy", "place", n.alias("n_chars"), "text", edited.alias("edited"),
        F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"),
    )
    told = fingerprints(rows, ["text", "edited"])
    own = Window.partitionBy("home").orderBy("place", "text_no")
    return (
        told.select("*", F.lead("lanes").over(own).alias("edited_lanes"), F.lead("lanes", 2).over(own).alias("next_lanes"))
        .where((F.col("copy") == 0) & (F.col("text_no") == 0))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("lanes")).alias("fingerprint"),
            as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
            likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
            likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
        )
    )
