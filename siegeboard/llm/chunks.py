"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text. Where certain bits of it are small,
a chunk ends, so chunk borders depend on the bytes just before them alone and
fall into step again after an insertion. Chunks are identified by a 128-bit
digest; the first occurrence of a digest (by document, then place) stays, and
runs of later occurrences are repeated passages.

Two passes keep the shuffle small. The first counts 64-bit parts of the digests
and marks those that occur twice in a bitmap of fixed size; the second sends on
only chunks that the bitmap lets through. A full bitmap lets more through, and
changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import bitmap, byte_slices, flagged, record_batch, shield, stored, table

WINDOW = 32
#: A chunk ends where bits 12 to 19 of the hash are below CUT, every 26 bytes on average.
SHIFT, CUT = 12, 10
MIN_CHUNK, MAX_CHUNK = 8, 256
#: Shorter runs of repeated chunks are left in place: about 15 words.
MIN_RUN = 96
FILTER_BITS = 27

GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, size=256, dtype=np.uint32)


def gear_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, over at most the last 32 bytes of the same text."""
    sizes = np.diff(ends)
    at = np.arange(len(data)) + WINDOW * (1 + np.repeat(np.arange(len(sizes)), sizes))
    h = np.zeros(len(data) + WINDOW * (len(sizes) + 1), dtype=np.uint32)
    h[at] = GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h[at]


def chunk_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks end, for all texts of a slice; the end of a text always is one. Characters are not cut."""
    h = gear_hashes(data, ends)
    starts_character = np.concatenate([(data[1:] & 0xC0) != 0x80, [True]]) if len(data) else np.zeros(0, bool)
    cut = ((h >> np.uint32(SHIFT)) & np.uint32(0xFF)) < CUT
    last = np.zeros(len(data), dtype=bool)
    last[ends[1:][ends[1:] > ends[:-1]] - 1] = True
    found = np.flatnonzero((cut & starts_character) | last)
    out: list[int] = []
    before = 0
    for place, end in zip((found + 1).tolist(), last[found].tolist(), strict=True):
        while place - before > MAX_CHUNK:
            before += MAX_CHUNK
            while data[before] & 0xC0 == 0x80:
                before -= 1
            out.append(before)
        if end or place - before >= MIN_CHUNK:
            out.append(place)
            before = place
    return np.array(out, dtype=np.int64)


def chunk_slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, start in the text, size and two digest halves (columns) of every chunk, slice by slice."""
    for lo, _, data, ends in byte_slices(column):
        if not len(data):
            continue
        stop = chunk_ends(data, ends)
        start = np.concatenate([[0], stop[:-1]])
        raw = data.tobytes()
        digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
        row = np.searchsorted(ends, start, side="right") - 1
        yield lo + row, start - ends[row], stop - start, np.frombuffer(digests, dtype="<i8").reshape(-1, 2)


def _digest_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, digest in chunk_slices(batch.column("text")):
            value, count = np.unique(digest[:, 1], return_counts=True)
            yield record_batch("digest bigint, n bigint", value, count)


def repeated_chunks(docs: DataFrame, id_column: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Every chunk that an earlier place holds too: id, row key, start, size, and the first place.

    Earlier means a smaller id, then a smaller row key (hash of the text), then a
    smaller start. Rows equal in id and text are one document. A null id comes first.
    """
    texts = docs.select(id_column, "text")
    counts = texts.mapInArrow(_digest_counts, "digest bigint, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(counts.where("n > 1"), "digest", filter_bits))
    kind = docs.schema[id_column].dataType.simpleString()
    places = "start bigint, size bigint, high bigint, low bigint"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, start, size, digest in chunk_slices(batch.column("text")):
                some = flagged(shared.value, digest[:, 1])
                at = pa.array(row[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_column).take(at),
                        batch.column("row_key").take(at),
                        *record_batch(places, start[some], size[some], digest[some, 0], digest[some, 1]).columns,
                    ],
                    names=[id_column, "row_key", "start", "size", "high", "low"],
                )

    chunks = stored(
        texts.withColumn("row_key", F.xxhash64("text")).mapInArrow(emit, f"`{id_column}` {kind}, row_key bigint, {places}")
    )
    place = F.struct(id_column, "row_key", "start")
    firsts = chunks.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    return (
        chunks.join(firsts, ["high", "low"])
        .where(place != F.col("first"))
        .select(id_column, "row_key", "start", "size", "first")
    )


def repeated_passages(docs: DataFrame, id_column: str, min_run: int = MIN_RUN) -> DataFrame:
    """Runs of adjacent repeated chunks of at least ``min_run`` bytes.

    One row a run: id, row key, ``start`` and ``size`` in bytes, ``chunks``, and where its first chunk was seen first.
    Null and empty texts have none.
    """
    chunks = repeated_chunks(docs, id_column).distinct()
    order = Window.partitionBy(id_column, "row_key").orderBy("start")
    end = F.col("start") + F.col("size")
    runs = chunks.withColumn("opens", F.coalesce(F.lag(end).over(order) != F.col("start"), F.lit(True)).cast("int")).withColumn(
        "run", F.sum("opens").over(order)
    )
    return (
        runs.groupBy(id_column, "row_key", "run")
        .agg(
            F.min("start").alias("start"),
            F.sum("size").alias("size"),
            F.count(F.lit(1)).alias("chunks"),
            F.min(F.struct("start", "first")).alias("head"),
        )
        .where(F.col("size") >= min_run)
        .select(
            id_column,
            "row_key",
            "start",
            "size",
            "chunks",
            F.col(f"head.first.{id_column}").alias(f"first_{id_column}"),
            F.col("head.first.start").alias("first_start"),
        )
    )


def without_repeats(docs: DataFrame, id_column: str, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``; everything else stays as it is."""
    docs, back = shield(docs)
    id_column = {old: new for new, old in back.items()}.get(id_column, id_column)
    spans = (
        repeated_passages(docs, id_column, min_run)
        .groupBy(F.col(id_column).alias("_id"), F.col("row_key").alias("_key"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("_spans"))
    )  # as many as a text has room for
    joined = docs.withColumn("_row", F.xxhash64("text")).join(
        spans, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key")), "left"
    )
    raw = F.encode("text", "UTF-8")
    kept = F.expr(
        """aggregate(_spans, named_struct('at', 0L, 'out', cast('' as binary)),
             (a, s) -> named_struct('at', s.start + s.size,
                                    'out', concat(a.out, substring(_raw, cast(a.at + 1 as int), cast(s.start - a.at as int)))),
             a -> concat(a.out, substring(_raw, cast(a.at + 1 as int), octet_length(_raw))))"""
    )
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.decode(kept, "UTF-8"))
    return joined.withColumn("_raw", raw).withColumn("text", text).select(*docs.columns).withColumnsRenamed(back)


def op3_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """Passages of all documents that an earlier place holds too: document, place, and where they come from."""
    return repeated_passages(table(spark, sf_dir, "documents"), "doc_id").drop("row_key")
