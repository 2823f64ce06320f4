"""Line deduplication: repeated runs of lines by prefix doubling over line ids.

The sequence is that of all lines of all documents; a position is a line in its
document. The suffix that starts at a position is named, for h = 1, 2, 4, ...,
by the first position whose next h lines read the same. Two named halves make
the next name, so a round costs one join and one grouping, and a position whose
name nobody shares leaves the rounds: longer prefixes from there are single too.
A name is an interval of the suffix array whose common prefix has at least h
lines, with its first position at hand.

A run of lines is a repeated one if it holds ``min_words`` words and an earlier
place has the same lines. A maximal repeated run is the union of the shortest
such runs that start or end at one of its lines, so only these are looked up:
their names are put together from those of powers of two. Every line of a
maximal repeated run is deleted, save in its first place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import record_batch, shield, stored, table

#: A repeated run is deleted if it holds so many words.
MIN_WORDS = 10

LINES = "row bigint, line int, a bigint, b bigint, runs array<int>"


def shortest_runs(words: np.ndarray, least: int) -> list[list[int]]:
    """For each line the lengths of runs from there: the shortest that hold ``least`` words by their start or by their end."""
    n = len(words)
    run = np.concatenate([[0], np.cumsum(words)])
    out: list[list[int]] = [[] for _ in range(n)]
    stop = np.searchsorted(run, run[:-1] + least)  # the run is lines i to stop - 1
    for i in np.flatnonzero(stop <= n):
        out[i].append(int(stop[i] - i))
    start = np.searchsorted(run, run[1:] - least, side="right") - 1
    for j in np.flatnonzero(start >= 0):
        i, size = int(start[j]), int(j + 1 - start[j])
        if size not in out[i]:
            out[i].append(size)
    return out


def line_table(docs: DataFrame, id_column: str, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a line: ``doc``, ``row`` (hash of the text), ``line`` from 0, its 128-bit id in two halves, ``runs``.

    Lines end at a line feed. A null text has no lines, an empty one has one without words.
    """
    schema = T.StructType([T.StructField("doc", docs.schema[id_column].dataType), *T._parse_datatype_string(LINES).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, numbers, digests, runs = [], [], [], [], []
            own = batch.column("row").to_pylist()
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                if text is None:
                    continue
                lines = text.encode().split(b"\n")
                at += [i] * len(lines)
                keys += [own[i]] * len(lines)
                numbers += range(len(lines))
                digests += [xxhash.xxh3_128_digest(x) for x in lines]
                runs += shortest_runs(np.array([len(x.split()) for x in lines]), min_words)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            columns = record_batch(LINES, keys, numbers, halves[:, 0], halves[:, 1], runs).columns
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), *columns], names=schema.names)

    texts = docs.select(F.col(id_column).alias("doc"), F.xxhash64("text").alias("row"), "text")
    return texts.mapInArrow(cut, schema)


def _position() -> Column:
    return F.struct("doc", "row", "line")


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    """Name positions by the first one of equal ``keys``; positions that share theirs with no other are left out.

    A minimum and a maximum a key and task travel, so a key with a third of all rows costs no task more than others.
    """
    ends = df.groupBy(*keys).agg(F.min(_position()).alias("name"), F.max(_position()).alias("_last")).where("name <> _last")
    return df.join(ends.drop("_last"), keys).drop(*keys)


def _ahead(left: DataFrame, names: DataFrame, distance: Column, alias: str) -> DataFrame:
    """Join what the position ``distance`` lines ahead is called."""
    right = names.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("line").alias("_line"), F.col("name").alias(alias))
    here = F.col("doc").eqNullSafe(F.col("_doc")) & F.col("row").eqNullSafe(F.col("_row")) & (F.col("line") + distance == F.col("_line"))
    return left.join(right, here).drop("_doc", "_row", "_line")


def repeated_runs(lines: DataFrame) -> DataFrame:
    """Runs of a line table that an earlier place has too: ``doc``, ``row``, ``line``, ``size`` and ``first`` (the place).

    Places are ordered by document id, then hash of the text, then line; a null id comes first.
    """
    lines = lines.distinct()  # rows equal in id and text are one document
    names = stored(_named(lines.drop("runs"), ["a", "b"]))
    shared = _ahead(lines.where(F.size("runs") > 0).drop("a", "b"), names, F.lit(0), "whole")
    runs = stored(shared.select("doc", "row", "line", F.explode("runs").alias("size")))
    longest = runs.agg(F.max("size")).first()[0] or 0
    levels = [names]
    while 2 << (len(levels) - 1) <= longest:
        pairs = _ahead(levels[-1], levels[-1], F.lit(1 << (len(levels) - 1)), "half")
        levels.append(stored(_named(pairs.withColumnRenamed("name", "start"), ["start", "half"])))
    named = runs.withColumn("parts", F.array().cast(T.ArrayType(names.schema["name"].dataType)))
    for k in range(len(levels) - 1, -1, -1):
        h = 1 << k
        has = F.col("size").bitwiseAND(F.lit(h)) != 0
        done = F.col("size").bitwiseAND(F.lit(-2 * h))  # the larger powers of the size come first
        longer = _ahead(named.where(has), levels[k], done, "part").withColumn("parts", F.concat("parts", F.array("part"))).drop("part")
        named = named.where(~has).unionByName(longer)
    keys = ["size", "parts"]
    first = named.groupBy(*keys).agg(F.min(_position()).alias("first"), F.max(_position()).alias("_last")).where("first <> _last")
    return named.join(first.drop("_last"), keys).where(F.col("first") != _position()).select("doc", "row", "line", "size", "first")


def marked(docs: DataFrame, id_column: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``_gone``: start and size of the repeated runs of each text, or null where there are none."""
    runs = stored(repeated_runs(stored(line_table(docs, id_column, min_words))).select("doc", "row", "line", "size"))
    gone = runs.groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row")).agg(
        F.collect_list(F.struct("line", "size")).alias("_gone")  # at most two runs a line of one text
    )
    own = docs.withColumn("_key", F.xxhash64("text"))
    here = F.col(id_column).eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_row"))
    return own.join(gone.hint("shuffle_hash"), here, "left").drop("_key", "_doc", "_row")


def _without(batch: pa.RecordBatch) -> Iterator[tuple[list[str] | None, list[str] | None, list[int]]]:
    for text, gone in zip(batch.column("text"), batch.column("_gone"), strict=True):
        if not text.is_valid:
            yield None, None, []
            continue
        lines = text.as_py().split("\n")
        if not gone.is_valid:
            yield lines, lines, []
            continue
        edges = np.zeros(len(lines) + 1, dtype=np.int64)
        for run in gone.as_py():
            edges[run["line"]] += 1
            edges[run["line"] + run["size"]] -= 1
        out = np.cumsum(edges[:-1]) > 0
        yield lines, [x for x, drop in zip(lines, out, strict=True) if not drop], [int(i) for i in np.flatnonzero(out)]


def without_repeated_runs(docs: DataFrame, id_column: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the later copies of repeated runs; documents of which nothing is left by that go.

    ``text`` is what stays, joined by line feeds, and ``n_chars``, if there is such
    a column, its length; other columns and untouched rows stay as they are.
    """
    docs, back = shield(docs)
    id_column = {old: new for new, old in back.items()}.get(id_column, id_column)
    found = marked(docs, id_column, min_words)
    changed = found.where(F.col("_gone").isNotNull())
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = ["\n".join(k) if k else None for _, k, _ in _without(batch)]
            some = pa.array([k is not None for k in kept])
            columns = []
            for name in schema.names:
                old = batch.column(name)
                new = kept if name == "text" else [len(k) if k is not None else None for k in kept] if name == "n_chars" else None
                columns.append((old if new is None else pa.array(new, type=old.type)).filter(some))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.where(F.col("_gone").isNull()).drop("_gone").unionByName(changed.mapInArrow(cut, schema)).withColumnsRenamed(back)


REPORT = "n_lines int, deleted array<int>, kept_chars bigint, kept_crc32 bigint"


def op5_line_runs(spark, sf_dir: str) -> DataFrame:
    """Every document with its number of lines, the lines deleted, and length (code points) and crc32 of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, deleted, chars, crc = [], [], [], []
            for lines, kept, gone in _without(batch):
                left = "\n".join(kept or [])
                n.append(len(lines or []))
                deleted.append(gone)
                chars.append(len(left))
                crc.append(zlib.crc32(left.encode()))
            columns = record_batch(REPORT, n, deleted, chars, crc).columns
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *(x.split()[0] for x in REPORT.split(", "))])

    return marked(docs, "doc_id").mapInArrow(report, f"doc_id bigint, {REPORT}")


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later copies of repeated line runs are deleted."""
    return without_repeated_runs(docs, "doc_id")
