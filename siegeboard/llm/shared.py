"""Helpers of the training-data operators: stored tables, byte blocks of text columns, sums of vectors."""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word is a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are handled in slices of about so many bytes, so that numpy's temporaries stay small.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and read it again.

    Later jobs read only the columns they need, a lost executor costs no more
    than its own tasks, and generated values do not change between jobs.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = [path]
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables whose last reader has run; other DataFrames are left alone."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for path in df.__dict__.pop("stored_at", []):
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        tidy(tables[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage.

    Spark deletes the shuffle files of finished jobs once their plans are collected,
    which else may be long after the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shield(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that begin with an underscore renamed, and their names to be given back at the end.

    Names with a leading underscore are the operators' own while they work.
    """
    taken = {c.lower() for c in df.columns}
    back: dict[str, str] = {}
    for name in df.columns:
        if name.startswith("_"):
            i = len(back)
            while f"own{i}" in taken:
                i += 1
            taken.add(f"own{i}")
            back[f"own{i}"] = name
    return df.withColumnsRenamed({old: new for new, old in back.items()}), back


def is_training(key: Column, modulus: int, held_out: int) -> Column:
    """False for rows whose crc32 of the id as text leaves the remainder ``held_out``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus != held_out


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and its len + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi`` of a column with their bytes and offsets, about ``limit`` bytes at a time.

    A text is never cut: one longer than the limit is a slice of its own.
    """
    data, ends = column_bytes(column)
    lo = 0
    while lo < len(ends) - 1:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


#: Arrow types by the names used in Spark's DDL.
ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def record_batch(ddl: str, *columns) -> pa.RecordBatch:
    """Columns in the order and with the types of a schema like ``"a int, b string"``."""
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


def sum_vectors(df: DataFrame, keys: list[str], dtype: str, parts: int, fan_in: int = 64) -> DataFrame:
    """Add up vectors kept as bytes in ``vec``, per key, in a tree of at most ``fan_in`` vectors a task.

    ``df`` has the keys, ``part`` (0 to parts - 1) and ``vec``.
    """
    schema = df.select(*keys, "part", "vec").schema

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["vec"].iloc[0], dtype=dtype).copy()
        for blob in pdf["vec"].iloc[1:]:
            total += np.frombuffer(blob, dtype=dtype)
        head = pdf.iloc[:1].copy()
        head["vec"] = [total.tobytes()]
        return head

    while True:
        parts = -(-parts // fan_in)
        df = df.withColumn("part", F.col("part") % parts)
        df = df.groupBy(*keys, "part").applyInPandas(add, schema)
        if parts <= 1:
            return df.drop("part")


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """2^bits flags, packed by eight, set where ``column`` (bigint) modulo 2^bits occurs.

    A filter of fixed size, whatever the input: it may let more through than was
    put in, never less. Slices of 64 KB are made by tasks of their own, after one
    shuffle, and come to the driver compressed, in one job: read part by part, every
    part would be a job the driver keeps book of.
    """
    low = min(19, bits)
    at = F.pmod(column, F.lit(1 << bits))
    places = df.select(F.shiftright(at, low).alias("slice"), at.alias("at")).repartition("slice").distinct()

    def slice_of(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << low, dtype=bool)
        flags[pdf["at"].to_numpy() & ((1 << low) - 1)] = True
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "flags": [zlib.compress(np.packbits(flags).tobytes(), 1)]})

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    step = (1 << low) // 8
    for r in places.groupBy("slice").applyInPandas(slice_of, "slice bigint, flags binary").collect():
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(zlib.decompress(r["flags"]), dtype=np.uint8)
    return out


def flagged(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each unsigned or signed 64-bit value whether its place in a bitmap is set."""
    at = values.astype(np.uint64) & np.uint64(len(flags) * 8 - 1)
    return (flags[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
