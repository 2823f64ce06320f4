"""Quality rules with an isolation forest over rule statistics.

Every document gets the counts that quality rules look at. Two plain rules fail
a document outright; other statistics are judged together. Trees of random splits are
grown on a bounded sample of labelled documents, whatever their label: a document that few
splits part from the sample is unlike most, and its mean path is short. How short is too
short is calibrated on all labelled rows: the cut that catches most bad ones while it
loses at most ``max_loss`` of the good.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import record_batch, stored, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: A text fails if more than this percentage of its words lie in repeated windows.
MAX_REPEATED = 20

#: The forest sees at most TREES * SAMPLE labelled rows, SAMPLE for each tree.
TREES = 128
SAMPLE = 128
#: At most this share of the labelled good rows that pass the base rules is lost to the forest.
MAX_LOSS = 0.005
SEED = 12
#: Scores lie in 0 to 1 and are calibrated in steps of 1 / STEPS.
STEPS = 10_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Per word, line or character, so that the length of a text does not count.
FEATURES = ("symbols", "duplicate_lines", "word_length", "wordless", "variety")
STATS = ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"{f} double" for f in FEATURES)

_SPACES = " \t\n\v\f\r"
_NO_LETTER = re.compile(rb"(?<![^\x20\x09-\x0D])[^A-Za-z\x80-\xff\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more; words are numbered from 0."""
    n = len(ids)
    if n <= WINDOW:
        return 0
    runs = ids
    for k in range(1, WINDOW):
        runs = runs[: n - k] * (int(ids.max()) + 1) + ids[k:]
        _, runs, times = np.unique(runs, return_inverse=True, return_counts=True)
        if len(times) == len(runs):
            return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    twice = np.flatnonzero(times[runs] > 1)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: str | None) -> tuple:
    """COUNTS, ``base_failed`` and FEATURES of a whole text; a null text has no words."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes are split at ASCII white space
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    twice = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    size = max(1, n)
    features = (
        symbols / size,
        twice / max(1, len(lines)),
        chars / size,
        len(_NO_LETTER.findall(data)) / size,
        float(np.log1p(len(numbers)) / np.log1p(size)),
    )
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED * n
    return (n, chars, symbols, twice, repeats, failed, *features)


def rule_statistics(docs: DataFrame, id_column: str) -> DataFrame:
    """The id and the statistics of every document."""
    names = [c.split()[0] for c in STATS.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column("text")]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *record_batch(STATS, *columns).columns], names=[id_column, *names])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(count, f"`{id_column}` {kind}, {STATS}")


def mean_path(n: np.ndarray) -> np.ndarray:
    """Expected path length to a value among ``n`` in a random search tree."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (tree, node): children of node k are 2k + 1 and 2k + 2; a leaf's ``feature`` is -1 and ``path`` its length."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    levels: int
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path) of rows: near 1 where few splits part a row from the sample."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.levels):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (x[rows, np.maximum(f, 0)] >= cut[at]), at)
            total += path[at]
        return np.exp2(-total / len(self.feature) / (float(mean_path(np.array(self.sample))) or 1.0))


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest over rows ``x``, each tree over ``sample`` of them (all, if fewer)."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    levels = max(1, int(np.ceil(np.log2(max(2, sample)))))
    size = 2 ** (levels + 1) - 1
    feature = np.full((trees, size), -1, dtype=np.int16)
    cut, path = np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, x[rng.choice(len(x), sample, replace=False)])]
        while todo:
            node, level, part = todo.pop()
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
            open_ = np.flatnonzero(high > low)
            if level == levels or len(part) < 2 or not len(open_):
                path[t, node] = level + float(mean_path(np.array(len(part))))
                continue
            f = int(rng.choice(open_))
            at = rng.uniform(low[f], high[f])
            feature[t, node], cut[t, node] = f, at
            right = part[:, f] >= at
            todo += [(2 * node + 1, level + 1, part[~right]), (2 * node + 2, level + 1, part[right])]
    return Forest(feature, cut, path, levels, sample)


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """Add ``score``; the forest is of fixed size, whatever the input."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            yield batch.append_column("score", pa.array(shared.value.score(x), type=pa.float64()))

    return stats.mapInArrow(judge, T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType())]))


def threshold(good: np.ndarray, bad: np.ndarray, max_loss: float = MAX_LOSS) -> int:
    """From counts of labelled rows by score step: the lowest step whose rows and those above may go.

    It is one beyond the last step if no row is labelled bad or good.
    """
    if not good.sum() or not bad.sum():
        return len(good)
    lost = np.cumsum(good[::-1])[::-1] / good.sum()
    allowed = np.flatnonzero(lost <= max_loss)
    return int(allowed[0]) if len(allowed) else len(good)


def isolate(docs: DataFrame, id_column: str, labels: DataFrame, trees: int = TREES, sample: int = SAMPLE, max_loss: float = MAX_LOSS, seed: int = SEED) -> DataFrame:
    """The statistics of every document with ``score`` (0 to 1, null without a forest), ``cut`` and ``kept``.

    ``labels`` has the id and ``quality`` (1 good, 0 bad, else unlabelled); a document labelled
    both ways is bad, and a null id has no label. Documents that fail the base rules are neither learned from nor
    calibrated on. Without labelled rows there is no forest, without good and bad ones no cut, and only the base rules count.
    Rows come once each, repeated ones too, and equal texts get equal verdicts.
    """
    stats = stored(rule_statistics(docs, id_column))
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col(id_column).alias("_id")).agg(F.min("quality").alias("quality"))
    known = stored(stats.where("not base_failed").join(marks, F.col(id_column) == F.col("_id")).select(id_column, "quality", *FEATURES))
    # At most trees * sample rows, the first by hash of the id, reach the driver.
    order = F.xxhash64(F.lit(seed), F.col(id_column))
    seen = known.orderBy(order, *FEATURES).limit(trees * sample).select(*FEATURES).toPandas().to_numpy(dtype=float)
    if not len(seen):
        return stats.select("*", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("cut"), (~F.col("base_failed")).alias("kept"))
    forest = grow(seen, trees, sample, seed)
    step = F.floor(F.col("score") * STEPS).cast("int")
    found = scored(known, forest).groupBy("quality", step.alias("step")).count().collect()  # at most two rows a step
    tally = {q: np.zeros(STEPS + 1, dtype=np.int64) for q in (0, 1)}
    for r in found:
        tally[r["quality"]][r["step"]] += r["count"]
    cut = threshold(tally[1], tally[0], max_loss)
    return scored(stats, forest).select("*", F.lit(cut / STEPS).alias("cut"), (~F.col("base_failed") & (step < cut)).alias("kept"))


def op12_isolation_rules(spark, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document; the forest is calibrated on ``labels``."""
    out = isolate(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "score")
