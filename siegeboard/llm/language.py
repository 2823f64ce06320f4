"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword. For each bit of the code a binary classifier
(log-odds of hashed byte 3- and 4-grams, languages of either side weighing the
same) gives a margin for the whole text. Loss-weighted decoding picks the
codeword with the smallest sum of logistic losses, in which a bit counts by how
well its classifier does on the training texts. A small lead over the second
codeword marks a text as ambiguous.

Counts are taken over all training texts, and every text is read to its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import byte_slices, is_training, record_batch, shield, sum_vectors, table

UNKNOWN = "und"
BITS = 15
BUCKETS = 1 << BITS
WIDTH = 2 * BUCKETS + 1  # 3-grams, 4-grams, and one slot for what crosses the end of a text
SLICE = 2048
COUNTS = "lang string, slice int, part int, vec binary"
JUDGED = "bit int, n bigint, far double, wrong double"
OUT = ("lang_pred", "score", "runner_up", "lead", "ambiguous")
#: Loss that the second codeword must have on top, a bit's average loss of log(2) being a coin toss.
MIN_LEAD = 0.1

_FOLD = np.full(256, 0x20, dtype=np.uint32)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalpha():
        _FOLD[_b] = _b | 0x20 if _b < 0x80 else _b


@dataclass(frozen=True)
class CodeModel:
    """``codes``: +1 or -1 by language and bit; ``weights``: log-odds by bit and bucket; ``scale`` and ``trust`` by bit."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray


def codebook(n: int) -> np.ndarray:
    """Codewords of ``n`` languages: all splits for up to six, else random ones, the best of 50 draws by distance."""
    if n <= 1:
        return np.zeros((n, 0))
    if n <= 6:
        splits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, dtype=float).T
    rng = np.random.default_rng(7)
    best, most = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, int(10 * np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) if n <= 200 else (code.shape[1] - code @ code.T) / 2
        least = (apart + np.eye(n) * code.shape[1]).min()
        if least > most:
            best, most = code, least
    return best


def gram_buckets(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-grams and of the 4-grams that start at each byte; the last slot where one would leave its text."""
    b = _FOLD[data]
    n = len(b)
    padded = np.concatenate([b, np.zeros(3, dtype=np.uint32)])
    three = padded[:n] | padded[1 : n + 1] << np.uint32(8) | padded[2 : n + 2] << np.uint32(16)
    four = three | padded[3 : n + 3] << np.uint32(24)
    h3 = (three * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int32)
    h4 = (four * np.uint32(2246822519) >> np.uint32(32 - BITS)).astype(np.int32) + BUCKETS
    for back in (1, 2, 3):
        last = ends[1:] - back
        last = last[last >= ends[:-1]]
        h4[last] = WIDTH - 1
        if back < 3:
            h3[last] = WIDTH - 1
    return h3, h4


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lo, hi, data, ends in byte_slices(batch.column("text")):
            h3, h4 = gram_buckets(data, ends)
            own = langs[lo:hi]
            for lang in sorted(set(own)):
                at = np.repeat(own == lang, np.diff(ends))
                total = totals.setdefault(lang, np.zeros(WIDTH, dtype=np.int64))
                total += np.bincount(h3[at], minlength=WIDTH) + np.bincount(h4[at], minlength=WIDTH)
    part = TaskContext.get().partitionId()
    rows = [(k, i, part, v[i * SLICE : (i + 1) * SLICE].tobytes()) for k, v in totals.items() for i in range(-(-WIDTH // SLICE))]
    if rows:
        yield record_batch(COUNTS, *zip(*rows, strict=True))


def margins(data: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean log-odds of each text (rows) for each bit; 0 for texts of under three bytes."""
    h3, h4 = gram_buckets(data, ends)
    size = np.diff(ends)
    grams = np.maximum(size - 2, 0) + np.maximum(size - 3, 0)
    out = np.zeros((len(size), len(weights)))
    for j, w in enumerate(weights):
        run = np.concatenate([[0.0], np.cumsum(w[h3] + w[h4], dtype=np.float64)])
        out[:, j] = (run[ends[1:]] - run[ends[:-1]]) / np.maximum(grams, 1)
    return out


def fit(docs: DataFrame) -> CodeModel:
    """Learn from the columns ``text`` and ``lang``; rows with a null in either teach nothing.

    Counts of 2^16 buckets a language reach the driver, so its share grows with
    the number of languages, not with the texts.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = known.mapInArrow(_counted, COUNTS)
    counts: dict[str, np.ndarray] = {}
    # Part by part, so that few vectors are in the driver twice; every part is a job of its own, so they are few.
    for r in sum_vectors(counted, ["lang", "slice"], "<i8", known.rdd.getNumPartitions(), 16).coalesce(8).toLocalIterator():
        at = counts.setdefault(r["lang"], np.zeros(WIDTH))
        at[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["vec"], dtype="<i8")
    langs = sorted(counts)
    codes = codebook(len(langs))
    bits = codes.shape[1]
    if not bits:
        return CodeModel(langs, codes, np.zeros((0, WIDTH), np.float32), np.ones(0), np.ones(0))
    share = np.array([counts[k] for k in langs])
    share[:, -1] = 0
    share = (share + 0.5) / (share + 0.5).sum(axis=1, keepdims=True)
    weights = np.zeros((bits, WIDTH), dtype=np.float32)
    for j in range(bits):
        weights[j] = np.log(share[codes[:, j] > 0].mean(axis=0)) - np.log(share[codes[:, j] < 0].mean(axis=0))
    weights[:, -1] = 0
    # How far and how surely each classifier tells its sides apart, over all training texts.
    shared = spark.sparkContext.broadcast((langs, codes, weights))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, code, table_ = shared.value
        place = {k: i for i, k in enumerate(names)}
        n, far, wrong = 0, np.zeros(code.shape[1]), np.zeros(code.shape[1])
        for batch in batches:
            own = np.array([place[k] for k in batch.column("lang").to_pylist()], dtype=int)
            for lo, hi, data, ends in byte_slices(batch.column("text")):
                signed = margins(data, ends, table_) * code[own[lo:hi]]
                n += hi - lo
                far += np.abs(signed).sum(axis=0)
                wrong += (signed <= 0).sum(axis=0)
        yield record_batch(JUDGED, list(range(len(far))), [n] * len(far), far, wrong)

    rows = (
        known.mapInArrow(judged, JUDGED)
        .groupBy("bit")
        .agg(F.sum("n").alias("n"), F.sum(F.col("far").cast("decimal(30,9)")).alias("far"), F.sum("wrong").alias("wrong"))
        .orderBy("bit")
        .collect()
    )
    far = np.array([float(r["far"]) / max(1, r["n"]) for r in rows])
    error = np.array([r["wrong"] / max(1, r["n"]) for r in rows])
    trust = np.maximum(1 - 2 * error, 0.05)
    return CodeModel(langs, codes, weights, 4 / np.maximum(far, 1e-9), trust * bits / trust.sum())


def decode(model: CodeModel, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of every codeword, and probabilities that fall with it."""
    agree = (margin * model.scale)[:, None, :] * model.codes[None, :, :]
    loss = (np.logaddexp(0, -agree) * model.trust).sum(axis=2)
    p = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return loss, p / p.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, model: CodeModel, min_lead: float = MIN_LEAD) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``runner_up``, ``lead`` and ``ambiguous`` from the column ``text``.

    ``und`` with score 0 stands for a null text, one without a letter, and every
    text if nothing was learned. Only one learned language leaves no second:
    its texts have score 1. Columns of these names in ``docs`` are replaced,
    all others stay; ties go to the first language by code point.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs, back = shield(docs)
    kept = [c for c in docs.columns if c not in OUT]
    rows = docs.select(*kept, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN, None], dtype=object)
        for batch in batches:
            first, second, score, lead = [], [], [], []
            letters = np.array(batch.column("_letters").to_pylist(), dtype=bool)
            for lo, hi, data, ends in byte_slices(batch.column("text")):
                n = hi - lo
                if len(m.langs) < 2:
                    one = np.full(n, 0 if m.langs else len(names) - 2)
                    got = one, np.full(n, len(names) - 1), np.full(n, float(bool(m.langs))), np.full(n, 0.0)
                else:
                    loss, p = decode(m, margins(data, ends, m.weights))
                    order = np.argsort(loss, axis=1, kind="stable")
                    at = np.arange(n)
                    got = order[:, 0], order[:, 1], p[at, order[:, 0]], loss[at, order[:, 1]] - loss[at, order[:, 0]]
                some = letters[lo:hi]
                first.append(np.where(some, got[0], len(names) - 2))
                second.append(np.where(some, got[1], len(names) - 1))
                score.append(np.where(some, got[2], 0.0))
                lead.append(np.where(some, got[3], 0.0))
            if not first:
                continue
            first, second, score, lead = (np.concatenate(x) for x in (first, second, score, lead))
            columns = [batch.column(c) for c in kept] + [
                pa.array(names[first], type=pa.string()),
                pa.array(score),
                pa.array(names[second], type=pa.string()),
                pa.array(lead),
                pa.array((lead < min_lead) & (second != len(names) - 1)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *OUT])

    schema = docs.select(*kept).schema
    for name, kind in zip(OUT, ("string", "double", "string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(label, schema).withColumnsRenamed(back)


def op4_language_codes(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    train: Column = is_training(F.col("doc_id"), 3, 1)
    model = fit(docs.where(train).select("text", "lang"))
    out = identify(docs.select("doc_id", (~train).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", *OUT)


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of no known or of an ambiguous language go; what the rest holds stays as it is."""
    model = fit(docs.where(is_training(F.col("doc_id"), 3, 1)).select("text", "lang"))
    told = identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return told.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select("row.*")
