"""Alignment of two tokenizers, with counts of linked id pairs under a minimal perfect hash.

Side A is a byte-level BPE file, side B a piece model. Where a token of A and one of
B end at the same byte, both token runs are cut; between two cuts lies a group, and every
A token of a group is linked with every B token of it.

Token ids are stored once. A first pass over them finds the distinct pairs of ids. Pairs are dealt to
segments by hash, and every segment gets a minimal perfect hash: levels of bits, each set where
exactly one of the keys that are left falls; a key's slot is the number of set bits before its own.
The key kept at a slot tells strangers apart. Each task then counts documents in a dense
vector over the slots, and the vectors are added up in a tree. The second pass aligns
the documents again and looks the counts up.

Pairs are indexed in rounds of at most ``ROUND_PAIRS``, so that what a worker holds is
bounded whatever the number of pairs; more pairs mean more rounds over the ids, not fewer counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngram_join import mixed
from .packing import Encoder
from .shared import record_batch, release, stored, sum_vectors, table

#: Pairs that a worker indexes at once (20 bytes each), keys of a segment, slots of a stored vector.
ROUND_PAIRS = 1 << 22
SEGMENT_KEYS = 1 << 15
CHUNK = 1 << 16
#: Tokens of both sides that are aligned at once; a text is never cut.
BLOCK_TOKENS = 1 << 17
#: Distinct pairs a task holds before it hands them on.
HELD_PAIRS = 1 << 21
#: Links of a group that are written out one by one; larger groups are counted by their distinct ids.
GROUP_LINKS = 1 << 12

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Lengths:
    """The number of bytes of every id of both sides: all that aligning stored ids needs."""

    a: np.ndarray
    b: np.ndarray

    @property
    def kinds(self) -> tuple[type, type]:
        return tuple(np.uint16 if len(x) <= 1 << 16 else np.uint32 for x in (self.a, self.b))

    @property
    def width(self) -> int:
        return max(len(self.a), len(self.b))


@lru_cache(maxsize=1)
def id_texts(width: int) -> list[str]:
    """All ids as text, with each of the four signs that may follow one."""
    return [f"{i}{end}" for end in (",", "|", ";", "") for i in range(width)]


class Tokens:
    """Both tokenizers and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Encoder(path_a, special_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        top = max(self.a.bytes) + 1
        self.lengths = Lengths(np.array([len(self.a.bytes.get(i, b"")) for i in range(top)]), np.array([len(x) for x in self.bytes_b]))

    def __call__(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of both sides of a text; none if it is null or empty or a side does not give its bytes back."""
        if not text:
            return b"", b""
        data = (" " + text).encode()
        a, b = self.a.whole_text(" " + text), self.b.encode(text)
        if b"".join(self.a.token_bytes(a)) != data or b"".join([self.bytes_b[i] for i in b]) != data:
            return b"", b""
        kind_a, kind_b = self.lengths.kinds
        return np.array(a, dtype=kind_a).tobytes(), np.array(b, dtype=kind_b).tobytes()


@lru_cache(maxsize=1)
def tokens_of(path_a: str, path_b: str) -> Tokens:
    """One pair of tokenizers for each worker process."""
    return Tokens(path_a, path_b)


def tokenised(docs: DataFrame, id_column: str, paths: tuple[str, str]) -> DataFrame:
    """``id_column`` and the ids of both sides, ``a`` and ``b``, as bytes."""
    kind = docs.schema[id_column].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokens_of(*paths)
        for batch in batches:
            rows = [both(t.as_py()) for t in batch.column("text")]
            columns = zip(*rows, strict=True) if rows else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *record_batch("a binary, b binary", *columns).columns], names=[id_column, "a", "b"])

    return docs.select(id_column, "text").mapInArrow(encode, f"`{id_column}` {kind}, a binary, b binary")


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


@dataclass
class Block:
    """Aligned texts: ids of both sides, the text each A token is in, and for each token its group and for each group its sizes."""

    a: np.ndarray
    b: np.ndarray
    doc: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray
    docs: int

    @property
    def group_doc(self) -> np.ndarray:
        return self.doc[starts(self.size_a)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text, the pair and the number of links, for each link or for all equal ones of a large group."""
        large = self.size_a * self.size_b > GROUP_LINKS
        own = np.flatnonzero(~large[self.group_a])
        group = self.group_a[own]
        often = self.size_b[group]
        place = np.arange(int(often.sum())) - np.repeat(starts(often), often)
        other = np.repeat(starts(self.size_b)[group], often) + place
        docs = [np.repeat(self.doc[own], often)]
        pairs = [np.repeat(self.a[own], often) << 32 | self.b[other]]
        times = [np.ones(len(place), dtype=np.int64)]
        for g in np.flatnonzero(large):
            x, m = np.unique(self.a[self.group_a == g], return_counts=True)
            y, n = np.unique(self.b[self.group_b == g], return_counts=True)
            pairs.append((x[:, None] << 32 | y).ravel())
            times.append((m[:, None] * n).ravel())
            docs.append(np.full(len(times[-1]), self.group_doc[g]))
        return np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)

    def texts(self, width: int) -> list[str]:
        """``a1,a2|b1;a3|b2`` of every text."""
        end_a = np.append(self.group_a[1:] != self.group_a[:-1], True) if len(self.a) else np.zeros(0, bool)
        end_b = np.append(self.group_b[1:] != self.group_b[:-1], True) if len(self.b) else np.zeros(0, bool)
        last = np.zeros(len(self.size_a), dtype=bool)
        if len(last):
            last[np.flatnonzero(np.append(self.group_doc[1:] != self.group_doc[:-1], True))] = True
        codes = np.zeros(len(self.a) + len(self.b), dtype=np.int64)
        codes[np.arange(len(self.a)) + starts(self.size_b)[self.group_a]] = self.a + width * np.where(end_a, 1, 0)
        after = np.cumsum(self.size_a)[self.group_b]
        codes[np.arange(len(self.b)) + after] = self.b + width * np.where(end_b, np.where(last[self.group_b], 3, 2), 0)
        sizes = np.bincount(self.group_doc, weights=self.size_a + self.size_b, minlength=self.docs).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        parts = list(map(id_texts(width).__getitem__, codes.tolist()))
        return ["".join(parts[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]


def aligned(a: list[np.ndarray], b: list[np.ndarray], lengths: Lengths) -> Block:
    """Align texts by the ids of both sides; texts without ids take no part."""
    doc = np.repeat(np.arange(len(a)), [len(x) for x in a])
    ids_a, ids_b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b))
    ends_a, ends_b = np.cumsum(lengths.a[ids_a]), np.cumsum(lengths.b[ids_b])
    at_a, at_b = (np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, dtype=bool) for _ in range(2))
    at_a[ends_a], at_b[ends_b] = True, True
    cut_a, cut_b = at_b[ends_a], at_a[ends_b]
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    groups = int(cut_a.sum())
    return Block(ids_a, ids_b, doc, group_a, group_b, np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups), len(a))


def blocks(batches: Iterator[pa.RecordBatch], lengths: Lengths) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of rows of ``tokenised`` with their alignment."""
    kind_a, kind_b = lengths.kinds
    for batch in batches:
        a = [np.frombuffer(x.as_py(), kind_a) for x in batch.column("a")]
        b = [np.frombuffer(x.as_py(), kind_b) for x in batch.column("b")]
        lo, held = 0, 0
        for hi in range(1, batch.num_rows + 1):
            held += len(a[hi - 1]) + len(b[hi - 1])
            if held > BLOCK_TOKENS or hi == batch.num_rows:
                yield batch.slice(lo, hi - lo), aligned(a[lo:hi], b[lo:hi], lengths)
                lo, held = hi, 0


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segments by the upper bits of a key's hash."""
    return (((mixed(keys.astype(np.uint64)) >> np.uint64(33)) * np.uint64(segments)) >> np.uint64(31)).astype(np.int64)


def level_places(keys: np.ndarray, level: int, sizes: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.uint64) + np.array([level + 1], dtype=np.uint64) * _STEP) % sizes.astype(np.uint64)).astype(np.int64)


def perfect_levels(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of levels, their bits, and the distinct keys in slot order."""
    sizes, bits, slots = [], [], []
    left = keys
    while len(left):
        if len(sizes) > 200:
            raise ValueError("keys are not distinct")
        size = -(-len(left) // 64) * 64
        at = level_places(left, len(sizes), np.array([size]))
        alone = np.bincount(at, minlength=size)[at] == 1
        flags = np.zeros(size, dtype=bool)
        flags[at[alone]] = True
        slots.append(left[alone][np.argsort(at[alone])])
        sizes.append(size)
        bits.append(flags)
        left = left[~alone]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), np.concatenate(slots) if slots else keys


class PairIndex:
    """Minimal perfect hash of the pairs in segments ``low`` to ``low + len(sizes)``, with the keys at their slots."""

    def __init__(self, segments: int, low: int, sizes: list[list[int]], bits: list[np.ndarray], keys: list[np.ndarray]):
        self.segments, self.low = segments, low
        levels = max([len(s) for s in sizes], default=0)
        self.sizes = np.zeros((levels, len(sizes)), dtype=np.int64)
        self.starts = np.zeros((levels, len(sizes)), dtype=np.int64)
        at = 0
        for j, own in enumerate(sizes):
            for k, size in enumerate(own):
                self.sizes[k, j], self.starts[k, j] = size, at
                at += size
        self.words = np.frombuffer(np.packbits(np.concatenate(bits), bitorder="little").tobytes(), dtype="<u8") if bits else np.zeros(0, "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not among the pairs."""
        out = np.full(len(keys), -1, dtype=np.int64)
        own = segment_of(keys, self.segments) - self.low
        todo = np.flatnonzero((own >= 0) & (own < self.sizes.shape[1]))
        for level in range(len(self.sizes)):
            todo = todo[self.sizes[level, own[todo]] > 0]
            if not len(todo):
                break
            at = self.starts[level, own[todo]] + level_places(keys[todo], level, self.sizes[level, own[todo]])
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.before[at >> 6] + below)[hit]
            todo = todo[~hit]
        found = out >= 0
        out[found] = np.where(self.keys[out[found]] == keys[found], out[found], -1)
        return out


def distinct_pairs(tokens: DataFrame, lengths: Lengths) -> DataFrame:
    """All linked pairs (``key``: id of A times 2^32 plus id of B), once each."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=np.int64)
        for _, block in blocks(batches, lengths):
            held = np.union1d(held, block.links()[1])
            if len(held) > HELD_PAIRS:
                yield record_batch("key bigint", held)
                held = held[:0]
        yield record_batch("key bigint", held)

    return tokens.select("a", "b").mapInArrow(find, "key bigint").distinct()


def pair_segments(pairs: DataFrame, segments: int) -> DataFrame:
    """A minimal perfect hash for each segment: ``segment``, ``sizes``, ``bits`` and ``keys`` in slot order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            yield record_batch("segment bigint, key bigint", segment_of(keys, segments), keys)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, bits, keys = perfect_levels(np.sort(pdf["key"].to_numpy()))
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "sizes": [sizes], "bits": [packed], "keys": [keys.astype("<i8").tobytes()]})

    return pairs.mapInArrow(deal, "segment bigint, key bigint").groupBy("segment").applyInPandas(build, "segment bigint, sizes array<bigint>, bits binary, keys binary")


def load_index(made: DataFrame, segments: int, low: int, high: int) -> PairIndex:
    """The index of segments ``low`` to ``high``: no more than ROUND_PAIRS keys come to the driver."""
    empty: tuple[list[int], np.ndarray, np.ndarray] = ([], np.zeros(0, bool), np.zeros(0, np.int64))
    own = {
        r["segment"]: (list(r["sizes"]), np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little").astype(bool), np.frombuffer(r["keys"], "<i8"))
        for r in made.where((F.col("segment") >= low) & (F.col("segment") < high)).toLocalIterator()
    }
    rows = [own.get(s, empty) for s in range(low, high)]
    return PairIndex(segments, low, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def count_documents(tokens: DataFrame, index: PairIndex, lengths: Lengths) -> np.ndarray:
    """For each slot of an index in how many documents its pair is linked."""
    shared = tokens.sparkSession.sparkContext.broadcast(index)
    schema = "chunk bigint, part bigint, vec binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own), dtype="<i8")
        for _, block in blocks(batches, lengths):
            docs, pairs, _ = block.links()
            slots = own.slots(pairs)
            here = slots >= 0
            once = np.unique(docs[here] * len(own) + slots[here])
            total += np.bincount(once % max(1, len(own)), minlength=len(own))
        part = TaskContext.get().partitionId()
        for chunk in range(-(-len(total) // CHUNK)):
            vec = total[chunk * CHUNK : (chunk + 1) * CHUNK]
            if vec.any():
                yield record_batch(schema, [chunk], [part], [vec.tobytes()])

    own = tokens.select("a", "b")
    sums = sum_vectors(own.mapInArrow(count, schema), ["chunk"], "<i8", max(1, own.rdd.getNumPartitions()))
    out = np.zeros(len(index), dtype=np.int64)
    for r in sums.toLocalIterator():
        vec = np.frombuffer(r["vec"], "<i8")
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(vec)] = vec
    return out


MEASURES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def look_up(tokens: DataFrame, id_column: str, index: PairIndex, counts: np.ndarray, best: np.ndarray, lengths: Lengths, last: bool) -> DataFrame:
    """Align again and add what the pairs of an index give to the columns ``n_best`` and ``count_sum``; the ``last`` round turns ids into MEASURES."""
    shared = tokens.sparkSession.sparkContext.broadcast((index, counts, best))
    names = [c.split()[0] for c in MEASURES.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, top = shared.value
        for rows, block in blocks(batches, lengths):
            docs, pairs, times = block.links()
            slots = own.slots(pairs)
            here = slots >= 0
            docs, times, found = docs[here], times[here], number[slots[here]]
            n_best, count_sum = (rows.column(c).to_numpy().copy() for c in ("n_best", "count_sum"))
            np.add.at(n_best, docs, np.where(found == top[pairs[here] >> 32], times, 0))
            np.add.at(count_sum, docs, found * times)
            if not last:
                sums = record_batch("n_best bigint, count_sum bigint", n_best, count_sum).columns
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in (id_column, "a", "b")), *sums], names=[id_column, "a", "b", "n_best", "count_sum"])
                continue
            of, links = block.group_doc, block.size_a * block.size_b
            sums = [np.bincount(of, weights=w, minlength=block.docs).astype(np.int64) for w in (block.size_a, block.size_b, np.ones(len(of)), links)]
            columns = record_batch(MEASURES, *sums, n_best, count_sum, block.texts(lengths.width)).columns
            yield pa.RecordBatch.from_arrays([rows.column(id_column), *columns], names=[id_column, *names])

    fields = T._parse_datatype_string(MEASURES if last else "a binary, b binary, n_best bigint, count_sum bigint").fields
    return tokens.mapInArrow(add, T.StructType([tokens.schema[id_column], *fields]))


def align_tokenizers(docs: DataFrame, id_column: str, path_a: str, path_b: str, round_pairs: int = ROUND_PAIRS, segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """Rows of ``id_column`` with the MEASURES of their whole texts, one row for each row of ``docs``.

    A pair's count is the number of rows that hold it linked, so repeated rows count again. Texts that are
    null, empty or not given back by both tokenizers have no tokens: zeros, and no groups. ``groups`` lists the ids
    of A and B in each group: ``a1,a2|b1;a3|b2,b3``. Ties for an id's highest count are all best. Other columns are left out.
    """
    paths = (path_a, path_b)
    tokens = stored(tokenised(docs, id_column, paths))
    lengths = tokens_of(*paths).lengths
    pairs = stored(distinct_pairs(tokens, lengths))
    total = pairs.count()
    segments = max(1, -(-total // segment_keys))
    made = stored(pair_segments(pairs, segments))
    rounds = max(1, -(-total // round_pairs))
    edges = [segments * r // rounds for r in range(rounds + 1)]
    best = np.zeros(1, dtype=np.int64)  # by id of A, so never longer than its vocabulary
    kept: list[DataFrame] = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        index = load_index(made, segments, low, high)
        counts = count_documents(tokens, index, lengths)
        ids = index.keys >> 32
        if len(ids):
            best = np.concatenate([best, np.zeros(max(0, int(ids.max()) + 1 - len(best)), dtype=np.int64)])
            np.maximum.at(best, ids, counts)
        kept.append(_put(docs, counts))
    zero = F.lit(0).cast("bigint")
    out = tokens.withColumn("n_best", zero).withColumn("count_sum", zero)
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if i:
            out = stored(out)
        out = look_up(out, id_column, load_index(made, segments, low, high), _get(kept[i]), best, lengths, i == rounds - 1)
    release(pairs, made, *kept)
    return out


def _put(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Keep a round's counts in the shared folder until their lookup."""
    rows = [(i, counts[i : i + CHUNK].tobytes()) for i in range(0, len(counts), CHUNK)]
    return stored(docs.sparkSession.createDataFrame([(i, bytearray(b)) for i, b in rows], "at bigint, vec binary"))


def _get(kept: DataFrame) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["vec"], "<i8") for r in kept.orderBy("at").toLocalIterator())])


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level and of a piece vocabulary align in every document."""
    out = align_tokenizers(
        table(spark, sf_dir, "documents"), "doc_id", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
