"""Language-model scores: logistic mixing of hashed-context bit predictors, and word counts that fall back on it.

Words are spelled in bytes, coded bit by bit, each word ended by a blank. Five
predictors count bits by context: the last 1, 2, 3, 4 and 6 bytes of the word.
Their log-odds are added with gated weights: one set of weights is picked by how
often the longest context was seen, one by how often the last four bytes were,
and by whether only one bit ever came there. All is learned online, in one pass
(``Coder``): a bit is predicted from the counters as they stand, then the weights take a gradient
step, and then the counters take the bit in, so a word is met as a new one. An adaptive
map from the mixed log-odds and the gate to the rate at which such bits were set
refines the result. Every part of what is learned from is coded by itself; counters are added
up, weights are averaged by how often their gate was met.

Two such models are learned. One runs through the whole training texts, byte by byte, every
occurrence counted, and its contexts reach across words; every whole text is coded
with it from its first byte to its end. The other learns how new words are spelled: a word of the
vocabulary teaches it once, and its contexts end at the word.

Beside the running model stand the kinds of text (the labels of training texts). In
each kind a word's probability is its discounted share there; the discounts' mass
goes to its spelling, and a little of it to words of all kinds. A spelling is
weighed by how much likelier its 3-grams are in the words of the kind than in all
words. Token by token the running model and a kind are mixed by a share; a whole text
is a mixture over shares and kinds, so it decides itself how far the running model is to be followed.

Words travel with the block of documents they occur in: a block's own
vocabulary comes back with counts and bits, and the block's texts are coded and added up beside it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import is_training, record_batch, stored, sum_vectors, table, tidy

BLOCK_BYTES = 12 << 20
END = b"\n"  # cannot occur in a word
#: Bytes of context, and slots of the five predictors' tables as powers of two.
ORDERS = (1, 2, 3, 4, 6)
SLOTS = (16, 19, 20, 20, 20)
#: Running texts have more contexts than the words of their vocabulary.
TEXT_SLOTS = (16, 19, 20, 21, 22)
#: Kinds of text told apart: the most frequent labels, and one for all others.
KINDS = 8
SLICE = 1 << 14
GATES, BINS, INPUTS = 32, 48, len(SLOTS)
#: Added to both counts of a context; how far a few occurrences are to be believed is for the gated weights to learn.
SMALL = 0.05
RATE = 0.05
#: Share of the discounts' mass that goes to words of all kinds.
ANY_KIND = 0.1
GRAM_BITS = 16
PART_WORDS = 400_000
#: Bytes of training text that one task learns from: every task hands on whole tables.
PART_BYTES = 48 << 20
CHUNK_SYMBOLS = 40_000
#: Symbols that are learned from at once: their bits of one place are predicted before the first of them is counted.
STEP_SYMBOLS = 8_000
#: Symbols of running texts among which equal ones in equal contexts are found, to be learned from or coded together.
LEARN_BYTES, SCORE_BYTES = 1 << 20, 4 << 20
#: Words whose bits by kind are worked out at once, and symbols that are coded at once, so that temporaries stay small.
SLICE_WORDS, SLICE_SYMBOLS = 8_192, 16_384
#: How far the running model may be followed, token by token, against the kinds.
SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Sums of weights travel as whole numbers of this fraction, so that the order of tasks does not matter.
FRACTION = 1e6
#: A gate met less often takes the weights of the next one that was seen less.
RARE = 1_000

_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def starts_of(slots: tuple[int, ...]) -> np.ndarray:
    """Where each predictor's table begins, and their whole size."""
    return np.concatenate([[0], np.cumsum([1 << b for b in slots])])


STARTS = starts_of(SLOTS)


@dataclass(frozen=True)
class MixModel:
    """``counts``: zeros and ones by slot; ``weights``: two gates x GATES x INPUTS; ``refine``: log-odds by gate and bin."""

    counts: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    grams: np.ndarray  # types by kind and 3-gram slot
    slots: tuple[int, ...] = SLOTS

    @cached_property
    def slot_odds(self) -> np.ndarray:
        """Log-odds of every slot; a worker takes them from the counts once."""
        return _odds(*self.counts)

    @cached_property
    def slot_gates(self) -> np.ndarray:
        return _gate(*self.counts).astype(np.int8)


@dataclass(frozen=True)
class WordLevels:
    """``tokens`` and ``types``: by kind, the last entry for all kinds together; ``discount`` taken off each count; ``prior`` of kinds."""

    tokens: np.ndarray
    types: np.ndarray
    discount: float
    prior: np.ndarray

    def bits(self, counts: np.ndarray, spelled: np.ndarray, leaning: np.ndarray) -> np.ndarray:
        """Bits of words (rows) in each kind, from their counts by kind, the bits of their spelling and how it leans to each kind."""
        p = np.exp2(-spelled)[:, None] * leaning
        if not self.tokens[-1]:
            return -np.log2(p)
        whole = counts.sum(axis=1)[:, None] / self.tokens[-1]
        p = ANY_KIND * whole + (1 - ANY_KIND) * p
        own = np.maximum(counts - self.discount, 0) + self.discount * self.types[:-1] * p
        return -np.log2(np.where(self.tokens[:-1] > 0, own / np.maximum(self.tokens[:-1], 1), p) + 1e-300)


def leanings(grams: np.ndarray, words: list[bytes]) -> np.ndarray:
    """How many times likelier each word's 3-grams are in words of a kind (columns) than in words at large."""
    kinds = len(grams)
    some = grams.sum(axis=1) > 0
    if some.sum() < 2:
        return np.ones((len(words), kinds))
    odds = np.log((grams + 0.5) / (grams + 0.5).sum(axis=1, keepdims=True))
    prior = (grams.sum(axis=1) + 1e-9) / (grams.sum() + 1e-9 * kinds)
    out = []
    for part in pieces(words):
        data, starts, context = symbols(part, ORDERS[:2])
        at = gram_slots(data, context)
        z = np.stack([np.add.reduceat(o[at], starts) for o in odds], axis=1) + np.log(prior)
        p = np.exp(z - z.max(axis=1, keepdims=True)) * some
        p /= p.sum(axis=1, keepdims=True)
        out.append(0.95 * p / prior + 0.05)
    return np.concatenate(out) if out else np.ones((0, kinds))


def symbols(words: list[bytes], orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words in a row, each word's start, and the contexts of every symbol (one row for each of ``orders``).

    A whole text, ended by ``END``, is one such word: contexts reach back to its start.
    """
    data, starts, last = last_bytes(words, max(orders))
    return data, starts, contexts(last, orders)


def last_bytes(words: list[bytes], most: int = ORDERS[-1]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and starts as ``symbols`` gives them, and the ``most`` bytes before each symbol, as far as its word goes back."""
    coded = [w if w.endswith(END) else w + b" " for w in words]
    sizes = np.array([len(w) for w in coded])
    data = np.frombuffer(b"".join(coded), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    last = np.zeros(len(data), dtype=np.uint64)
    for back in range(1, most + 1):
        last[back:] |= data[:-back].astype(np.uint64) << np.uint64(8 * (back - 1))
    last &= (np.uint64(1) << (8 * np.minimum(place, most)).astype(np.uint64)) - np.uint64(1)
    return data, starts, last


def contexts(last: np.ndarray, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    return np.stack([last & np.uint64((1 << 8 * k) - 1) for k in orders])


def bit_slots(data: np.ndarray, context: np.ndarray, bit: int, sizes: tuple[int, ...] = SLOTS) -> np.ndarray:
    """Slot of each predictor (rows) for one bit of every symbol; the slots of half a symbol lie side by side."""
    node = (np.uint64(1) << np.uint64(bit)) | (data.astype(np.uint64) >> np.uint64(8 - bit))
    half = bit % 4
    head = (node >> np.uint64(half)) * _MULTIPLY[0]
    inner = (np.uint64(1) << np.uint64(half)) | (node & np.uint64((1 << half) - 1))
    begin = starts_of(sizes)
    out = np.empty(context.shape, dtype=np.int64)
    out[0] = (context[0] << np.uint64(8) | node).astype(np.int64)
    for k in range(1, INPUTS):
        h = (context[k] * _MULTIPLY[k] + head) * _MULTIPLY[(k + 1) % INPUTS]
        out[k] = ((h >> np.uint64(68 - sizes[k])) << np.uint64(4) | inner).astype(np.int64) + begin[k]
    return out


def gram_slots(data: np.ndarray, context: np.ndarray) -> np.ndarray:
    key = (context[1] << np.uint64(8) | data.astype(np.uint64)) * _MULTIPLY[2]
    return (key >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def _gate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """By how often a context was seen, and whether one bit has always come there."""
    seen = np.minimum(np.log2(zeros + ones + 1), GATES // 2 - 1).astype(np.int64)
    return seen + (GATES // 2) * ((zeros == 0) | (ones == 0))


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + SMALL) / (zeros + SMALL))


def predictions(counts: np.ndarray, slots: np.ndarray, less: int, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of each predictor, and both gates; ``less`` own occurrences are taken out."""
    zeros, ones = (side[slots].astype(np.float32) for side in counts)
    if less:
        ones = np.maximum(ones - less * bit, 0)
        zeros = np.maximum(zeros - less * (1 - bit), 0)
    return _predicted(zeros, ones)


def _predicted(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _odds(zeros, ones), _gate(zeros[4], ones[4]), _gate(zeros[3], ones[3])


def _bin(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (np.clip(z, -11.9, 11.9) + 12) * ((BINS - 1) / 24)
    low = at.astype(np.int64)
    return low, at - low


def mixed_logit(weights: np.ndarray, odds: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    pairs = (weights[0][:, None, :] + weights[1][None, :, :]).reshape(-1, INPUTS).T.copy()
    at = g.astype(np.int64) * GATES + h
    z = odds[0] * pairs[0][at]
    for k in range(1, INPUTS):
        z += odds[k] * pairs[k][at]
    return z


def first_weights() -> np.ndarray:
    w = np.zeros((2, GATES, INPUTS))
    for g in range(GATES):
        known = min(1.0, g % (GATES // 2) / 6)
        w[0, g] = [0.0, 0.05, 0.1, 0.15, 0.4 * known]
        w[1, g] = [0.05 * (1 - known), 0.2 * (1 - known), 0.3 * (1 - known), 0.3 * known, 0.0]
    return w


def _equal(data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal symbols in equal contexts: the first place of each, which of them every symbol is, and how often it comes.

    The longest context and the symbol itself tell all of its bits.
    """
    _, first, again, times = np.unique(last << np.uint64(8) | data, return_index=True, return_inverse=True, return_counts=True)
    # In the order of the text, as they are learned from.
    order = np.argsort(first)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return first[order], place[again], times[order]


def symbol_bits(model: MixModel, data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bits of each symbol under the model; equal ones are coded once."""
    first, again, _ = _equal(data, last)
    nats = np.zeros(len(first))
    for lo in range(0, len(first), SLICE_SYMBOLS):
        some = first[lo : lo + SLICE_SYMBOLS]
        own, before = data[some], contexts(last[some])
        for j in range(8):
            bit = (own >> (7 - j)) & 1
            slots = bit_slots(own, before, j, model.slots)
            g, h = model.slot_gates[slots[4]], model.slot_gates[slots[3]]
            z = mixed_logit(model.weights, model.slot_odds[slots], g, h)
            low, part = _bin(z)
            refined = model.refine[g, low] * (1 - part) + model.refine[g, low + 1] * part
            z = (z + refined) / 2
            nats[lo : lo + len(some)] += np.log(1 + np.exp(np.clip(np.where(bit == 1, -z, z), -700, 700)))
    return nats[again] / np.log(2)


def word_bits(model: MixModel, words: list[bytes]) -> np.ndarray:
    """Bits of each word under the model."""
    data, starts, last = last_bytes(words)
    return np.add.reduceat(symbol_bits(model, data, last), starts)


def running(tokens: list[bytes]) -> bytes:
    """A text as it is coded: its words with one blank after each, and the end."""
    return b" ".join(tokens[:-1]) + b" " + END if len(tokens) > 1 else END


def token_bits(model: MixModel, listed: list[list[bytes]]) -> np.ndarray:
    """Bits of every token of some texts (lists of words and the end), one text after the other, each coded whole."""
    data, _, last = last_bytes([running(tokens) for tokens in listed])
    sizes = np.fromiter((len(w) + (w != END) for w in chain.from_iterable(listed)), dtype=np.int64)
    return np.add.reduceat(symbol_bits(model, data, last), np.cumsum(sizes) - sizes)


def pieces(words: list[bytes], limit: int = CHUNK_SYMBOLS) -> Iterator[list[bytes]]:
    """Words in pieces of bounded size."""
    lo = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= limit or i == len(words) - 1:
            yield words[lo : i + 1]
            lo, size = i + 1, 0


def pieces_of[X](texts: Iterable[X], limit: int, size_of: Callable[[X], int] = len) -> Iterator[list[X]]:
    """Texts in a row, in pieces that end once they have ``limit`` bytes; a text is never cut."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += size_of(text)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


class Coder:
    """Counters, gated weights and what was seen at each gate and bin of the mixed log-odds, all learned while words are coded.

    ``used``: by side and gate how many bits were mixed with its weights.
    """

    def __init__(self, slots: tuple[int, ...] = SLOTS) -> None:
        self.slots = slots
        self.flat = np.zeros(2 * starts_of(slots)[-1], dtype="<i4")
        self.counts = self.flat.reshape(-1, 2).T  # both counts of a slot lie side by side
        self.pairs = self.flat.view("<i8")  # and are read as one: zeros in the lower half
        self.weights = first_weights()
        self.heat = np.full_like(self.weights, 1e-2)
        self.used = np.zeros((2, GATES))
        self.seen = np.zeros((2, GATES, BINS))

    def code(self, data: np.ndarray, context: np.ndarray, times: np.ndarray | None = None) -> None:
        """Take in some symbols: each of their bits is predicted, moves the weights, and is counted before the next.

        ``times``: how often each of them comes; once if not given.
        """
        often = np.ones(len(data), dtype=np.int32) if times is None else times.astype(np.int32)
        whole = often.sum()
        count = np.broadcast_to(often, context.shape).ravel()
        for j in range(8):
            bit = ((data >> (7 - j)) & 1).astype(np.int64)
            slots = bit_slots(data, context, j, self.slots)
            both = self.pairs[slots]
            odds, g, h = _predicted((both & 0xFFFFFFFF).astype(np.float32), (both >> 32).astype(np.float32))
            z = mixed_logit(self.weights, odds, g, h).astype(np.float32)
            low, part = _bin(z)
            at = (bit * GATES + g) * BINS + np.where(part < 0.5, low, low + 1)
            self.seen += np.bincount(at, weights=often, minlength=self.seen.size).reshape(self.seen.shape)
            error = (bit - 1 / (1 + np.exp(-z))) * often / whole
            both = g * GATES + h
            step = np.stack([np.bincount(both, weights=error * odds[k], minlength=GATES * GATES) for k in range(INPUTS)], axis=1)
            met = np.bincount(both, weights=often, minlength=GATES * GATES).reshape(GATES, GATES)
            for side in range(2):
                own = step.reshape(GATES, GATES, INPUTS).sum(axis=1 - side)
                self.used[side] += met.sum(axis=1 - side)
                self.heat[side] += own**2
                self.weights[side] += RATE * own / np.sqrt(self.heat[side])
            np.add.at(self.flat, (2 * slots + bit).ravel(), count)


def code_texts(coder: Coder, texts: list[bytes]) -> None:
    """Take in whole texts, every byte of them; equal symbols in equal contexts are taken in together, at the first of their places."""
    data, _, last = last_bytes(texts)
    first, _, times = _equal(data, last)
    for lo in range(0, len(first), SLICE_SYMBOLS):
        at = first[lo : lo + SLICE_SYMBOLS]
        coder.code(data[at], contexts(last[at]), times[lo : lo + SLICE_SYMBOLS])


LEARNED = "side int, at int, part int, vec binary"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a part of the vocabulary teaches: counters (sides 0 and 1), 3-grams by kind (from 2), and sums for the weights (side -1)."""
    coder = Coder()
    grams: list[np.ndarray] = []
    some = False
    for batch in batches:
        kinds = np.stack([batch.column(c).to_numpy() for c in batch.schema.names[1:]]) > 0
        grams += [np.zeros(1 << GRAM_BITS, dtype=np.int64) for _ in range(len(kinds) - len(grams))]
        done = 0
        for words in pieces(batch.column("word").to_pylist(), STEP_SYMBOLS):
            some = True
            data, starts, context = symbols(words)
            at, sizes = gram_slots(data, context), np.diff(np.concatenate([starts, [len(data)]]))
            for own, known in zip(grams, kinds[:, done : done + len(words)], strict=True):
                np.add.at(own, at[np.repeat(known, sizes)], 1)
            done += len(words)
            coder.code(data, context)
    if some:
        yield from _learned(coder, grams)


def _learn_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a part of the training texts teaches, coded whole and in a row, as ``_learn`` gives it; there are no 3-grams."""
    coder = Coder(TEXT_SLOTS)
    texts = (running([*_text_words(text), END]) for batch in batches for text in batch.column("text").to_pylist())
    some = False
    for part in pieces_of(texts, LEARN_BYTES):
        some = True
        code_texts(coder, part)
    if some:
        yield from _learned(coder, [])


def _learned(coder: Coder, grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    sums = np.concatenate([(coder.weights * coder.used[:, :, None] * FRACTION).ravel(), coder.used.ravel(), coder.seen.ravel()])
    yield record_batch(LEARNED, [-1], [0], [part], [np.rint(sums).astype("<i8").tobytes()])
    for side, own in enumerate([*coder.counts, *grams]):
        for lo in range(0, len(own), SLICE):
            piece = own[lo : lo + SLICE]
            if piece.any():
                yield record_batch(LEARNED, [side], [lo], [part], [piece.astype("<i8").tobytes()])


def averaged(sums: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Weights from their sums over all parts by how often each gate was met.

    Counters of all parts together are higher than those of one, so some gates are met only when
    texts are scored: these take over what was learned at the next lower count.
    """
    weights = first_weights()
    for side in range(2):
        for gate in range(GATES):
            if used[side, gate] >= RARE or (used[side, gate] and not gate % (GATES // 2)):
                weights[side, gate] = np.round(sums[side, gate] / used[side, gate], 6)
            elif gate % (GATES // 2) and used[side].any():
                weights[side, gate] = weights[side, gate - 1]
    return weights


def fit(vocabulary: DataFrame) -> MixModel:
    """Learn spelling from ``word`` (binary, without white space; a line feed for the end of a text), every word once.

    The other columns count the word by kind; kinds learn their 3-grams from the words they have.

    The tables have a fixed size, so the model does not grow with the vocabulary.
    """
    size = vocabulary.count()
    parts = max(6, -(-size // PART_WORDS))
    words = stored(
        vocabulary.repartition(parts, F.xxhash64("word")).sortWithinPartitions(F.xxhash64(F.lit(3), "word"))
    )
    return _model(words.mapInArrow(_learn, LEARNED), words.rdd.getNumPartitions(), len(vocabulary.columns) - 1, SLOTS)


def fit_texts(texts: DataFrame) -> MixModel:
    """Learn from whole texts (``text``, UTF-8 or null), every byte of every one of them; texts are read where they lie."""
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    parts = texts.coalesce(max(1, -(-size // PART_BYTES)))
    return _model(parts.mapInArrow(_learn_texts, LEARNED), parts.rdd.getNumPartitions(), 0, TEXT_SLOTS)


def _model(learned: DataFrame, n_parts: int, kinds: int, slots: tuple[int, ...]) -> MixModel:
    """The model of what all parts have learned."""
    counts = np.zeros((2, starts_of(slots)[-1]), dtype=np.float32)
    grams = np.zeros((kinds, 1 << GRAM_BITS))
    n_weights, n_used, n_seen = 2 * GATES * INPUTS, 2 * GATES, 2 * GATES * BINS
    flat = np.zeros(n_weights + n_used + n_seen)
    # Part by part, so that few vectors are in the driver twice; every part is a job of its own, so they are few.
    for r in sum_vectors(learned, ["side", "at"], "<i8", max(1, n_parts)).coalesce(8).toLocalIterator():
        vec = np.frombuffer(r["vec"], dtype="<i8")
        into = flat if r["side"] < 0 else counts[r["side"]] if r["side"] < 2 else grams[r["side"] - 2]
        into[r["at"] : r["at"] + len(vec)] = vec
    sums, used, seen = np.split(flat, [n_weights, n_weights + n_used])
    weights = averaged(sums.reshape(2, GATES, INPUTS) / FRACTION, used.reshape(2, GATES))
    zeros, ones = seen.reshape(2, GATES, BINS)
    # Towards the identity by a few occurrences.
    p = 1 / (1 + np.exp(-(np.arange(BINS) * (24 / (BINS - 1)) - 12)))[None, :]
    return MixModel(counts, weights, np.log((ones + 20 * p) / (zeros + 20 * (1 - p))), grams, slots)


def _text_words(text: bytes | None) -> list[bytes]:
    """ASCII lower case; bytes.split cuts at the same six characters as the tokens' definition."""
    return (text or b"").lower().split()


def _assign_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, size = TaskContext.get().partitionId(), 0
    for batch in batches:
        block = []
        for n in pc.binary_length(batch.column("text")).to_pylist():
            block.append((part << 24) + size // BLOCK_BYTES)
            size += (n or 0) + 16
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64())], names=[*batch.schema.names, "block"])


def _block_words(kinds: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_block: dict[int, tuple[set, dict[int, Counter]]] = {}
            for block, kind, text in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "text")), strict=True):
                met, counts = by_block.setdefault(block, ({END}, {}))
                words = _text_words(text)
                if kind is None:
                    met.update(words)
                else:
                    own = counts.setdefault(kind, Counter())
                    own.update(words)
                    own[END] += 1
            for block, (met, counts) in by_block.items():
                words = list(met.union(*counts.values()))
                place = {w: i for i, w in enumerate(words)}
                columns = np.zeros((kinds, len(words)), dtype=np.int64)
                for k, own in counts.items():
                    at = np.fromiter(map(place.__getitem__, own), dtype=np.int64, count=len(own))
                    columns[k, at] = np.fromiter(own.values(), dtype=np.int64, count=len(own))
                yield record_batch(_words_ddl(kinds), np.full(len(words), block), words, *columns)

    return count


def _words_ddl(kinds: int) -> str:
    return "block bigint, word binary" + "".join(f", c{k} bigint" for k in range(kinds))


OUT = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_texts(docs: DataFrame, id_column: str, label: str | None = None) -> DataFrame:
    """Scores of every row of ``docs`` (id, ``text``, the boolean ``train`` and perhaps a label of the training texts), as ``OUT`` says.

    ``base_score``: unigram log10 probability with one added to each count;
    ``score``: the model's. A null text is empty and has the end alone; a null
    label is one more label; labels of texts to score are not looked at. With
    nothing to learn from, all counts are zero. Rows come once each, repeated ones too.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit("")
    names = [r["x"] for r in docs.where("train").groupBy(own.alias("x")).count().orderBy(F.desc("count"), "x").limit(KINDS - 1).collect()]
    kinds = len(names) + 1
    kind = F.coalesce(*[F.when(own == x, i) for i, x in enumerate(names)], F.lit(kinds - 1)).cast("int")
    rows = docs.select(F.col(id_column).alias("doc"), F.when(F.col("train"), kind).alias("kind"), F.encode("text", "UTF-8").alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())])
    blocks = stored(rows.mapInArrow(_assign_blocks, schema))
    by_word = Window.partitionBy("word")
    c = [f"c{k}" for k in range(kinds)]
    words = stored(
        blocks.select("block", "kind", "text")
        .mapInArrow(_block_words(kinds), _words_ddl(kinds))
        .select("word", "block", *[F.sum(x).over(by_word).alias(x) for x in c], (F.row_number().over(by_word.orderBy("block")) == 1).alias("head"))
    )
    tidy(spark)
    whole = sum((F.col(x) for x in c[1:]), F.col(c[0]))
    known = words.where(F.col("head") & (whole > 0))
    totals = known.agg(
        *[F.coalesce(F.sum(x), F.lit(0)).alias(f"n_{i}") for i, x in enumerate([*c, whole])],
        *[F.count(F.when((F.col(x) if isinstance(x, str) else x) > 0, 1)).alias(f"v_{i}") for i, x in enumerate([*c, whole])],
        *[F.count(F.when(whole == i, 1)).alias(f"once_{i}") for i in (1, 2)],
    ).first()
    n, v = totals[f"n_{kinds}"], totals[f"v_{kinds}"]
    ends = known.where(F.col("word") == F.lit(END)).select(*c).first()
    texts = np.array([float(x) for x in ends] if ends else [0.0] * kinds)
    levels = WordLevels(
        np.array([float(totals[f"n_{i}"]) for i in range(kinds + 1)]),
        np.array([float(totals[f"v_{i}"]) for i in range(kinds + 1)]),
        totals["once_1"] / (totals["once_1"] + 2 * totals["once_2"]) if totals["once_1"] and totals["once_2"] else 0.5,
        (texts + 0.5) / (texts + 0.5).sum(),
    )
    model = fit(known.select("word", *c))
    shared, grams = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(model.grams)
    whole_texts = spark.sparkContext.broadcast(fit_texts(blocks.where(F.col("kind").isNotNull()).select("text")))
    tidy(spark)
    rated_ddl = _words_ddl(kinds) + ", bits double"

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("word")
            if not len(column):
                continue
            # Equal words lie side by side.
            new = np.ones(len(column), dtype=bool)
            new[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            distinct = column.filter(pa.array(new)).to_pylist()
            bits = np.concatenate([word_bits(shared.value, part) for part in pieces(distinct)])[np.cumsum(new) - 1]
            yield record_batch(rated_ddl, *(batch.column(x) for x in ("block", "word", *c)), bits)

    rated = words.select("block", "word", *c).mapInArrow(rate, rated_ddl)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        words = right.column("word").to_pylist()
        place = {w: i for i, w in enumerate(words)}
        counts = np.stack([right.column(x).to_numpy() for x in c], axis=1)
        total = counts.sum(axis=1)
        base = np.log10((total + 1) / (n + v + 1))
        spelled = right.column("bits").to_numpy()
        cuts = [slice(lo, lo + SLICE_WORDS) for lo in range(0, len(words), SLICE_WORDS)]
        bits = np.concatenate([levels.bits(counts[x], spelled[x], leanings(grams.value, words[x])) for x in cuts])
        prior = np.log2(levels.prior) - np.log2(len(SHARES))
        columns = []
        texts = ([*_text_words(text), END] for text in left.column("text").to_pylist())
        for listed in pieces_of(texts, SCORE_BYTES, lambda tokens: sum(map(len, tokens)) + len(tokens)):
            sizes = np.array([len(x) for x in listed])
            at = np.fromiter(map(place.__getitem__, chain.from_iterable(listed)), dtype=np.int64, count=int(sizes.sum()))
            starts = np.cumsum(sizes) - sizes
            own = bits[at]
            kind_bits = np.add.reduceat(own, starts, axis=0)
            # How many times likelier a token is to the running model than to a kind.
            ratio = np.exp2(np.minimum(own - token_bits(whole_texts.value, listed)[:, None], 1000))
            paths = [prior - kind_bits + np.add.reduceat(np.log2(1 - share + share * ratio), starts, axis=0) for share in SHARES]
            score = np.logaddexp2.reduce(np.concatenate(paths, axis=1), axis=1) * np.log10(2)
            known = np.add.reduceat((total[at] > 0).astype(np.int64), starts)
            columns.append([sizes, known, np.full(len(sizes), n), np.add.reduceat(base[at], starts), score])
        held = [kind is None for kind in left.column("kind").to_pylist()]
        out = record_batch(OUT, held, *(np.concatenate(x) for x in zip(*columns, strict=True))) if columns else record_batch(OUT, *[[]] * 6)
        return pa.table([left.column("doc"), *out.columns], names=["doc", *out.schema.names])

    out = T.StructType([T.StructField("doc", docs.schema[id_column].dataType), *T._parse_datatype_string(OUT).fields])
    return blocks.groupBy("block").cogroup(rated.groupBy("block")).applyInArrow(add_up, out)


def op1_context_mixing(spark, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents, learned from those whose crc32 of the id leaves another remainder than 2 by 7."""
    docs = table(spark, sf_dir, "documents")
    train = is_training(F.col("doc_id"), 7, 2).alias("train")
    out = score_texts(docs.select("doc_id", "text", "lang", train), "doc_id", "lang").withColumnRenamed("doc", "doc_id")
    return out.withColumn("total_bits", -F.col("score") / np.log10(2))
