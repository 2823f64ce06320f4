"""Cost-balanced packing of tokenised documents into sequences of one length.

A document is cut into full sequences and one rest. Rests are dealt to groups
by hash. In a group they are taken by descending cost (linear plus quadratic in
their length, as attention costs) and each goes to the sequence of lowest cost
among those with room for it. The group starts with as many sequences as its
tokens need at least and opens another only if a rest fits nowhere.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .shared import record_batch, stored, table

SEQUENCE = 2048
END_ID = 1
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP_PIECES = 16_384
#: Words whose ids a worker remembers; beyond, it starts anew.
REMEMBERED = 300_000

#: A word with the blank before it, or white space, at places where the tokenizer's own first cut also falls.
_PARTS = re.compile(r" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
#: Characters that some consider white space or that newer Unicode versions may class anew: such texts are encoded whole.
RARE = "[^\t-\r -~¡-ɏ‐-‧€]"


class Encoder:
    """Ids of a byte-level BPE file of ``tokenizers``, with the words seen so far remembered.

    The rank of a merge in such a file is the id it makes, which is checked on
    loading. Ranks then give the same ids through the faster ``tiktoken``. Texts
    with rare characters go whole through ``tokenizers`` itself, and so do texts with
    the string of a special token, which is that token unless ``special_text`` makes it plain text.
    """

    def __init__(self, path: str, special_text: bool = False):
        self.path, self.special_text = path, special_text
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        special = [] if special_text else [re.escape(t["content"]) for t in parts["added_tokens"]]
        self.whole = re.compile("|".join([RARE, *special]))
        model = parts["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if ids != sorted(ids):
            raise ValueError(f"{path}: merges do not follow the order of ids")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token) and not token.startswith("<|")}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: token for token, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    @cached_property
    def full(self) -> Tokenizer:
        full = Tokenizer.from_file(self.path)
        full.encode_special_tokens = self.special_text
        return full

    def token_bytes(self, ids: list[int]) -> list[bytes]:
        """The bytes that ids of plain tokens stand for."""
        return [self.bytes[i] for i in ids]

    def whole_text(self, text: str) -> list[int]:
        """Ids of a text that is not likely to share words with others."""
        if self.whole.search(text):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.whole.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        parts = _PARTS.findall(text)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for p in parts:
                if p not in known:
                    known[p] = np.array(self.quick.encode_ordinary(p), dtype="<u4").tobytes()
            return b"".join(map(known.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def token_pieces(docs: DataFrame, id_column: str, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Cut each text, ended by id 1, into full sequences and a rest; a null text is empty and has the end alone.

    A piece: the id, start, length, crc32 of its ids, and the tokens of its document.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    pieces = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        step = 4 * sequence
        for batch in batches:
            row, start, length, crc, tokens = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py() or "") + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column).take(pa.array(row, pa.int64())), *record_batch(pieces, start, length, crc, tokens).columns],
                names=[id_column, "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(id_column, "text").mapInArrow(cut, f"`{id_column}` {id_type}, {pieces}")


def balance(lengths: np.ndarray, sequence: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each piece, numbered from 0; pieces in the given order where costs are equal."""
    cost = linear * lengths + quadratic * lengths.astype(float) ** 2
    order = np.argsort(-cost, kind="stable")
    count = int(-(-lengths.sum() // sequence))
    place = np.zeros(len(lengths), dtype=np.int64)
    # By room left: the open sequences of that room, cheapest last; and the cheapest cost of each.
    by_room: dict[int, list[tuple[float, int]]] = {sequence: [(0.0, s) for s in reversed(range(count))]}
    cheapest = np.full(sequence + 1, np.inf)
    cheapest[sequence] = 0.0
    for i in order:
        n = int(lengths[i])
        room = n + int(np.argmin(cheapest[n:]))
        if np.isinf(cheapest[room]):
            at = (0.0, count)
            count += 1
            room = sequence
        else:
            line = by_room[room]
            at = line.pop()
            cheapest[room] = line[-1][0] if line else np.inf
        place[i] = at[1]
        left = room - n
        if left:
            line = by_room.setdefault(left, [])
            item = (at[0] + float(cost[i]), at[1])
            j = len(line)
            while j and line[j - 1] < item:
                j -= 1
            line.insert(j, item)
            cheapest[left] = line[-1][0]
    return place


def pack(pieces: DataFrame, id_column: str, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless from 0 in each sequence) to every piece of up to ``sequence`` tokens.

    Groups are dealt by hash of the whole piece and its place in the table, so that equal pieces are spread; sequence ids are the group's number
    times 2^32 plus the place in the group. A group's padding is below one sequence unless a piece fits nowhere.
    """
    total = pieces.count()
    groups = max(1, -(-total // group_pieces))
    rows = pieces.withColumn("_group", F.pmod(F.xxhash64(*pieces.columns, F.monotonically_increasing_id()), F.lit(groups)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", id_column, "start"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        at = balance(lengths, sequence)
        by = np.argsort(at, kind="stable")
        run = np.concatenate([[0], np.cumsum(lengths[by])[:-1]])
        first = np.concatenate([[True], at[by][1:] != at[by][:-1]])
        offset = np.zeros(len(pdf), dtype=np.int64)
        offset[by] = run - run[first][np.cumsum(first) - 1]
        pdf["sequence_id"] = int(pdf["_group"].iloc[0]) * (1 << 32) + at
        pdf["offset"] = offset
        return pdf.drop(columns="_group")

    return rows.groupBy("_group").applyInPandas(place, schema)


def op9_cost_balanced_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    pieces = stored(token_pieces(docs, "doc_id", public_tokenizers.path("byte_bpe_50k.json")))
    return pack(pieces, "doc_id")


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where each piece of each document goes; a document that occurs twice is packed twice."""
    pieces = stored(token_pieces(docs, "doc_id", public_tokenizers.path("byte_bpe_50k.json")))
    return pack(pieces, "doc_id")
