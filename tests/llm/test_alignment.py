"""Alignment and counts against a token-by-token version with fresh tokenizers; the perfect hash by itself."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from siegeboard.llm import alignment

PATHS = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
ODD = ["a  b\n\n c\r\nd;\r", "▁ marked", "<|endoftext|> x <s>", "日本語 текст 🙂🙂", "x" * 3000, " ", "\t\ttabs ", "\x00 null", "'s don't", "é ﬁ"]


@pytest.fixture(scope="module")
def groups():
    full = Tokenizer.from_file(PATHS[0])
    full.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    own = {i: bytes(letters[c] for c in t) for t, i in full.get_vocab().items() if all(c in letters for c in t)}

    def cut(text):
        if not text:
            return [], 0, 0
        a, b = full.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        left = [own[i] for i in a]
        right = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        if not b"".join(left) == b"".join(right) == (" " + text).encode():
            return [], 0, 0
        out, i, j, x, y, last = [], 0, 0, 0, 0, (0, 0)
        while i < len(a):
            if x <= y:
                x += len(left[i])
                i += 1
            while y < x:
                y += len(right[j])
                j += 1
            if x == y:
                out.append((a[last[0] : i], b[last[1] : j]))
                last = (i, j)
        return out, len(a), len(b)

    return cut


def expected(texts, groups):
    cut = [groups(t) for t in texts]
    pairs = [{(x, y) for a, b in g for x in a for y in b} for g, _, _ in cut]
    count = Counter(p for own in pairs for p in own)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for g, n_a, n_b in cut:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((n_a, n_b, len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), text))
    return out


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_alignment_by_tokens(spark, rows, none, groups):
    texts = [r[1] for r in rows] + ODD
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, a string, n_best int").repartition(3)
    want = expected(texts, groups)
    got = {r.doc_id: tuple(r[c] for c in MEASURES) for r in alignment.align_tokenizers(docs, "doc_id", *PATHS).collect()}
    assert [got[i] for i in range(len(texts))] == want
    # A few pairs a round and segment: the same figures from many rounds.
    few = alignment.align_tokenizers(docs, "doc_id", *PATHS, round_pairs=500, segment_keys=100)
    assert {r.doc_id: tuple(r[c] for c in MEASURES) for r in few.collect()} == got
    assert alignment.align_tokenizers(none, "doc_id", *PATHS).count() == 0


def test_query(spark, tmp_path, docs, rows, groups):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = alignment.op11_token_alignment(spark, str(tmp_path)).collect()
    want = [(r[0], *e[:6], hashlib.sha256(e[6].encode()).hexdigest() if e[6] else "") for r, e in zip(rows, expected([r[1] for r in rows], groups), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_large_groups_are_counted_by_ids(monkeypatch):
    both = alignment.tokens_of(*PATHS)
    texts = [both(t) for t in ("日本語日本語 日本", "plain words here")]
    a = [np.frombuffer(x, both.lengths.kinds[0]) for x, _ in texts]
    b = [np.frombuffer(y, both.lengths.kinds[1]) for _, y in texts]
    block = alignment.aligned(a, b, both.lengths)

    def total():
        out = Counter()
        for d, p, n in zip(*block.links(), strict=True):
            out[d, p] += n
        return out

    plain = total()
    monkeypatch.setattr(alignment, "GROUP_LINKS", 0)
    assert total() == plain and sum(plain.values()) == int((block.size_a * block.size_b).sum())


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 48, n))
    segments = 1 + n // 1000
    own = alignment.segment_of(keys, segments)
    made = [alignment.perfect_levels(keys[own == s]) for s in range(segments)]
    index = alignment.PairIndex(segments, 0, *(list(x) for x in zip(*made, strict=True)))
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert (index.keys[index.slots(keys)] == keys).all()
    strangers = np.setdiff1d(rng.integers(0, 1 << 48, 1000), keys)
    assert (index.slots(strangers) == -1).all()
    if segments > 2:
        part = alignment.PairIndex(segments, 1, *(list(x) for x in zip(*made[1:3], strict=True)))
        inside = (own == 1) | (own == 2)
        assert (part.slots(keys) >= 0).tolist() == inside.tolist()
