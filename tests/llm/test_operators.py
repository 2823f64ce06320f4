"""Operators against brute-force versions on a small table of awkward cases, and on an empty one."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tokenizers import Tokenizer
from siegeboard.llm import chunks, fingerprint, language, lines, lm, mixing, ngram_join, packing, shards, topk
from siegeboard.llm.shared import utf8


def words(text):
    return (text or "").encode().split()


# --- op1 -------------------------------------------------------------------------------------------------------------


def test_lm_base_and_code(docs, rows):
    train = F.coalesce(F.col("doc_id"), F.lit(-1)) % 4 != 0
    got = lm.score_texts(docs.withColumn("train", train), "doc_id", "lang").collect()
    assert len(got) == len(rows)
    tokens = [[w.lower() for w in words(r[1])] + [b"\n"] for r in rows]
    known = Counter(w for r, t in zip(rows, tokens) if (-1 if r[0] is None else r[0]) % 4 for w in t)
    n, v = sum(known.values()), len(known)
    want = sorted(
        (-1 if r[0] is None else r[0], len(t), sum(known[w] > 0 for w in t), n, round(sum(np.log10((known[w] + 1) / (n + v + 1)) for w in t), 6))
        for r, t in zip(rows, tokens)
    )
    assert sorted((-1 if r.doc is None else r.doc, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)


def test_lm_words_are_a_code():
    """Bits of all one-letter words and the end leave room for longer ones: the sum of their probabilities is below one."""
    rng = np.random.default_rng(1)
    counts = np.zeros((2, lm.STARTS[-1]), dtype=np.float32)
    counts[:, : 1 << 16] = rng.integers(0, 50, (2, 1 << 16))
    zeros = np.zeros((lm.GATES, lm.BINS)) + (np.arange(lm.BINS) * (24 / (lm.BINS - 1)) - 12)[None, :]
    model = lm.MixModel(counts, lm.first_weights(), zeros, np.zeros((1, 1 << lm.GRAM_BITS)))
    one = [bytes([b]) for b in range(256) if b not in b" \t\n\r\x0b\x0c"]
    assert 0 < np.exp2(-lm.word_bits(model, [*one, b"\n"])).sum() < 1
    levels = lm.WordLevels(np.array([10.0, 10.0]), np.array([3.0, 3.0]), 0.5, np.array([1.0]))
    seen = np.array([[5], [4], [1]])
    spelled = np.array([3.0, 4.0, 5.0])
    p = np.exp2(-levels.bits(seen, spelled, np.ones((3, 1)))).sum()
    assert p < 1 and p > 0.85  # what is left goes to words not seen


def test_lm_nothing_to_learn_and_empty(docs, none):
    got = lm.score_texts(docs.withColumn("train", F.lit(False)), "doc_id").collect()
    assert {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0}
    assert lm.score_texts(none.withColumn("train", F.lit(True)), "doc_id").count() == 0


def coded(words, limit):
    coder = lm.Coder()
    for some in lm.pieces(words, limit):
        data, _, context = lm.symbols(some)
        coder.code(data, context)
    return coder


def test_lm_counters_learn_while_bits_are_coded():
    """A bit is predicted by what was coded before it, and by nothing else; the counters hold every bit in the end."""
    coder = lm.Coder()
    data, _, context = lm.symbols([b"online"])
    for i in range(len(data)):
        before = coder.weights.copy()
        coder.code(data[i : i + 1], context[:, i : i + 1])
        assert i or np.array_equal(before, coder.weights)  # nothing was known of the first symbol
    assert not np.array_equal(lm.first_weights()[0], coder.weights[0]) or coder.used.sum() == 16 * len(data)
    moved = coder.weights.copy()
    coder.code(data, context)
    assert not np.array_equal(moved, coder.weights)
    some = [w for r in range(3) for w in (b"one", b"two%d" % r, b"three", b"\n")]
    coder = coded(some, 5)
    data, _, context = lm.symbols(some)
    want = np.zeros((2, lm.STARTS[-1]), dtype=np.int64)
    for j in range(8):
        slots = lm.bit_slots(data, context, j)
        for side in range(2):
            np.add.at(want[side], slots[:, (data >> (7 - j)) & 1 == side].ravel(), 1)
    assert np.array_equal(coder.counts, want) and coder.used.sum() == 2 * 8 * len(data) == 2 * coder.seen.sum()


def test_lm_gates_not_met_take_lower_ones():
    used = np.zeros((2, lm.GATES))
    used[:, :3] = [5 * lm.RARE, 2 * lm.RARE, 3]
    sums = np.full((2, lm.GATES, lm.INPUTS), 7.0) * used[:, :, None]
    sums[:, 1] *= 2
    got = lm.averaged(sums, used)
    assert (got[:, 0] == 7).all() and (got[:, 1 : lm.GATES // 2] == 14).all()
    assert np.array_equal(lm.averaged(0 * sums, 0 * used), lm.first_weights())


def test_lm_words_are_spelled_alike_alone_and_together():
    some = [b"banana", b"bandana", b"ban", b"\n", b"an", b"banana"]
    coder = coded(some, 100)
    model = lm.MixModel(coder.counts.astype(np.float32), coder.weights, np.zeros((lm.GATES, lm.BINS)), np.zeros((1, 1 << lm.GRAM_BITS)))
    assert np.allclose(lm.word_bits(model, some), [lm.word_bits(model, [w])[0] for w in some], rtol=1e-12)


def test_lm_codes_whole_texts_across_words(spark):
    """Equal words in another order are another text: contexts reach across words, in what is learned and in what is scored."""
    first, second = [f"ne{i}st" for i in range(40)], [f"qu{7 * i % 40}rk" for i in range(40)]
    taught = " ".join(f"{a} {b}" for a, b in zip(first, second))
    turned = " ".join(f"{b} {a}" for a, b in zip(first, second))
    rows = [(i, taught, True) for i in range(30)] + [(100, taught, False), (101, turned, False), (102, taught.replace(" ", " \n\t").upper(), False)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, train boolean").repartition(2, "doc_id")
    got = {r.doc: r for r in lm.score_texts(docs, "doc_id").collect()}
    assert got[100].base_score == pytest.approx(got[101].base_score) and got[100].score > got[101].score + 1
    assert got[102].score == pytest.approx(got[100].score, rel=1e-9)


def test_lm_running_texts_teach_every_byte():
    """Every occurrence of every byte is counted at its contexts, however the texts are cut into steps."""
    texts = [lm.running([*words(t), lm.END]) for t in ("", "a", "the cat the cat the dog", "the cat " * 40, "Ünïcode ✓")]
    assert texts[0] == lm.END and texts[1] == b"a \n"
    data, _, context = lm.symbols(texts)
    want = np.zeros((2, lm.starts_of(lm.TEXT_SLOTS)[-1]), dtype=np.int64)
    for j in range(8):
        slots = lm.bit_slots(data, context, j, lm.TEXT_SLOTS)
        for side in range(2):
            np.add.at(want[side], slots[:, (data >> (7 - j)) & 1 == side].ravel(), 1)
    for limit in (1, 50, 1 << 20):
        coder = lm.Coder(lm.TEXT_SLOTS)
        for part in lm.pieces_of(texts, limit):
            lm.code_texts(coder, part)
        assert np.array_equal(coder.counts, want) and coder.used.sum() == 16 * len(data)


def test_lm_token_bits_are_the_bits_of_the_whole_text():
    """Tokens of a text add up to the text coded byte after byte, whether equal symbols are coded once or not."""
    listed = [[*words(t), lm.END] for t in ("one two one two three", "", "two one", "one two one two three")]
    coder = lm.Coder(lm.TEXT_SLOTS)
    lm.code_texts(coder, [lm.running(x) for x in listed])
    model = lm.MixModel(coder.counts.astype(np.float32), coder.weights, np.zeros((lm.GATES, lm.BINS)), np.zeros((0, 1)), lm.TEXT_SLOTS)
    bits = np.split(lm.token_bits(model, listed), np.cumsum([len(x) for x in listed])[:-1])
    for tokens, own in zip(listed, bits):
        data, _, last = lm.last_bytes([lm.running(tokens)])
        alone = sum(lm.symbol_bits(model, data[i : i + 1], last[i : i + 1])[0] for i in range(len(data)))
        assert own.sum() == pytest.approx(alone, rel=1e-12)
    assert np.array_equal(bits[0], bits[3]) and bits[0][0] != bits[0][2]  # a word's bits depend on what stands before it


# --- op2 -------------------------------------------------------------------------------------------------------------


def test_shards_are_exact_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("size")).union(spark.createDataFrame([(1, 1), (None, None)], "a bigint, b bigint"))
    a = sorted(map(tuple, shards.shuffle_into_shards(df, ["doc_id", "size"], 16, block_rows=300).collect()), key=str)
    b = sorted(map(tuple, shards.shuffle_into_shards(df.repartition(7), ["doc_id", "size"], 16, block_rows=300).collect()), key=str)
    assert a == b and len(a) == 5002
    by = {}
    for _, _, shard, slot in a:
        by.setdefault(shard, []).append(slot)
    assert len(by) == 16 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    ids = np.array([x[0] for x in a if x[0] is not None and x[2] == 3])
    assert 1800 < ids.mean() < 3200  # no shard is a range of ids
    assert shards.shuffle_into_shards(df.limit(0), ["doc_id", "size"]).count() == 0


def test_matrix_margins():
    m = shards.communication_matrix([10, 0, 7, 30], 5, 1)
    assert m.sum(axis=1).tolist() == [10, 0, 7, 30] and max(m.sum(axis=0)) - min(m.sum(axis=0)) <= 1
    rng = np.random.default_rng(0)
    assert 4.8e8 < shards.hypergeometric(rng, 2_000_000_000, 2_000_000_000, 1_000_000_000) < 5.2e8


# --- op3 -------------------------------------------------------------------------------------------------------------


def test_chunks_cover_texts_and_survive_insertions():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    moved = text[:700] + b"inserted" + text[700:]

    def cut(x):
        ends = chunks.chunk_ends(np.frombuffer(x, dtype=np.uint8), np.array([0, len(x)]))
        return [x[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    a, b = cut(text), cut(moved)
    assert b"".join(a) == text and max(map(len, a)) <= chunks.MAX_CHUNK
    assert len(set(a) & set(b)) >= len(a) - 4


def test_repeated_passages(spark, docs, none):
    got = chunks.repeated_passages(docs, "doc_id").collect()
    pairs = {(r.doc_id, r.first_doc_id) for r in got}
    assert {(1, 0), (2, 0), (8, 7)} <= pairs
    assert not {r.doc_id for r in got} & {0, 3, 4, 5, 7, 9, 10, 11, 12, 13, 20, 21, 40, None}
    left = {r.doc_id: r.text for r in chunks.without_repeats(docs.where("doc_id < 9"), "doc_id").collect()}
    assert left[1] == "" and left[3] is None and "changed" in left[2] and len(left[2]) < 200 and left[8].startswith("Intro line here.")
    assert chunks.without_repeats(docs, "doc_id").columns == docs.columns
    assert chunks.repeated_passages(none, "doc_id").count() == 0


# --- op4 -------------------------------------------------------------------------------------------------------------


def test_language(docs, none, rows):
    model = language.fit(docs.where(F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1))
    assert model.langs == ["de", "en"]
    out = language.identify(docs, model)
    assert set(language.OUT) < set(out.columns) and out.columns.count("score") == 1 and out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(20, 60))
    assert [got[i].lang_pred for i in (3, 4, 5, 9)] == ["und"] * 4 and got[3].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    single = language.fit(docs.withColumn("lang", F.lit("xx")))
    assert {r.lang_pred for r in language.identify(docs, single).collect()} == {"und", "xx"}
    assert language.identify(none, model).count() == 0
    stage = language.language_stage(docs.sparkSession, docs, "")
    assert stage.columns == docs.columns and stage.where("doc_id between 20 and 59").count() == 40 and stage.where("doc_id in (3, 4, 5, 9)").count() == 0


@pytest.mark.parametrize("n", [2, 4, 7, 20])
def test_codewords_differ(n):
    code = language.codebook(n)
    assert len({tuple(x) for x in code}) == n


# --- op5 -------------------------------------------------------------------------------------------------------------


def brute_runs(texts, least):
    split = [None if t is None else t.split("\n") for t in texts]
    gone = [set() for _ in texts]
    for d, own in enumerate(split):
        for i in range(len(own or [])):
            best = 0
            for e in range(d + 1):
                for j in range(len(split[e] or [])):
                    if (e, j) >= (d, i):
                        break
                    k = 0
                    while i + k < len(own) and j + k < len(split[e]) and own[i + k] == split[e][j + k]:
                        k += 1
                    best = max(best, k)
            if best and sum(len(words(x)) for x in own[i : i + best]) >= least:
                gone[d] |= set(range(i, i + best))
    return [sorted(x) for x in gone]


def test_line_runs(spark, docs, none):
    texts = ["a b c\nd e\n\nf", "d e\n\nf\nzz", "q\na b c\nd e\n\nf", "x\nx\nx\nx\nx\nx", "x\nx\nx", None, "", "a b c\nd e\nf", "f\na b c\nd e"]
    small = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for least in (1, 3, 5):
        found = lines.marked(small, "doc_id", least).collect()
        got = {r.doc_id: sorted({i for x in r._gone or [] for i in range(x.line, x.line + x.size)}) for r in found}
        assert [got[i] for i in range(len(texts))] == brute_runs(texts, least)
    out = lines.line_stage(spark, docs, "")
    left = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and left[8].text == "Intro line here.\nan end" and left[8].n_chars == 23 and 1 not in left
    assert left[3].text is None and left[4].text == "" and left[0].text and left[7].text.count("\n") == 5
    assert out.where("doc_id = 13").count() == 2  # rows equal in id and text are one document
    assert lines.line_stage(spark, none, "").count() == 0


# --- op6 -------------------------------------------------------------------------------------------------------------


def test_mixture(docs, none, rows):
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix(sized, ["doc_id", "size"], shards=4).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 + 1e-6 and sum(r["size"] for r in own) == own[0].source_size
    assert all(r.taken == sum(d.words for d in r.draws) and all(0 <= d.shard < 4 for d in r.draws) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(sized.repartition(5), ["doc_id", "size"], shards=4).collect()))
    assert mixing.mix(none.select("doc_id", "source", F.lit(1).cast("bigint").alias("size")), ["doc_id"]).count() == 0
    out = mixing.mixing_stage(docs.sparkSession, docs, "").collect()
    goal = {r.source: r.target for r in got}
    for source, target in goal.items():
        assert abs(sum(len(words(r.text)) for r in out if r.source == source) - target) <= 0.5 + 1e-6
    assert mixing.mixing_stage(docs.sparkSession, none, "").count() == 0


def test_targets_are_capped_and_shared():
    assert mixing.targets([100, 10, 100], [5, 2, 1]) == [pytest.approx(150), pytest.approx(30), pytest.approx(30)]
    t = mixing.targets([10, 1000, 1000], [5.0, 2.0, 1.0])
    assert t[0] == 30 and sum(t) == pytest.approx(2010) and t[1] == pytest.approx(2 * t[2])
    m = mixing.split_tree(np.array([7, 0, 12]), 4, np.random.default_rng(2))
    assert m.sum(axis=0).tolist() == [7, 0, 12] and max(m.sum(axis=1)) - min(m.sum(axis=1)) <= 1


def test_mixture_of_repeated_rows(spark):
    """Five equal rows of ten words beside others: no text is taken more often than its copies allow."""
    rows = [(1, "a b c d e f g h i j", "x")] * 5 + [(2, "k l m n o p q", "y"), (3, None, "y"), (4, "z " * 60, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    out = mixing.mixing_stage(spark, docs, "").collect()
    sizes = [50, 7, 60]
    for source, target in zip("xyz", mixing.targets(sizes, [5.0, 2.0, 1.0]), strict=True):
        assert abs(sum(len(words(r.text)) for r in out if r.source == source) - target) <= 0.5 + 1e-6
    assert sum(r.doc_id == 1 for r in out) <= 15


def test_only_ends_of_quotas_meet_by_key(spark, monkeypatch):
    """With many blocks a text goes straight to its shard; the rows are those of draws joined to texts."""
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 8)
    rows = [(i, " ".join(["w"] * (i % 23)), "xyz"[i % 3] if i % 10 else None, "a b") for i in range(400)] + [(401, "q r s", "x", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, place string").repartition(4)
    out = mixing.mixing_stage(spark, docs, "")
    taken = Counter()
    for r in out.collect():
        taken[r.doc_id] += len(words(r.text))
    parts = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    sized = docs.select("doc_id", "source", F.xxhash64(F.lit(1), *parts).alias("key"), F.xxhash64(F.lit(2), *parts).alias("key2"), mixing.word_count(F.col("text")).alias("size"))
    want = Counter()
    for r in mixing.mix(sized, ["key", "key2"]).collect():
        want[r.doc_id] += r.taken
    assert +taken == +want
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()


def test_slot_tables_are_the_counters():
    """Log-odds and gates looked up by slot are those computed from the counts at every place."""
    rng = np.random.default_rng(4)
    counts = np.zeros((2, lm.STARTS[-1]), dtype=np.float32)
    counts[:, :: 7] = rng.integers(0, 900, counts[:, :: 7].shape)
    model = lm.MixModel(counts, lm.first_weights(), np.zeros((lm.GATES, lm.BINS)), np.zeros((1, 1 << lm.GRAM_BITS)))
    data, _, context = lm.symbols([b"abc", b"d", b"some longer word"])
    assert np.array_equal(lm.symbols([b"abc", b"d", b"some longer word"], lm.ORDERS[:2])[2], context[:2])
    slots = lm.bit_slots(data, context, 3)
    odds, g, h = lm.predictions(counts, slots, 0, (data >> 4) & 1)
    assert np.array_equal(model.slot_odds[slots], odds) and np.array_equal(model.slot_gates[slots[4]], g) and np.array_equal(model.slot_gates[slots[3]], h)


def test_first_words(spark):
    df = spark.createDataFrame([("  a b  c\nd ",), ("a b c",)], "text string")
    assert [r[0] for r in df.select(mixing.first_words(F.col("text"), F.lit(2))).collect()] == ["  a b", "a b"]


# --- op7 -------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, none):
    df = spark.createDataFrame(
        [(1, "One. Two.\nThree."), (2, "Three.\nTwo. One."), (3, "One."), (4, "Two.\nThree."), (5, None), (6, "")], "doc_id bigint, text string"
    )
    got = {r.doc_id: r.lanes for r in fingerprint.fingerprints(df, ["text"]).collect()}
    assert got[1] == got[2] != got[3] and set(got[5]) == {0} and got[5] == got[6]
    pair = spark.createDataFrame([(got[1], got[3], got[4])], "a array<bigint>, b array<bigint>, c array<bigint>")
    total, rest, like, same = pair.select(
        fingerprint.insert(F.col("b"), F.col("c")), fingerprint.delete(F.col("a"), F.col("b")), fingerprint.likeness(F.col("a"), F.col("c")), fingerprint.likeness(F.col("a"), F.col("a"))
    ).first()
    assert total == got[1] and rest == got[4] and 0.5 < like < 1 and same == 1.0


def test_edited_texts(spark, tmp_path, docs, none):
    rows = [(i, t) for i, t in enumerate(["abcdefgh", "", None, "zß🙂yxwvu\nxx", "q"])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op7_multiset_fingerprint(spark, str(tmp_path)).collect()}
    texts = [t or "" for _, t in rows]
    for i, t in enumerate(texts):
        m = len(t) // 4
        edited = t[: len(t) - m] + texts[(i + 1) % len(texts)][:m]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0
    none.select("doc_id", "text").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fingerprint.op7_multiset_fingerprint(spark, f"{tmp_path}/none").count() == 0
    many = spark.range(7000).select((F.col("id") * F.col("id")).alias("k"))
    pairs = fingerprint.neighbours(many, "k", rows_per_bucket=50)
    assert pairs.where("copy = 0").count() == 7000 and pairs.groupBy("home").count().agg(F.max("count")).first()[0] < 400


# --- op8 -------------------------------------------------------------------------------------------------------------


def test_top_k_is_exact(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 24)]) for i in range(900)]
    rows += [(900 + i, rows[5][1]) for i in range(30)]
    rows += [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24), (None, [0.1] * 24), (2050, []), (2051, [9.0])]
    rows += [(150, rows[7][1])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = topk.op8_impact_topk(spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    some = base.execute(topk.ORACLE.replace("list_inner_product(cast(a.vals as double[]), cast(b.vals as double[]))", "coalesce(list_sum([a.vals[i] * b.vals[i] for i in range(1, least(len(a.vals), len(b.vals)) + 1)]), 0)")).fetchall()
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(some)
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, values array<bigint>"), F.lit(True)).count() == 0


def test_index_stops_early_and_keeps_members():
    rng = np.random.default_rng(4)
    base = rng.integers(-20, 20, (3000, 16))
    base[:, 0] += 200 * (rng.random(3000) < 0.02)
    index = topk.ImpactIndex(base)
    queries = base[:10]
    for q, some in zip(queries, index.search(queries, 5), strict=True):
        assert set(np.argsort(-(base @ q), kind="stable")[:5]) <= set(some)


# --- op9 -------------------------------------------------------------------------------------------------------------


def test_packing(docs, none, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.token_pieces(docs, "doc_id", path)
    got = packing.pack(pieces, "doc_id").collect()
    full = Tokenizer.from_file(path)
    ids = {r[0]: np.array(full.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in rows}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(own.tobytes()) == r.ids_crc32 and len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in got) == sum(len(ids[r[0]]) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= packing.SEQUENCE
    assert packing.pack(packing.token_pieces(none, "doc_id", path), "doc_id").count() == 0


def test_encoder_agrees_with_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, fresh = packing.Encoder(path), Tokenizer.from_file(path)
    texts = ["", " ", "  two  blanks ", "line\n\nline\r\n\ttab", "don't we'll I'm", "a1b2 3.14", "naïve ÀÉ ß", "日本 語", "nb sp", "x" * 300, "\x1c odd   end", "<|endoftext|> end", "🙂🙂 emoji"]
    for t in texts:
        want = fresh.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), dtype="<u4").tolist() == want, t


def test_special_strings_and_equal_pieces(spark):
    """A special token's string is that token, as the library's defaults have it; many equal rows are many groups."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, fresh = packing.Encoder(path), Tokenizer.from_file(path)
    for t in ("<|endoftext|> x", "a<|endoftext|>b", "<|endoftext"):
        assert np.frombuffer(encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids
    rows = spark.range(2000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("same text").alias("text"))
    out = packing.pack(packing.token_pieces(rows, "doc_id", path), "doc_id", group_pieces=100).collect()
    assert len(out) == 2000 and len({r.sequence_id >> 32 for r in out}) == 20
    assert len({(r.sequence_id, r.offset) for r in out}) == 2000


def test_balance_fills_sequences():
    rng = np.random.default_rng(6)
    lengths = np.exp(rng.normal(5.5, 1, 6000)).astype(int) % packing.SEQUENCE + 1
    place = packing.balance(lengths)
    load = np.bincount(place, weights=lengths)
    assert load.max() <= packing.SEQUENCE and len(load) <= 1.01 * lengths.sum() / packing.SEQUENCE + 1
    cost = np.bincount(place, weights=lengths + lengths.astype(float) ** 2 / 2048)
    assert cost.std() / cost.mean() < 0.35


def test_bitmap_comes_in_one_job(spark):
    """The slices of a bitmap are not fetched by a job for each part of the last shuffle."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("bitmap", "bitmap")
    try:
        flags = ngram_join.bitmap(spark.range(0, 4000, 7).withColumnRenamed("id", "k"), "k", 22)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in old.items():
            spark.conf.set(k, v)
    assert ngram_join.flagged(flags, np.arange(4000)).tolist() == [x % 7 == 0 for x in range(4000)]
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")) < 12


# --- op10 ------------------------------------------------------------------------------------------------------------


def brute_groups(rows):
    sets = []
    for _, text, *_ in rows:
        w = [x.lower() for x in words(text)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {}
    for c, r in zip(comp, rows):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted(((r[0], len(s), least.get(c)) for c, r, s in zip(comp, rows, sets)), key=str)


def counted_jobs(spark, group: str, made):
    """What ``made`` returns, and how many jobs that took."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = made()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_bitmap_takes_one_shuffle(spark):
    """Equal places are dropped where slices are made, not by a shuffle of their own; repeated and negative keys are fine."""
    keys = spark.createDataFrame([(x,) for x in [5, 5, -3, 1 << 40, 1 << 21, 7, 5]], "k bigint")
    flags, jobs = counted_jobs(spark, "bitmap slices", lambda: ngram_join.bitmap(keys, "k", 22))
    assert np.flatnonzero(np.unpackbits(flags)).tolist() == [0, 5, 7, 1 << 21, (1 << 22) - 3]
    assert 0 < jobs <= 2


@pytest.mark.parametrize("few", [0, 2, 1 << 16])
def test_connected(spark, monkeypatch, few):
    """Rounds, and one task for the links that are left, tell the same components; few links take few jobs."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    links = [(4, 2), (2, 9), (9, 1), (-5, -9), (100, 200), (200, 100), (7, 7), (30, 20), (40, 30), (20, 40), (1, 4)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got, jobs = counted_jobs(spark, f"connected {few}", lambda: ngram_join.connected(df).collect())
    comp = {4: 1, 2: 1, 9: 1, 1: 1, -5: -9, -9: -9, 100: 100, 200: 100, 30: 20, 20: 20, 40: 20}
    assert sorted(map(tuple, got)) == sorted(comp.items())
    assert few < len(links) or jobs <= 6
    assert ngram_join.connected(df.where("a = b")).count() == 0


def test_jaccard_groups(spark, docs, rows, none):
    got = ngram_join.near_duplicate_groups(docs, "doc_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)
    left = ngram_join.jaccard_stage(spark, docs, "")
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(13) == 1 and 1 not in ids and 2 not in ids and 11 not in ids and {0, 3, 4, 5, None} <= set(ids)
    assert ngram_join.near_duplicate_groups(none, "doc_id").count() == 0


def test_jaccard_near_copies(spark):
    """Many variants of one text, small sets of all sizes, and a passage that many texts share."""
    import random

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(own)
    for size in range(5, 25):
        own = [rng.choice(vocabulary) for _ in range(size)]
        texts += [own, own + ["more"], own[1:], own[:3] + ["odd"] + own[4:]]
    texts += [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] + shared for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.near_duplicate_groups(df, "doc_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)


def test_jaccard_sizes_in_bands(spark):
    """Beginnings of one text: chains of sizes exactly a quarter apart, larger gaps, and one list that holds all of them."""
    steps = [40, 50, 62, 80, 100, 131, 163, 203, 204, 300, 375, 376, 471]
    text = [f"v{i}" for i in range(480)]
    rows = [(i, " ".join(text[: n + 4])) for i, n in enumerate(steps * 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.near_duplicate_groups(df, "doc_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)


def test_open_bands(spark):
    members = [(0, 0, 7), (0, 1, 8), (0, 3, 9), (1, 2, 7), (1, 3, 7), (2, 4, 1), (2, 4, 2)]
    live = spark.createDataFrame(members, "list bigint, band int, comp bigint")
    got = {tuple(r) for r in ngram_join.open_bands(live).join(live, ["list", "band"]).select("list", "band").collect()}
    assert got == {(0, 0), (0, 1), (2, 4)}


def test_boundary_follows_cost():
    assert ngram_join.choose_boundary({2: 50, 4: 100, 300: 1000}) == 4
    assert ngram_join.choose_boundary({5: 100, 6: 100, 300: 1000}) == 0
    assert ngram_join.choose_boundary({5: 100, 6: 100, 300: 1000}, scan_cost=9.0) >= 6
    assert ngram_join.choose_boundary({300: 1000}) == 0
    every = [(a, n) for n in range(1, 40) for a in range(-(-4 * n // 5), n + 1)]
    for a, n in every:
        least = next(i for i in range(1, a + 1) if 9 * i >= 4 * (a + n)) if 9 * a >= 4 * (a + n) else None
        assert least is None or least >= ngram_join.needed(a)
