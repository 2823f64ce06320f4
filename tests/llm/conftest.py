"""Small documents with every awkward case: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, size int, shard int, word string"


def prose(seed: int, words: int, letters: str = "etaoin") -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(words)]


def make_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    lines = "\n".join(" ".join(prose(50 + i, 12)) for i in range(6))
    texts = [
        (0, " ".join(base)),
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "\n".join(" ".join(prose(7 + i, 11)) for i in range(400))),
        (7, lines),
        (8, "Intro line here.\n" + lines + "\nan end"),
        (9, "12 34 !!!"),
        (10, "one two three four"),
        (11, "ONE two  three\nfour"),
        (12, "one two three four five"),
        (13, "Ünïcode ✓ text here 🙂 " + " ".join(prose(3, 30, "äöüß"))),
        (13, "Ünïcode ✓ text here 🙂 " + " ".join(prose(3, 30, "äöüß"))),
        (14, "x" * 5000),
        (None, " ".join(prose(9, 40))),
    ]
    out = []
    for i, (doc, text) in enumerate(texts):
        lang = None if i % 5 == 4 else ("de" if text and "Ü" in text else "en")
        source = None if i % 4 == 3 else f"s{i % 3}"
        out.append((doc, text, lang, source, None if text is None else len(text), 0.5, "r", 1, 2, "w"))
    for i in range(20, 60):
        letters = "etaoin" if i % 2 else "äöüßxy"
        text = " ".join(prose(i, 30 + i, letters))
        out.append((i, text, "en" if i % 2 else "de", f"s{i % 3}", len(text), None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
