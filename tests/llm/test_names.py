"""Columns of users with the names that operators work with."""

from pyspark.sql import functions as F

from siegeboard.llm import chunks, language, lines
from siegeboard.llm.shared import shield

WORKING = ["_row", "_gone", "_key", "_doc", "_letters", "_id", "_spans", "_raw", "own0"]


def clashing(docs):
    return docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in WORKING])


def test_shield_gives_names_back(docs):
    hidden, back = shield(clashing(docs))
    assert not [c for c in hidden.columns if c.startswith("_")]
    assert len({c.lower() for c in hidden.columns}) == len(hidden.columns)
    assert hidden.withColumnsRenamed(back).columns == clashing(docs).columns


def test_line_runs_keep_working_names(docs, none):
    wide = clashing(docs)
    got = lines.without_repeated_runs(wide, "doc_id")
    assert got.columns == wide.columns
    plain = lines.without_repeated_runs(docs, "doc_id")
    assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))
    assert got.where(F.col("_row") != F.concat(F.lit("_row"), F.col("doc_id").cast("string"))).count() == 0
    by_key = lines.without_repeated_runs(docs.withColumnRenamed("doc_id", "_id"), "_id")
    assert by_key.count() == plain.count() and "_id" in by_key.columns
    assert lines.without_repeated_runs(clashing(none), "doc_id").count() == 0


def test_chunks_keep_working_names(docs):
    wide = clashing(docs)
    got = chunks.without_repeats(wide, "doc_id")
    assert got.columns == wide.columns and got.count() == docs.count()
    plain = chunks.without_repeats(docs, "doc_id")
    assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))
    assert got.where(F.col("_row") != F.concat(F.lit("_row"), F.col("doc_id").cast("string"))).count() == 0


def test_languages_keep_working_names(docs):
    wide = clashing(docs)
    model = language.fit(docs.select("text", "lang"))
    got = language.identify(wide, model)
    assert set(wide.columns) <= set(got.columns) | set(language.OUT)
    assert got.where(F.col("_letters") != F.concat(F.lit("_letters"), F.col("doc_id").cast("string"))).count() == 0
    told = language.language_stage(docs.sparkSession, wide, "")
    assert told.columns == wide.columns
