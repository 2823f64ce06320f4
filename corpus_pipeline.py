"""From raw documents to packed training sequences, stage by stage.

Every stage gets the documents its predecessor kept, as (spark, docs, sf_dir), and
returns a DataFrame; all but the last have the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siegeboard.llm.language import language_stage
from siegeboard.llm.lines import line_stage
from siegeboard.llm.mixing import mixing_stage
from siegeboard.llm.ngram_join import jaccard_stage
from siegeboard.llm.packing import packing_stage
from siegeboard.llm.shared import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", jaccard_stage),
    ("mixture", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier, mixture draws and tokenizer have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
