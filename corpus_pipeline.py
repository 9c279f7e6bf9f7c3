"""From raw documents to packed sequences, in five stages; each works on all that the stage before kept.

A stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askwell.llm.common import written
from askwell.llm.decontaminate import decontaminated
from askwell.llm.language import identified
from askwell.llm.line_dedup import deduplicated
from askwell.llm.minhash import one_of_each
from askwell.llm.packing import packed
from askwell.plans.inputs import table
from askwell.plans.registry import query


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language that has half of the text or more."""
    return identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that were seen before; emptied ones go."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, neighbours on the curve together."""
    return packed(docs)


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup),
    ("decontamination", decontamination), ("packing", packing),
]

#: Language mixtures, sketches and token ids are beyond SQL; tests/llm holds the rows against a plain version.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
