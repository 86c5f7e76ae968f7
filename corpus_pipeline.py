"""From raw documents to a training mix: five stages, each over all rows that the one before it kept.

1. ``quality_rules``: documents that the line-first rules reject go, and the failed lines of those that stay.
2. ``ngram_jaccard``: one document of each group of near duplicates stays, the one with the smallest doc_id.
3. ``decontaminate``: documents that hold a window of a benchmark item go.
4. ``secrets``: secrets are replaced in place; no document goes.
5. ``mixture``: documents that the source mix doesn't take go; ``taken`` tells how many of a document's words it takes, repeats counted.

All stages but the last return the columns of ``documents``. Empty tables stay empty all the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecount.llm import decontamination, mixing, ngram_join, quality_rules, secret_scan
from tidecount.llm._spark import materialise, read_table, scratch


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.drop_rejected(docs)


def _unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs).select(*docs.columns)


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def _redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


STAGES = [("quality_rules", _quality), ("ngram_jaccard", _unique), ("decontaminate", _clean), ("secrets", _redacted), ("mixture", _mixed)]

# Line rules, components and redaction have no SQL of their own here; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage writes on its way goes when its rows are written
            docs = materialise(stage(spark, docs, sf_dir), outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
