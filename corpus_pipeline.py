"""A corpus build over ``documents``: five stages, each a function (spark, docs, sf_dir) -> docs.

Every stage works on the whole table that its predecessor kept and needs nothing but the columns of documents
and the tables of ``sf_dir``. The last stage adds ``copies``, how often the mix takes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import decontaminate, exact_dedup, mixing, near_dedup
from newsloom.llm import toxicity as tox
from newsloom.llm.common import Scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go."""
    return tox.drop_toxic(docs, tox.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays (words as in the exact stage, shingles of five words)."""
    return near_dedup.drop_near_duplicates(docs, words=5)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with their number of copies."""
    return mixing.mixed_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("benchmark decontamination", benchmarks), ("source mix", mix)]

#: Classifier, tensored tables and rounding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written below ``spark.checkpoint.dir`` and read again, so no later stage repeats an earlier one."""
    scratch = Scratch(spark, "pipeline")
    docs, spent = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, before = scratch.cut(stage(spark, docs, sf_dir), "stage"), spent
        spent = docs
        if before is not None:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
