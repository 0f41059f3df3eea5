"""From raw documents to token ids: five stages, each a table in and a table out.

A stage takes (spark, docs, folder of the other tables). It works on every row it is given; all but the last
return the columns of ``docs``. ``run`` writes each stage's rows to the shared folder and reads them again,
so a lost executor costs at most one stage.

Every stage takes what its operator takes: null columns, empty and very long texts, repeated rows, an empty
table and further columns, which are passed on; the operators' docstrings say what comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salmoura.llm import benchmark_scan, bpe, line_dedup, near_dup, quality
from salmoura.llm.common import written
from salmoura.llm.entries import word_vocabulary
from salmoura.llm.registry import table

ORACLE_SQL = None  # a trained classifier and the merges of a vocabulary; tested against brute force


def of_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the rows of ``labels``."""
    return quality.accepted(docs, table(spark, folder, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source."""
    return line_dedup.without_boilerplate(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8)."""
    return near_dup.first_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return benchmark_scan.without_contaminated(docs, table(spark, folder, "benchmark"), unnamed=True)


def token_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Per document: ids, their number, and digests of ids and decoded text."""
    return bpe.encoded(docs, word_vocabulary())


STAGES = [
    ("quality_classifier", of_quality),
    ("line_dedup", without_boilerplate),
    ("minhash_near_dedup", one_of_each),
    ("benchmark_decontamination", clean_of_benchmark),
    ("bpe_encoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
