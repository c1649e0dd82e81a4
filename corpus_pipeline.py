"""The corpus pipeline: five operators of tracewright.llm over the documents.

Quality rules, one document of each near-duplicate group, benchmark
decontamination, surrogates for personal data, and mixing to target weights.
Every stage but the last returns the columns of the documents.

Defined cases, for every stage: an empty table of documents gives an empty one;
repeated rows are treated alike and go on as often as they came, but for near
duplicates, where rows that share a doc_id are one document; other columns go on
as they are, whatever their names (mixing replaces ``domain`` and ``epoch``);
texts of any length are read whole. A null or empty text goes in the first stage,
and passes each of the others: it is no duplicate, holds no test item and no
personal data, and costs no words. A null doc_id is not trusted, no duplicate, and
otherwise as good as any. Ties: the smallest doc_id of a group stays; the others
are stated in their operators.

This file needs tracewright.llm and is deleted with it; __spark_entry__.py guards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontam, mixing, ngram_join, pii, quality
from tracewright.llm.shared import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("source_mixing", source_mixing),
]

#: SQL has neither xxhash64 nor the surrogates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
