"""Corpus pipeline: quality classifier, quality rules, near-duplicates, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes each as Parquet to the shared folder and reads
it again as the next stage's docs. All but the last return the columns of documents, and any further ones whatever their
names: a stage keeps what it works with apart from them.

Defined results of the stages: a null or empty text counts as empty (the classifier judges it by a weight of 0, the rules
drop it as too short); texts of any length are taken whole; repeated rows are judged alike, near_dedup keeps one row of a
doc_id and the row of the smallest doc_id of a group of duplicates, rows without a doc_id are never duplicates; ties of
sampling keys stay together; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import op2_secrets, op4_packing, op5_lines, op6_minhash, op7_quality
from sievework.llm.common import packed, settled, table, unpacked, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps."""
    ratio, cut = op7_quality.fit(docs, table(spark, sf_dir, "labels"))
    keyed = op7_quality.keyed(packed(docs, "doc_id", "text"), ratio)
    return unpacked(keyed if cut is None else keyed.where(F.col("sample_key") >= F.lit(cut)), docs, "doc_id", "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and aren't depleted by lines frequent on their host, without these lines."""
    settled(spark)
    return op5_lines.cleaned_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    settled(spark)
    return op6_minhash.kept_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    settled(spark)
    return op2_secrets.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token windows."""
    settled(spark)
    return op4_packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: The stages train models and read a tokenizer's file; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
