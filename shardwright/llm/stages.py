"""Stages of the corpus pipeline: rejected documents go, repeated lines go, near copies go, sources are mixed, the rest is packed.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import scan, scratch_path
from .line_dedup import dedup_lines
from .mixing import mix_documents
from .near_dedup import drop_near_duplicates
from .packing import pack
from .quality_rules import apply_rules, fit_cutoffs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no certified cutoff rejects."""
    return apply_rules(docs, fit_cutoffs(docs, scan(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """First occurrences of lines; documents left without a line go."""
    return dedup_lines(docs, drop_emptied=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in shares of tokens ** 0.7 of as many tokens as there are; small sources repeat."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, bound, batch)."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixing), ("packing", packing)]

# Consistent sampling cannot be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
