"""The corpus pipeline: rules, boilerplate lines, near duplicates, leaked passages, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. The last deals what is left to bins of tokens. All stages take nulls in any
column, repeated rows, texts of any length and further columns of any name, and give an
empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritrove.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from veritrove.plans.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, of hosts that pass. Null, empty and short texts go; repeated rows stay or go together."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; of ties all rows with the smallest doc_id keep a line. What has no words left after that goes."""
    return line_dedup.strip_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id, and all rows that repeat it. Rows without words or doc_id stay."""
    return jaccard_join.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Rows without words stay, and without items all do."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their bins; a document without words is one piece of no tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("leaks", leaks), ("bins", bins)]

#: Leak verification and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
