"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame.

All stages but the last return the columns of `documents`; what a stage returns is written as Parquet and
read again as the next one's input.
"""

from pyspark.sql import DataFrame, SparkSession

from quality_probe.llm import mixing, ngram_join, packing, quality, queries, secrets
from quality_probe.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or lie outside their group's estimate."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the least id, of each class of copies and near copies."""
    return ngram_join.kept_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; no document goes."""
    return secrets.redacted_documents(docs, queries.tokenizer_path())


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents into an order that mixes sources to their target weights."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences, by the mix's order and target weights; a row per piece."""
    placed = mixing.stored_order(docs, "_place")
    return packing.packed(placed, queries.tokenizer_path(), mixing.tempered(docs), order="_place")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", pack),
]

ORACLE_SQL = None  # the estimates, components and tokens are beyond SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
