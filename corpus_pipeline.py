"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again.

Toxic documents go, exact copies go, of near copies one stays, sources are mixed to their target weights
(a document stands in the mix as often as it was taken), and the mix is packed into windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwork.llm import common, exact_dedup, mixing, near, packing, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject. Learns from the labels of training rows among ``docs``."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: most code points, then least doc_id."""
    return exact_dedup.drop_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints or by five-word similarity: the least doc_id."""
    return near.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in service order, once for each copy that the mix takes."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed windows."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("near dedup", unlike), ("mixing", mixed), ("packing", packed)]
#: Classifier, fingerprints and tokenizer aren't expressible in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
