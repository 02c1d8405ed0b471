"""A training corpus from documents, in stages that are each written and read again.

Every stage takes (spark, docs, sf_dir) and gives the rows that the next one
reads; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerloom.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from answerloom.llm.common import remainder, stored, table
from answerloom.session import ship_package


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1)
    done = toxicity.score(docs, toxicity.learn(docs, labels))
    return done.filter(F.col("_toxic_score") < toxicity.THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship_package(spark)
    return exact_dedup.keep_one(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    ship_package(spark)
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    ship_package(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [("toxicity", civil), ("exact_dedup", exact), ("near_dedup", distinct), ("decontamination", decontaminated), ("packing", packed)]

#: SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
