"""The corpus pipeline: documents of low quality go, then toxic ones, then all but one of each group of near-duplicates; what stays is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import lsh_forest, packing, quality, toxicity
from maskwright.llm.common import stored, table
from maskwright.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")), 0.3, 1)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.5, 0)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsh_forest.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]
#: The classifiers are trained, and tokens counted, outside of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on a table of what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
