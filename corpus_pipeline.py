"""A training corpus from documents: quality, exact and near copies, leaked test items, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbundle.llm.common import durable_table, table
from corpusbundle.llm.decontamination import drop_contaminated
from corpusbundle.llm.exact import drop_exact_duplicates
from corpusbundle.llm.packing import pack
from corpusbundle.llm.quality import in_fold, train, with_scores
from corpusbundle.llm.simhash import drop_near_duplicates

#: Documents with a lower score go.
QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; labels of one fold in five are not learned."""
    labels = table(spark, sf_dir, "labels").filter(~in_fold("doc_id", 5, 0))
    scored = with_scores(docs, train(docs, labels), name="_quality")
    return scored.filter(F.col("_quality") >= QUALITY_THRESHOLD).drop("_quality")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints that differ in three bits or fewer, the document with the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: The classifier and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
