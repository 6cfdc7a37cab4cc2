"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.

Every stage works on rows, not on ids: a null or repeated doc_id, ties and repeated rows change
nothing but which of several copies is kept (the one that stands first), and columns of any name
pass through. Null and empty texts are rejected by the first stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, near_copies, ngram_lm, packing, quality_rules
from lodestone.llm.common import materialize, read_table, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text passes their language's threshold."""
    return ngram_lm.accepted(docs, read_table(spark, sf_dir, "labels"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the boosted trees."""
    return quality_rules.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word Jaccard of 0.8): that with the smallest doc_id."""
    return near_copies.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order.

    Written as Parquet, the order is that of the part files' numbers and of the rows in them.
    """
    return mixing.mixed_documents(docs)


def vector_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, numbered in training order."""
    return packing.pack_documents(docs, ordered=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", vector_packing),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; returns the last stage's rows.

    All stages but the last run before this returns; what they write on the way is deleted.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark, keep=(name,)):
            docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
