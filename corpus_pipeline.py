"""The corpus pipeline: quality, exact and near duplicates, the mix of sources, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.

Defined results, in every stage: an empty table gives an empty one; null texts count
as empty; a null doc_id comes last; rows are told apart by doc_id and text, so rows
without a doc_id, or with a repeated one, are decided each for itself; further
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import importance_resampling, packing, source_mixing, stream_dedup, tensor_minhash
from strata.llm.common import Workspace, documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones draws.

    Rows of one doc_id share their noise; what ties with the last one drawn stays;
    without good labels all stay.
    """
    return importance_resampling.keep_resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts: the longest, then the least doc_id; repeated rows stay once.

    Empty texts are equal to each other.
    """
    return stream_dedup.keep_first_of_equal(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar sets of five-word shingles: the least doc_id.

    Texts without a word are linked with nothing and stay.
    """
    return tensor_minhash.keep_one_of_near(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of their sources takes them, up to three times; those without a word are not taken.

    A null source is a source of its own, the last.
    """
    return source_mixing.mixed_documents(docs)


def cost_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token sequences of even attention cost; a document that the mix repeats is packed as often."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", source_mix),
    ("packing", cost_packing),
]

#: Hashed n-gram models, near-duplicate links and byte-pair tokens have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    work = Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = work.write(docs, f"stage{i}")
    return docs
