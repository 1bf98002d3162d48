"""From raw documents to packed training sequences, in five stages.

Every stage works on all rows that the one before kept, and all but the last
return the columns of ``documents``. Between stages the rows are written as
Parquet and read again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, quality_model, secrets
from tidemark.llm.near_dup import NearDuplicates
from tidemark.shared.scratch import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.keep_good(docs, quality_model.train(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8), that of the smallest id; rows without an id take part."""
    return NearDuplicates(Scratch(spark, "stage-near-dup")).representatives(docs, unnamed=True)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return secrets.redact(docs, Scratch(spark, "stage-secrets"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.resample(docs, Scratch(spark, "stage-mix"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents and their places in sequences."""
    return packing.pack(docs, Scratch(spark, "stage-pack"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL can express neither the trained classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from ``documents``."""
    scratch = Scratch(spark, "pipeline")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        rows = scratch.keep(stage(spark, rows, sf_dir), f"stage{number}")
        if number:
            scratch.drop(f"stage{number - 1}")
    return rows
