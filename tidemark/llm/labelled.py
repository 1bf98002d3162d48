"""A bounded sample of labelled texts, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most.
FIT_ROWS = 10_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, where: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of up to ``rows`` labelled documents, in the order of a hash of their ids.

    Rows without id, label or text are left out. The ids are at most ``rows``,
    so they are broadcast, and the documents are read without a shuffle.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id")
