"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared.names import unused
from ..shared.prefix import prefix_sums
from ..shared.scratch import Scratch
from .textkit import NOT_SPACE, Text, slices

#: Expected copies are counted in units of 2^-24, so prefix sums are exact whole numbers.
UNIT = 1 << 24
#: No source, and no document, is taken more often than this.
MOST = 3
#: A table of so many sources at most is broadcast; a larger one is joined by shuffling.
BROADCAST_SOURCES = 100_000


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sizes = Text(part.column("text")).runs(NOT_SPACE).counts()
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("source"), pa.array(sizes, pa.int64())], ["row", "doc_id", "source", "size"])


def targets(scratch: Scratch, sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size, ...) with position, weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share the
    sum of all sizes by weight; a target stops at ``MOST`` times its source's
    size, and the excess goes to the others by weight. Each round is one
    aggregation; capped sources stay capped, so the share of a weight only
    rises, and the loop ends when no further source is capped: after as many
    rounds as there are sources at most, and in practice a few.
    """
    ordered = prefix_sums(scratch, sources, [], [F.col("source").asc_nulls_last()], F.lit(1).cast("long"), "ordered", "position")
    ordered = scratch.keep(ordered.withColumn("weight", F.col("position") % 3 + 1), "sources")
    scratch.drop("ordered")
    cap = F.col("source_size") * MOST
    share, capped = 0.0, -1
    while True:
        full = cap <= F.lit(share) * F.col("weight")
        row = ordered.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, cap).otherwise(0)).alias("fixed"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(full.cast("long")).alias("capped"),
        ).first()
        if not row["weights"] or row["capped"] == capped:
            break
        capped, share = row["capped"], (row["total"] - row["fixed"]) / row["weights"]
    return ordered.withColumn("target", F.least(cap.cast("double"), F.lit(share) * F.col("weight")))


def mix(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken): a row for each row of ``docs``.

    Reads (doc_id, source, text); further columns are ignored. Size is words;
    a null text has none. Every document of a source expects target /
    source_size copies. The expected copies are summed over the source in the
    order (size, doc_id), so that a sample of any rate holds short and long
    documents in proportion; one offset, drawn from the source's name, is added
    to the sums; a copy is taken for each whole number that a document crosses.
    Rows that equal each other in id and size are interchangeable, and repeated
    rows are mixed each for itself. The words of a very long text all count. A
    source whose texts are all empty has target 0 and no copies, and an empty
    table gives no rows.
    """
    return _taken(docs.select(F.lit(None).cast("long").alias("row"), "doc_id", "source", "text"), scratch).drop("row")


def _taken(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``mix`` of (row, doc_id, source, text), with each row's number."""
    sized = docs.mapInArrow(_sized, "row long, doc_id long, source string, size long")
    sized = scratch.keep(sized, "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(scratch, sources)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.left(F.md5(F.coalesce("source", F.lit("")).cast("binary")), F.lit(6)), 16, 10).cast("long")  # 24 bits
    sources = sources.select(F.col("source").alias("name"), "position", "source_size", "target", F.round(rate * UNIT).cast("long").alias("expected"), offset.alias("offset"))
    sources = scratch.keep(sources, "rates")
    rates = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    known = sized.join(rates, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    ranked = prefix_sums(scratch, known, ["position"], [F.col("size"), F.col("doc_id"), F.col("row")], F.lit(1).cast("long"), "dealt", "rank")
    scratch.drop("sized", "sources")
    before = F.col("rank") * F.col("expected") + F.col("offset")
    copies = F.shiftright(before + F.col("expected"), 24) - F.shiftright(before, 24)
    return ranked.withColumn("copies", copies.cast("long")).select("row", "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resample(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, repeats as equal rows.

    Rows go by a number of their own, so that rows of one doc_id are taken each
    for itself and null ids don't gather. An empty table gives no rows.
    """
    own, copies = unused(docs, "_row"), unused(docs, "_copies")
    rows = scratch.keep(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    taken = _taken(rows.select(F.col(own).alias("row"), "doc_id", "source", "text"), scratch)
    each = rows.join(taken.where("copies > 0").select(F.col("row").alias(own), F.col("copies").alias(copies)), own)
    return each.withColumn(own, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
