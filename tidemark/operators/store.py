"""Keeping, listing, counting, importing and cleaning up memories.

Times compare to ``now``, a parameter, so that every query can be repeated.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import single

#: Kinds of memories that cleaning up never deletes.
LASTING = ("decision", "feedback")


def upsert_latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: one aggregation with partial results before the shuffle."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(key).agg(last.alias("_last")).select("_last.*")


def recent(memories: DataFrame, n: int) -> DataFrame:
    return memories.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def stats(memories: DataFrame) -> DataFrame:
    """Rows by type, with the total beside each (a sum over the few types)."""
    by_type = memories.groupBy("memory_type").agg(F.count(F.lit(1)).alias("n_memories"), F.count("embedding").alias("n_embedded") if "embedding" in memories.columns else F.lit(0).cast("long").alias("n_embedded"))
    total = by_type.agg(F.sum("n_memories").alias("n_total"))
    return by_type.join(F.broadcast(total))  # one row


def daily_counts(memories: DataFrame, now: datetime, days: int) -> DataFrame:
    """Rows by date since the day ``days`` before now, that whole day included; days without rows are left out."""
    first = F.date_sub(F.lit(now.date()), days)
    return memories.where(F.col("timestamp") >= first.cast("timestamp_ntz")).groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n_memories"))


def daily_bars(counts: DataFrame, width: int = 20) -> DataFrame:
    """Daily counts with a bar in proportion to the largest; there is one row for each day."""
    most = counts.agg(F.max("n_memories").alias("_most"))
    bar = F.repeat(F.lit("#"), F.floor(F.col("n_memories") / F.col("_most") * width).cast("int"))
    return counts.join(F.broadcast(most)).withColumn("bar", bar).drop("_most")


def recent_of_type(memories: DataFrame, memory_type: str, n: int = 20) -> DataFrame:
    """Those of a type among the newest n: the limit comes first."""
    return recent(memories, n).where(F.col("memory_type") == memory_type)


def last_activity(memories: DataFrame, now: datetime) -> DataFrame:
    """One row: the newest timestamp, whole minutes since then as hours, and whether that is silence (2 hours)."""
    last = memories.agg(F.max("timestamp").alias("last_activity"))
    silent = F.timestamp_diff("MINUTE", F.col("last_activity"), F.lit(now).cast("timestamp_ntz")) / 60
    return last.withColumn("silent_hours", silent).withColumn("alert", F.col("silent_hours") >= 2)


def _stale(now: datetime, days: int, importance: float):
    old = F.col("timestamp") < F.timestamp_add("DAY", F.lit(-days), F.lit(now).cast("timestamp_ntz"))
    return ~F.col("memory_type").isin(*LASTING) & (F.col("importance") < single(importance)) & old


def cleanup(memories: DataFrame, now: datetime, days: int = 30, importance: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(survivors, deleted): old memories of little importance go, but no decisions or feedback.

    Vectors and the text index are derived from the survivors, so nothing of
    the deleted stays behind in them.
    """
    stale = F.coalesce(_stale(now, days, importance), F.lit(False))
    return memories.where(~stale), memories.where(stale)


def import_new(incoming: DataFrame, existing: DataFrame, key: str = "id", place: str = "place") -> DataFrame:
    """Rows to add: of each key the one that comes first in the file, by its ``place``, where the key isn't stored yet."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), place).alias("_first")).select("_first.*")
    return first.join(existing.select(key), key, "left_anti").drop(place)


def import_result(incoming: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """One row (imported, skipped): keys that are added, and all other rows, stored ones and repeats within the file."""
    rows = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(existing.select(key).distinct().withColumn("_stored", F.lit(True)), key, "left")
    fresh = F.col("_stored").isNull()
    imported = F.count(F.when(fresh, 1))
    return rows.agg(imported.alias("imported"), (F.coalesce(F.sum("n"), F.lit(0)) - imported).alias("skipped"))


def with_defaults(incoming: DataFrame) -> DataFrame:
    """Incoming rows with the defaults of an import for what is missing."""
    defaults = {"id": F.lit(""), "memory_type": F.lit("note"), "tags": F.array().cast("array<string>"), "source": F.lit("manual"), "importance": single(0.5), "metadata": F.lit("{}")}
    return incoming.withColumns({c: F.coalesce(F.col(c), d) if c in incoming.columns else d for c, d in defaults.items()})


#: The fields of an exported row, in their order.
EXPORTED = ("id", "timestamp", "title", "content", "memory_type", "tags", "source", "importance", "metadata")


def instant(timestamp: Column) -> Column:
    """A time as text, in UTC with its offset; microseconds where there are any."""
    rest = F.date_format(timestamp, ".SSSSSS")
    return F.concat(F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest == ".000000", "").otherwise(rest), F.lit("+00:00"))


def export(memories: DataFrame) -> DataFrame:
    """(id, json): all fields of each row, oldest first; tags, source and metadata are JSON texts within it."""
    quoted = F.concat(F.lit('"'), F.col("source"), F.lit('"'))
    shaped = {"timestamp": instant(F.col("timestamp")), "tags": F.to_json("tags"), "source": quoted, "importance": F.col("importance").cast("double")}
    fields = F.struct(*(shaped.get(c, F.col(c)).alias(c) for c in EXPORTED))
    return memories.orderBy("timestamp", "id").select("id", F.to_json(fields).alias("json"))


def imported(lines: DataFrame) -> DataFrame:
    """Rows of exported JSON, one text each: the fields of ``EXPORTED`` with tags as an array, source unquoted and the defaults of an import, and the ``place`` of the lines.

    A time that can't be read is null, so that one such line doesn't stop the import.
    """
    schema = "id string, timestamp string, title string, content string, memory_type string, tags string, source string, importance double, metadata string"
    rows = lines.select(F.from_json("json", schema).alias("r"), "place").select("r.*", "place")
    tags = F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>"))
    return with_defaults(rows.withColumns({"tags": tags, "timestamp": F.regexp_replace("timestamp", "(Z|[+]00:00)$", "").try_cast("timestamp_ntz"), "source": F.regexp_replace("source", '^"|"$', ""), "importance": F.col("importance").cast("float")}))


def summary(memories: DataFrame, extracted_totals: DataFrame, now: datetime) -> DataFrame:
    """One row: rows, embedded rows, last activity, silent hours, entities and edges of the graph."""
    facts = memories.agg(F.count(F.lit(1)).alias("n_total"), F.count("embedding").alias("n_embedded"), F.max("timestamp").alias("last_activity"))
    silent = F.timestamp_diff("MINUTE", F.col("last_activity"), F.lit(now).cast("timestamp_ntz")) / 60
    return facts.withColumn("silent_hours", silent).join(F.broadcast(extracted_totals))  # one row each
