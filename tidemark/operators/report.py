"""Context reports: their sections as rows, and the whole report as text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rendering import age, cut
from .search import in_order
from .store import recent

#: Newest rows looked at, and rows of each section.
LOOK = 50
SECTIONS = {"decision": 10, "feedback": 5, "other": 10}


def sections(memories: DataFrame, now: Column) -> DataFrame:
    """(section, place, id, line, age): the newest memories by section, after a limit to ``LOOK`` rows."""
    section = F.when(F.col("memory_type").isin("decision", "feedback"), F.col("memory_type")).otherwise("other")
    newest = recent(memories, LOOK).withColumn("section", section)
    placed = newest.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("timestamp"), F.desc("id"))))
    most = F.create_map(*(F.lit(x) for pair in SECTIONS.items() for x in pair))
    kept = placed.where(F.col("place") <= most[F.col("section")])
    return kept.select("section", "place", "id", cut(F.col("title"), 120).alias("line"), age(F.col("timestamp"), now).alias("age"))


def graph_summary(all_entities: DataFrame, all_edges: DataFrame, entities: int = 10, near: int = 5) -> DataFrame:
    """(name, entity_type, mention_count, neighbours) of the entities most mentioned, at least twice; at most ``near`` names each.

    The few entities are joined to the edges from either side, so the edges are
    read once and only those of the few go on.
    """
    top = all_entities.where("mention_count >= 2").orderBy(F.desc("mention_count"), "name").limit(entities)
    ends = F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("target").alias("other")), F.struct(F.col("target").alias("name"), F.col("source").alias("other"))))
    pairs = all_edges.select("source", "target").distinct().select(ends.alias("e")).select("e.*").where("name <> other").distinct()
    counts = all_entities.select(F.col("name").alias("other"), F.col("mention_count").alias("n"))
    found = pairs.join(F.broadcast(top.select("name")), "name").join(counts, "other")
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "other"))).where(F.col("place") <= near)
    names = placed.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "other"))).alias("o")).select("name", F.array_join("o.other", ",").alias("neighbours"))
    return top.join(names, "name", "left").select("name", "entity_type", "mention_count", F.coalesce("neighbours", F.lit("")).alias("neighbours"))


def topic(found: DataFrame, memories: DataFrame, now: Column, old: Callable[[Column, Column], Column] = age) -> DataFrame:
    """The rows of a merged list of hits (id, similarity, source, rank): vector hits first, each kind by its rank, as lines with what they are, how near and how ``old``."""
    rows = in_order(found, memories, "id", F.col("source"), F.desc(F.round("rank", 9)), F.col("id"))
    near, line = F.col("similarity").isNotNull().alias("near"), cut(F.col("content"), 150).alias("line")
    return rows.select("place", "id", "memory_type", "title", near, F.round("similarity", 2).alias("similarity"), line, old(F.col("timestamp"), now).alias("age"), F.array_join("tags", ", ").alias("tags"))


#: Headings of the sections, in the report's order, and where the graph and the end stand.
HEADINGS = {"decision": "## Key Decisions", "feedback": "## User Feedback (DO NOT repeat these mistakes)", "other": "## Recent Activity"}
GRAPH_PART, END_PART, LAST = 4, 5, 1_000_000


def context(memories: DataFrame, summary: DataFrame, totals: DataFrame, now: Column) -> DataFrame:
    """(part, place, text): the entries of the whole report, each of one line or more.

    Header, decisions, feedback and other activity among the newest memories,
    the graph's most mentioned entities (``summary``, from ``graph_summary``)
    with its counts (``totals``: n_entities, n_edges), and the number of all
    memories. A section without entries has no heading; without entities there
    is no graph part. Joined by line breaks, in order, the texts are the report.
    """
    spark = memories.sparkSession
    names = list(SECTIONS)
    section = F.when(F.col("memory_type").isin("decision", "feedback"), F.col("memory_type")).otherwise("other")
    part = reduce(lambda found, i: found.when(F.col("section") == names[i], i + 1), range(len(names)), F.when(F.lit(False), 0))
    newest = recent(memories, LOOK).withColumn("section", section)
    placed = newest.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("timestamp"), F.desc("id"))))
    most = F.create_map(*(F.lit(x) for pair in SECTIONS.items() for x in pair))
    old, bold = age(F.col("timestamp"), now), F.concat(F.lit("- **"), "title", F.lit("** ("))
    told = F.concat(bold, old, F.lit(") — "), cut(F.col("content"), 120))
    tagged = F.when((F.col("section") == "decision") & (F.size("tags") > 0), F.concat(told, F.lit("\n  _tags: "), F.array_join("tags", ", "), F.lit("_"))).otherwise(told)
    lately = F.concat(F.lit("- ["), "memory_type", F.lit("] **"), "title", F.lit("** ("), old, F.lit(", importance: "), F.format_string("%.1f", F.bround(F.col("importance").cast("double"), 1)), F.lit(")"))
    entries = placed.where(F.col("place") <= most[F.col("section")]).select(part.alias("part"), F.col("place").cast("int").alias("place"), F.when(F.col("section") == "other", lately).otherwise(tagged).alias("text"))
    headed = spark.createDataFrame([(i + 1, place, text) for i, n in enumerate(names) for place, text in ((0, f"{HEADINGS[n]}\n"), (LAST, ""))], entries.schema)
    shown = headed.join(entries.select("part").distinct(), "part", "left_semi").unionByName(entries)
    linked = F.when(F.col("neighbours") != "", F.concat(F.lit("\n  → connected to: "), F.regexp_replace("neighbours", ",", ", "))).otherwise("")
    number = F.row_number().over(Window.orderBy(F.desc("mention_count"), "name"))  # ten rows at most
    graph = summary.select(F.lit(GRAPH_PART).alias("part"), number.alias("place"), F.concat(F.lit("- **"), "name", F.lit("** ("), "entity_type", F.lit(", "), F.col("mention_count").cast("string"), F.lit(" mentions)"), linked).alias("text"))
    counts = totals.where("n_entities > 0").select(F.lit(GRAPH_PART).alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit("## Knowledge Graph\n").alias("text")), F.struct(F.lit(LAST).alias("place"), F.format_string("\n_Graph: %d entities, %d edges_\n", "n_entities", "n_edges").alias("text")))).alias("e")).select("part", "e.*")
    header = spark.range(1).select(F.lit(0).alias("part"), F.lit(0).alias("place"), F.concat(F.lit("# Tidemark Context\n\n_Auto-generated: "), F.date_format(now, "yyyy-MM-dd HH:mm"), F.lit(" UTC_\n")).alias("text"))
    end = memories.agg(F.count(F.lit(1)).alias("n")).select(F.lit(END_PART).alias("part"), F.lit(0).alias("place"), F.format_string("---\n_Total memories: %d | Generated by tidemark_", "n").alias("text"))
    return reduce(DataFrame.unionByName, (header, shown, graph, counts, end))


def write(entries: DataFrame, path: str) -> None:
    """A report (part, place, text) as one text file; a few dozen rows."""
    entries.coalesce(1).sortWithinPartitions("part", "place").select(F.col("text").alias("value")).write.mode("overwrite").text(path)
