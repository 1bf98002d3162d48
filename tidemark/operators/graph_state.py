"""The graph kept batch by batch, and stored so that a name is found in few files.

Counters are partial states under the batch's number: a repeated batch replaces
its own, and reading adds them up. Calls for an edge are counted in the order
of the batches and of time within a batch, so batches that follow each other in
time give the weights of one pass over everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared.scratch import Scratch
from .graph import edge_places, mentions

_SAME = ["source", "target", "relation"]


class GraphState:
    """Counters of entities and edges below ``path``; ``key`` and ``when`` name the memories' id and time."""

    def __init__(self, spark: SparkSession, path: str, key: str, when: str):
        self.spark, self.path, self.key, self.when = spark, path, key, when

    def add(self, extracted: DataFrame, number: int) -> None:
        """Count a batch of memories with their ``entities`` and ``edges``."""
        scratch = Scratch(self.spark, "graph-state")
        kept = scratch.keep(extracted.select(self.key, self.when, "entities", "edges"), "batch")
        named = mentions(kept, self.key, self.when).groupBy("name").agg(
            F.min(F.struct(F.col(self.when).alias("at"), F.col(self.key).alias("key"), "type")).alias("first"),
            F.count(F.lit(1)).alias("mention_count"), F.min(self.when).alias("first_seen"), F.max(self.when).alias("last_seen"),
        )
        self._write(named, "entities", number)
        self._write(edge_places(kept, self.key, self.when, scratch).withColumnRenamed(self.key, "memory_id"), "calls", number)
        totals = self._read("calls").where(F.col("batch") == number).groupBy(*_SAME).agg(F.sum("own").alias("n"))
        self._write(totals, "totals", number)
        scratch.drop("batch")

    def sink(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch`` over extracted memories."""
        self.add(batch, number)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def entities(self) -> DataFrame:
        """(name, entity_type, mention_count, first_seen, last_seen), as ``graph.entities`` gives them."""
        added = self._read("entities").groupBy("name").agg(F.min("first").alias("first"), F.sum("mention_count").alias("mention_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        return added.select("name", F.col("first.type").alias("entity_type"), "mention_count", "first_seen", "last_seen")

    def edges(self) -> DataFrame:
        """(source, target, relation, memory_id, weight), as ``graph.edges`` gives them: a batch's places follow the calls of all batches before."""
        totals = self._read("totals")
        # A row for each edge and batch.
        each = Window.partitionBy(*_SAME).orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*_SAME)
        totals = totals.select(*_SAME, "batch", (F.sum("n").over(each) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("calls"))
        placed = self._read("calls").join(totals, [*_SAME, "batch"])
        own = placed.groupBy(*_SAME, "memory_id").agg(F.min(F.col("before") + F.col("rn")).alias("rn"), F.sum("own").alias("own"), F.max("calls").alias("calls"))
        return own.select(*_SAME, "memory_id", (1.0 + 0.5 * ((F.col("calls") - F.col("rn")) - (F.col("own") - 1))).alias("weight"))


def write_adjacency(path: str, entities: DataFrame, edges: DataFrame, links: DataFrame) -> None:
    """Store the graph for questions about one name.

    Edges are stored from both their ends, with the other end's type and
    mentions beside it; ``links`` are (memory_id, name, timestamp). All tables
    are dealt by ranges of the name and sorted, so a filter on it reads the
    files and row groups of that name only, and a name of very many edges has
    several files.
    """
    end = lambda a, b, way: edges.select(F.col(a).alias("name"), F.col(b).alias("other"), "relation", "memory_id", "weight", F.lit(way).alias("way"))
    both = end("source", "target", "out").unionByName(end("target", "source", "in").where("name <> other"))
    known = entities.select(F.col("name").alias("other"), F.col("entity_type").alias("other_type"), F.col("mention_count").alias("other_mentions"))
    tables = {
        "adjacency": (both.join(known, "other", "left"), ["name", "other", "relation", "memory_id"]),
        "names": (entities.withColumn("lower", F.lower("name")), ["lower", "name"]),
        "links": (links.select("name", "timestamp", "memory_id"), ["name", "timestamp", "memory_id"]),
    }
    for name, (rows, order) in tables.items():
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")


def neighbours(spark: SparkSession, path: str, name: str, n: int = 20) -> DataFrame:
    """(name, entity_type, mention_count) one edge away, most mentioned first, from the stored graph."""
    near = spark.read.parquet(f"{path}/adjacency").where((F.col("name") == name) & (F.col("other") != name) & F.col("other_type").isNotNull())
    found = near.groupBy(F.col("other").alias("name")).agg(F.first("other_type").alias("entity_type"), F.first("other_mentions").alias("mention_count"))
    return found.orderBy(F.desc("mention_count"), "name").limit(n)


def query(spark: SparkSession, path: str, name: str, n: int = 20) -> dict[str, DataFrame]:
    """``graph.query`` from the stored graph: the entity, its edges heaviest first, newest memories, neighbours."""
    entity = spark.read.parquet(f"{path}/names").where(F.col("lower") == name.lower()).drop("lower")
    row = entity.select("name").first()
    exact = row["name"] if row else name
    touched = spark.read.parquet(f"{path}/adjacency").where(F.col("name") == exact)
    source = F.when(F.col("way") == "out", F.col("name")).otherwise(F.col("other"))
    target = F.when(F.col("way") == "out", F.col("other")).otherwise(F.col("name"))
    edges = touched.select(source.alias("source"), target.alias("target"), "relation", "memory_id", "weight").orderBy(F.desc("weight"), *_SAME, "memory_id")
    mine = spark.read.parquet(f"{path}/links").where(F.col("name") == exact).select(F.col("memory_id").alias("id"), "timestamp").orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    return {"entity": entity, "edges": edges, "memories": mine, "neighbours": neighbours(spark, path, exact, n)}
