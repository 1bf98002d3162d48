"""The whole intake as one stream: from events to kept memories, their graph and further sinks.

Events are classified and embedded; those that are urgent pass at once, the
others go through the stateful fold. Each micro-batch of judged memories is
written once and read back, so that nothing behind it computes it again: the
stored table takes what is saved, the graph's counters follow, and sinks get
the written rows. All of these go by the batch's number, so a batch that is
repeated after a failure replaces itself. A sink that fails leaves a row in a
table of failures and holds up nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.embedding import with_embedding
from ..functions.rules import single
from ..operators import graph, scoring
from ..operators.graph_state import GraphState
from ..operators.scoring import BATCH, Policy
from ..operators.stored import StoredTable
from .ingest import classified, lanes, stateful_fold

Sink = Callable[[DataFrame, int], None]
#: Columns of a memory that the fold hands on, and those of the stored table.
CARRIED = ("kind", "content", "title", "memory_type", "importance", "tags")
STORED = "id long, {key} {type}, timestamp timestamp_ntz, kind string, content string, title string, memory_type string, importance float, tags array<string>, outcome string, score double"


def judged(events: DataFrame, key: str, policy: Policy = BATCH) -> DataFrame:
    """Memories with outcome and score from a stream of (id, key, timestamp, kind, content, message, files_changed).

    Urgent ones are saved as they are; a saved one's importance is its score.
    """
    told = classified(events).withColumn("strength", scoring.signal(F.col("kind"), F.col("memory_type")))
    urgent, other = lanes(told)
    rows = with_embedding(other.withColumn("_text", F.concat_ws(" ", "title", "content")), "_text", packed=True).drop("_text")
    folded = stateful_fold(rows, key, policy, CARRIED)
    saved = urgent.select("id", key, F.lit("saved").alias("outcome"), F.lit(None).cast("double").alias("score"), "timestamp", *CARRIED)
    both = folded.select(*saved.columns).unionByName(saved)
    return both.withColumn("importance", F.when(F.col("outcome") == "saved", F.coalesce(single(F.col("score")), F.col("importance"))).otherwise(F.col("importance")))


class Intake:
    """Where an intake lies: ``judged`` by batch, the stored table, the graph's counters, counts and failures of sinks."""

    def __init__(self, spark: SparkSession, path: str, key: str, key_type: str, sinks: dict[str, Sink] | None = None, parts: int = 64):
        self.spark, self.path, self.key, self.sinks = spark, path, key, sinks or {}
        self.schema = spark.createDataFrame([], STORED.format(key=key, type=key_type)).schema
        self.table = StoredTable(spark, f"{path}/memories", self.schema, "id", parts)
        self.graph = GraphState(spark, f"{path}/graph", "id", "timestamp")

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of judged memories, for ``foreachBatch``."""
        written = f"{self.path}/judged/batch={number}"
        batch.select(*self.schema.names).write.mode("overwrite").parquet(written)
        rows = self.spark.read.schema(self.schema).parquet(written)
        saved = rows.where("outcome = 'saved'")
        self.table.upsert(saved, number, ["timestamp"])
        self.graph.add(graph.extract(saved), number)
        failed = []
        for name, sink in self.sinks.items():
            try:
                sink(saved, number)
            except Exception as error:
                failed.append((name, str(error)[:500]))
        self.spark.createDataFrame(failed, "sink string, error string").write.mode("overwrite").parquet(f"{self.path}/failures/batch={number}")

    def start(self, events: DataFrame, checkpoint: str, policy: Policy = BATCH, every: str | None = "5 seconds") -> StreamingQuery:
        """Begin or go on; ``every`` None takes what is there and ends. Counts of each batch are the observed metric ``intake``."""
        counted = judged(events, self.key, policy).observe("intake", *(F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("saved", "deduped", "low_importance")))
        writer = counted.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def judged(self) -> DataFrame:
        """All judged memories so far."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/judged/*")

    def outcomes(self) -> DataFrame:
        return scoring.outcomes(self.judged())

    def failures(self) -> DataFrame:
        """(sink, error, batch)."""
        return self.spark.read.parquet(f"{self.path}/failures")
