"""Lines that an earlier document holds are dropped, by levelled sorted runs of line hashes; DataFrame functions only.

The runs are a log-structured set of all line hashes so far. A run is a table
that is bucketed and sorted by hash, so it is merged with a batch's hashes
without being shuffled or read into memory. Each batch is held against all
runs: hashes that no run has become a new run of the lowest level, the others
are repeats. When a level has ``fanout`` runs they are compacted into one of the
next level, so a batch meets a number of runs that grows with the logarithm of
the number of batches, and a hash is rewritten as often.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared.ranges import stretches
from ..shared.scratch import Scratch

#: Shortest key that counts, batches that a table is cut into, and runs of a level that are compacted into one of the next.
LEAST, BATCHES, FANOUT = 10, 6, 3
#: Stands for a missing id, so rows without id come last and are one document.
_LAST = (1 << 63) - 1
_HASH = ["h1", "h2"]
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    bare = F.trim(line, F.lit(_BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


class LineRuns:
    """A set of line hashes (h1, h2) as levels of sorted runs in the shared folder."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT):
        self.scratch, self.fanout = scratch, fanout
        self.buckets = max(1, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        """All runs, the lowest level first."""
        return [self.scratch.spark.table(name) for level in self.levels for name in level]

    def look_up(self, keys: DataFrame) -> DataFrame:
        """``keys``, distinct by hash, with ``seen``: whether a run has the hash. Each run is merged with the keys as it lies."""
        marks = []
        for number, run in enumerate(self.runs()):
            marks.append(f"_run{number}")
            keys = keys.join(run.withColumn(marks[-1], F.lit(True)).hint("merge"), _HASH, "left")
        seen = reduce(lambda a, b: a | b, (F.col(m).isNotNull() for m in marks), F.lit(False))
        return keys.withColumn("seen", seen).drop(*marks)

    def add(self, new: DataFrame, level: int = 0) -> None:
        """Hashes that no run has, as a run of their own; a full level is compacted into a run of the next."""
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self._write(new))
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            # No two runs share a hash, so compacting is a union.
            self.add(reduce(DataFrame.union, map(self.scratch.spark.table, full)), level + 1)
            self._forget(full)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select(*_HASH).repartition(self.buckets, *_HASH)
        dealt.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).format("parquet").option("path", f"{self.scratch.path}/{name}").saveAsTable(name)
        return name

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.scratch.spark.sql(f"drop table if exists {name}")
            self.scratch.drop(name)

    def close(self) -> None:
        """Delete the runs."""
        for level in self.levels:
            self._forget(level)
        self.levels = []


def hashed_lines(docs: DataFrame, batch: Column, least: int = LEAST) -> DataFrame:
    """(batch, id, row, at, h1, h2) of the lines of (id, row, text) whose keys have ``least`` code points or more; ``at`` counts from 0.

    A key is known by 96 bits of two independent hash functions.
    """
    lines = docs.select(batch.alias("batch"), "id", "row", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least)
    return lines.select("batch", "id", "row", "at", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def drop_repeated(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, fanout: int = FANOUT, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): each text without the lines that a document of a smaller id has.

    Reads (doc_id, text); further columns are ignored. A null or empty text is
    one empty line. Lines are compared by ``line_key``, and those of fewer than
    ``least`` code points always stay; repeats within a document stay too. Rows
    of one id are one document, so none of them loses a line to another; rows
    without an id are one document that comes after all others. Equal rows get
    equal results, very long texts are read whole, and an empty table gives no
    rows.

    Ids are cut into ``batches`` ranges of about equally many rows. A batch's
    hashes are aggregated before they are shuffled, so a line that very many
    documents share is a few rows. Hashes that earlier batches have, and those
    that the batch has in two documents, are then joined with the batch's lines:
    two plain shuffles, which adaptive execution splits where a line is hot. At
    last each row gets the places of its dropped lines, one for each of its
    lines at most, in one shuffle of the texts.
    """
    own = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    schema = "id long, row long, at int, h1 long, h2 int, batch int"
    hashed_lines(own, stretches(own, "id", batches).cast("int"), least).write.partitionBy("batch").option("compression", "zstd").parquet(f"{scratch.path}/lines")
    lines = docs.sparkSession.read.schema(schema).parquet(f"{scratch.path}/lines")
    runs = LineRuns(scratch, fanout)
    for number in range(batches):
        batch = lines.where(F.col("batch") == number)
        keys = batch.groupBy(*_HASH).agg(F.min("id").alias("first"), F.max("id").alias("last"))
        keys = scratch.keep(runs.look_up(keys), f"keys{number}")
        if number < batches - 1:
            runs.add(keys.where("not seen"))
        repeats = keys.where("seen or first < last").select(*_HASH, "seen", "first")
        dropped = batch.join(repeats, _HASH).where("seen or id > first").select("id", "row", "at")
        dropped.write.mode("append").option("compression", "zstd").parquet(f"{scratch.path}/dropped")
        scratch.drop(f"keys{number}")
    runs.close()
    scratch.drop("lines")
    dropped = docs.sparkSession.read.schema("id long, row long, at int").parquet(f"{scratch.path}/dropped")
    gone = scratch.keep(dropped.groupBy("id", "row").agg(F.collect_set("at").alias("gone")), "gone")
    scratch.drop("dropped")
    # The outer lambda binds the split lines once for the inner one.
    kept = F.expr(r"""transform(array(named_struct('lines', split(text, '\n'), 'gone', gone)),
        d -> array_join(transform(array_except(sequence(0, size(d.lines) - 1), d.gone), i -> d.lines[i]), '\n'))[0]""")
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return own.join(gone, ["id", "row"], "left").select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
