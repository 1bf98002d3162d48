"""Keyed tables that are kept in the shared folder and changed by batches, and a text index that follows them.

A table lies in parts by a hash of its key. A batch rewrites the parts that its
keys lie in and no others, as an overwrite of these partitions, and every row
carries the number of the batch it came with: of rows of one key that of the
highest number stays, so a batch that is repeated after a failure changes
nothing, not even when later ones have come. Deleted keys stay as marks.
"""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared.scratch import Scratch
from .search import Match, dealt, lookup_in, postings, tokens
from .store import cleanup, upsert_latest

#: Parts of a table; take so many that a part is a few files.
PARTS = 64
_BATCH, _GONE, _PART = "_batch", "_gone", "_part"


class StoredTable:
    """Rows of ``schema`` below ``path``, one for each key."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, parts: int = PARTS):
        self.spark, self.path, self.schema, self.key, self.parts = spark, path, schema, key, parts
        self.scratch = Scratch(spark, "stored")

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int").alias(_PART)

    def versions(self) -> DataFrame:
        """All rows and marks, with the number of their batch."""
        schema = StructType(list(self.schema.fields)).add(_BATCH, "long").add(_GONE, "boolean").add(_PART, "integer")
        if not self._stored():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def _stored(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        """The rows there are now."""
        return self.versions().where(~F.col(_GONE)).select(*self.schema.names)

    def find(self, *keys: object) -> DataFrame:
        """Rows of some keys, from the parts that these lie in."""
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        parts = [r[0] for r in asked.select(self.part()).distinct().collect()]
        return self.versions().where(F.col(_PART).isin(parts) & F.col(self.key).isin(*keys) & ~F.col(_GONE)).select(*self.schema.names)

    def upsert(self, rows: DataFrame, number: int, order: list[str] | None = None) -> None:
        """Insert or replace the rows of a batch; of rows of one key in it the last by ``order``."""
        rows = rows.select(*self.schema.names)
        self._apply(upsert_latest(rows, self.key, order) if order else rows.dropDuplicates([self.key]), number, False)

    def delete(self, keys: DataFrame, number: int) -> None:
        """Delete the rows of these keys."""
        marks = keys.select(self.key).distinct()
        empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(self.key) for f in self.schema.fields]
        self._apply(marks.select(*empty), number, True)

    def clean(self, now: datetime, number: int, days: int = 30, importance: float = 0.5) -> None:
        """Delete old memories of little importance (``store.cleanup``)."""
        self.delete(cleanup(self.read(), now, days, importance)[1].select(self.key), number)

    def _apply(self, rows: DataFrame, number: int, gone: bool) -> None:
        fresh = uuid.uuid4().hex
        mine = rows.withColumns({_BATCH: F.lit(number).cast("long"), _GONE: F.lit(gone), _PART: self.part()})
        mine = self.scratch.keep(mine, f"batch-{fresh}")
        touched = [r[0] for r in mine.select(_PART).distinct().collect()]  # at most ``parts`` numbers
        if touched:
            stored = self._stored()
            both = self.versions().where(F.col(_PART).isin(touched)).unionByName(mine) if stored else mine
            last = both.repartitionByRange(_PART, self.key).sortWithinPartitions(_PART, self.key)
            if stored:
                # Rows of one key lie in one range, so they meet without a further shuffle.
                newest = Window.partitionBy(_PART, self.key).orderBy(F.desc(_BATCH))
                last = last.withColumn("_newest", F.row_number().over(newest)).where("_newest = 1").drop("_newest")
                # What is overwritten is read, so the new parts are written aside first.
                last = self.scratch.keep(last, f"parts-{fresh}")
            last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(self.path)
        self.scratch.drop(f"batch-{fresh}", f"parts-{fresh}")

    def sink(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        self.upsert(batch, number)


class LiveIndex:
    """A stored table and the postings of its texts, which follow it batch by batch.

    A batch's postings are a folder of their own, under the batch's number, and
    are never changed. A posting counts if its row's version is the one that
    the table has now, so replaced and deleted rows drop out by the join with
    the table's keys. Numbers of rows and lengths are sums over the table's
    narrow columns. ``merge`` rewrites all that counts into one folder.
    """

    LENGTH = "_length"

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, columns: tuple[str, ...], parts: int = PARTS):
        self.spark, self.path, self.key, self.columns = spark, path, key, columns
        self.plain = schema
        self.table = StoredTable(spark, f"{path}/rows", StructType(list(schema.fields)).add(self.LENGTH, "integer"), key, parts)

    def upsert(self, rows: DataFrame, number: int, order: list[str] | None = None) -> None:
        rows = rows.select(*self.plain.names)
        rows = upsert_latest(rows, self.key, order) if order else rows.dropDuplicates([self.key])
        rows = self.table.scratch.keep(rows, f"latest-{uuid.uuid4().hex}")
        length = reduce(lambda a, b: a + b, (F.size(tokens(F.col(c))) for c in self.columns))
        found = postings(rows, self.key, self.columns).withColumn(_BATCH, F.lit(number).cast("long"))
        dealt(found, self.key).write.mode("overwrite").parquet(f"{self.path}/postings/run={number}")
        self.table.upsert(rows.withColumn(self.LENGTH, length), number)

    def delete(self, keys: DataFrame, number: int) -> None:
        self.table.delete(keys, number)

    def read(self) -> DataFrame:
        return self.table.read().drop(self.LENGTH)

    def live(self) -> DataFrame:
        """Postings of the rows as they are now."""
        now = self.table.versions().where(~F.col(_GONE)).select(self.key, _BATCH)
        return self.spark.read.parquet(f"{self.path}/postings").drop("run").join(now, [self.key, _BATCH])

    def search(self, match: Match, n: int) -> DataFrame:
        """(key, score) of the n best rows, as ``search.search`` over the rows gives them."""
        facts = self.table.read().agg(F.count(F.lit(1)).alias("n"), F.avg(self.LENGTH).alias("mean")).first().asDict()
        return lookup_in(self.live(), facts, match, self.key, n)

    def merge(self, number: int) -> None:
        """Rewrite the postings that count into one folder, sorted by term; not while a search runs."""
        name = f"merged-{uuid.uuid4().hex}"
        kept = self.table.scratch.keep(dealt(self.live(), self.key), name)
        kept.write.mode("overwrite").parquet(f"{self.path}/postings-new")
        jvm = self.spark._jvm
        old, new = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}") for p in ("postings", "postings-new"))
        files = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.delete(old, True)
        files.mkdirs(old)
        files.rename(new, jvm.org.apache.hadoop.fs.Path(f"{self.path}/postings/run={number}"))
        self.table.scratch.drop(name)
