"""Intermediate tables that outlive a lost executor.

Lineage is cut by writing Parquet below the folder that the session names in
``spark.checkpoint.dir``. A session without that setting gets a folder of its
own, which is allowed only where driver and tasks share one machine.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query go when it has ended. Else they stay until the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, as the session names it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/tidemark-scratch"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session, once nothing returned by an operator is read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _MADE.get(spark.sparkContext.applicationId):
        path = jvm.org.apache.hadoop.fs.Path(_MADE[spark.sparkContext.applicationId].pop())
        path.getFileSystem(conf).delete(path, True)


#: Folders that each application's operators have made.
_MADE: dict[str, list[str]] = {}


class Scratch:
    """A folder of intermediate tables for one run of an operator, or a given folder that goes with the session's others."""

    def __init__(self, spark: SparkSession, label: str, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(self.path)

    def keep(self, df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back; with ``tidy`` what it shuffled goes at once, as long as nothing of it is cached."""
        with self._tidied() if tidy else contextlib.nullcontext():
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    @contextlib.contextmanager
    def _tidied(self) -> Iterator[None]:
        before = self.spark.conf.get(TIDY, "false")
        self.spark.conf.set(TIDY, "true")
        try:
            yield
        finally:
            self.spark.conf.set(TIDY, before)

    def drop(self, *names: str) -> None:
        """Delete tables that no returned DataFrame reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)
