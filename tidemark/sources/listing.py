"""Changes of files between two listings, and sizes of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, path): create, modify or remove, by a full outer join on the path."""
    old = before.select("path", F.struct("modified", "length").alias("old"))
    new = after.select("path", F.struct("modified", "length").alias("new"))
    both = old.join(new, "path", "full")
    change = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "remove").when(F.col("old") != F.col("new"), "modify")
    return both.select(change.alias("change"), "path").where("change is not null")


def stored_bytes(spark: SparkSession, folder: str) -> int:
    return listing(spark, folder).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def doctor(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> dict[str, bool]:
    """Whether each table below the folder can be read."""
    out = {}
    for name in tables:
        try:
            spark.read.parquet(f"{folder}/{name}").limit(1).count()
            out[name] = True
        except Exception:
            out[name] = False
    return out


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an exported JSON array with their ``place`` in it, which one task reads in its order; tags may be an array or JSON text."""
    rows = spark.read.json(path, multiLine=True).withColumn("place", F.monotonically_increasing_id())
    if dict(rows.dtypes).get("tags") == "string":
        rows = rows.withColumn("tags", F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>")))
    return rows
