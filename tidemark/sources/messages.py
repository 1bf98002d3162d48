"""User messages from lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a message at least, and the mark of lines that no user wrote.
LEAST_BYTES, NOT_USER = 10, "<system-reminder>"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line) of the files one level below a folder."""
    return spark.read.text(f"{folder}/*/*.jsonl").select(F.input_file_name().alias("path"), F.col("value").alias("line"))


def user_messages(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines that are messages of users, with ``text`` and ``said_at``; other lines, broken ones included, are dropped."""
    told = lines.withColumn("_told", F.from_json(line, "type string, timestamp string, message struct<timestamp: string, content: variant>"))
    content = F.col("_told.message.content")
    # A content of another kind would be turned into text, so its kind is asked for as well.
    text = F.when(F.schema_of_variant(content) == "STRING", F.variant_get(content, "$", "string"))
    rows = told.withColumn("text", text).withColumn("said_at", F.coalesce("_told.timestamp", "_told.message.timestamp", F.lit("")))
    kept = (F.col("_told.type") == "user") & (F.octet_length("text") >= LEAST_BYTES) & ~F.col("text").contains(NOT_USER)
    return rows.where(kept).drop("_told")
