"""Memories as Markdown files, vault notes and payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rendering import file_name, markdown


def memory_files(memories: DataFrame) -> DataFrame:
    """(path, body): one Markdown text for each memory; of equal paths the newest, as a later file replaces an earlier."""
    body = markdown(F.col("title"), F.col("memory_type"), F.col("timestamp"), F.col("tags"), F.col("importance"), F.col("content"))
    rows = memories.select(file_name(F.col("timestamp"), F.col("title")).alias("path"), body.alias("body"), "timestamp", "id")
    return rows.groupBy("path").agg(F.max_by("body", F.struct("timestamp", "id")).alias("body"))


def project_folder(base: str, project: str) -> str:
    """Where a project's memory files lie: a folder named after its path, with - for /."""
    return f"{base.rstrip('/')}/-{project.replace('/', '-').lstrip('-')}/memory"


def vault_files(memories: DataFrame) -> DataFrame:
    """The same with a last line of #tags."""
    tagged = F.concat("content", F.lit("\n\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " "))
    return memory_files(memories.withColumn("content", tagged))


def payload(*columns: str) -> Column:
    """The JSON that a service is sent."""
    return F.to_json(F.struct(*columns))


def write_files(files: DataFrame, folder: str) -> int:
    """Write (path, body) below a folder that all executors share; the number of files.

    A task writes its rows under their final names, so a repeated task writes
    the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write(body.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "body").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
