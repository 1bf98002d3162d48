"""Names of helper columns that callers' tables don't have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name
