"""Ranges of about equally many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stretches(rows: DataFrame, key: str, n: int) -> Column:
    """Number of the stretch of the ordered values of ``key`` that a row lies in: n or fewer, about equally full.

    The bounds are quantiles, n - 1 numbers whatever the input, and a value
    finds its stretch by halving.
    """
    found = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n).alias("b")).first() if n > 1 else None
    bounds = sorted(set(found["b"] or ())) if found else []
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    listed = F.array(*map(F.lit, bounds))
    further = lambda at, step: F.when(F.coalesce(F.get(listed, at + step - 1) <= F.col(key), F.lit(False)), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)
