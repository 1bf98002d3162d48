"""Operators that go through events in order: by key as streams with constant memory, by one clock in ranges of time.

By key, rows are dealt by key and sorted within partitions; a task reads its
rows as a stream of Arrow batches and keeps the state of one key at a time, so a
key's rows are never gathered. By one clock, ranges of time are worked on in
parallel: each says what clock it would hand on for every clock it may be
handed, and only these small tables are gone through in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared.ranges import stretches
from ..shared.scratch import Scratch


def accepted(times: np.ndarray, last: int | None, gap: int) -> tuple[list[int], int | None]:
    """Places of the accepted ones of the sorted times, each found by a jump from the one before, and the clock after them."""
    at, out = 0 if last is None else int(np.searchsorted(times, last + gap)), []
    while at < len(times):
        out.append(at)
        last = int(times[at])
        at = max(at + 1, int(np.searchsorted(times, last + gap)))
    return out, last


def _micros(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return pc.cast(batch.column(column), pa.int64()).to_numpy(zero_copy_only=False)


def _spans(batch: pa.RecordBatch, key: str) -> Iterator[tuple[object, int, int]]:
    """(value, from, to) of the runs of equal values of a sorted column."""
    codes = batch.column(key).dictionary_encode()
    index = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(index)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(index)], strict=True):
        if b > a:
            yield batch.column(key)[int(a)].as_py(), int(a), int(b)


def throttle(events: DataFrame, key: str | None, seconds: int, start: datetime | None = None) -> DataFrame:
    """Events of a key that come ``seconds`` or more after the last accepted one.

    Greedy, not a session window: an event that is dropped does not move the
    clock. The first event of a key is accepted, or, with ``start``, the first
    one ``seconds`` after that. Of events of one time that of the smallest
    event_id comes first; events without a time are left out. Without a key all
    events share one clock (see ``one_clock``).
    """
    gap = seconds * 1_000_000
    began = None if start is None else int(start.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)
    timed = events.where(F.col("ts").isNotNull())
    if key is None:
        return one_clock(timed, gap, began)
    dealt = timed.repartition(key).sortWithinPartitions(key, "ts", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = object(), began
        for batch in batches:
            times, keep = _micros(batch, "ts"), np.zeros(batch.num_rows, bool)
            for value, a, b in _spans(batch, key):
                if value != own:
                    own, last = value, began
                found, last = accepted(times[a:b], last, gap)
                keep[[a + i for i in found]] = True
            yield batch.filter(pa.array(keep))

    return dealt.mapInArrow(run, events.schema)


def _hand_on(gap: int):
    """For each range of times: (segment, entry, exit), the clock after the range if the first accepted time is ``entry`` or earlier.

    Chains of accepted times are followed by pointer doubling. Only times in
    the range's first gap, and the one behind it, can come first; of those that
    lead to the same clock the last stands for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []

        def table() -> pa.RecordBatch:
            t = np.concatenate(parts)
            follow = np.searchsorted(t, t + gap)
            last = np.arange(len(t))
            jump = np.where(follow < len(t), follow, last)
            while not np.array_equal(jump, jump[jump]):
                jump = jump[jump]
            first = np.arange(min(len(t), int(np.searchsorted(t, t[0] + gap)) + 1))
            ends = t[jump[first]]
            kept = first[np.append(ends[1:] != ends[:-1], True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), own, np.int32)), pa.array(t[kept]), pa.array(ends[kept])], ["segment", "entry", "exit"])

        for batch in batches:
            times = batch.column("t").to_numpy(zero_copy_only=False)
            for value, a, b in _spans(batch, "segment"):
                if value != own and parts:
                    yield table()
                    parts = []
                own = value
                parts.append(times[a:b])
        if parts:
            yield table()

    return run


def _clocks(gap: int, began: int | None):
    """(segment, clock) of each segment, the clock it is handed, from the tables in order of segment and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, clock, open_ = None, began, False
        for batch in batches:
            fresh, handed = [], []
            for r in batch.to_pylist():
                if r["segment"] != own:
                    own, open_ = r["segment"], True
                    fresh.append(own)
                    handed.append(clock)
                if open_ and (clock is None or r["entry"] >= clock + gap):
                    clock, open_ = r["exit"], False
            yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.int32()), pa.array(handed, pa.int64())], ["segment", "clock"])

    return run


def one_clock(events: DataFrame, gap: int, began: int | None) -> DataFrame:
    """The throttle by one clock, ``gap`` and ``began`` in microseconds, in as many ranges of time as there are shuffle partitions.

    Events of one time are one, by an aggregation before the shuffle. Each range
    makes its table of clocks; the tables, a few rows a range where chains of
    accepted times meet, are gone through by one task; then each range, handed
    its clock, gives its accepted events.
    """
    scratch, parts = Scratch(events.sparkSession, "clock"), max(1, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    t = F.unix_micros(F.col("ts").cast("timestamp")) if dict(events.dtypes)["ts"] == "timestamp" else F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)")
    firsts = scratch.keep(events.groupBy(t.alias("t")).agg(F.min_by(F.struct(*events.columns), "event_id").alias("first")), "firsts")
    firsts = firsts.withColumn("segment", stretches(firsts, "t", parts).cast("int"))
    tables = firsts.select("segment", "t").repartition("segment").sortWithinPartitions("segment", "t").mapInArrow(_hand_on(gap), "segment int, entry long, exit long")
    tables = scratch.keep(tables, "tables")
    clocks = tables.repartition(1).sortWithinPartitions("segment", "entry").mapInArrow(_clocks(gap, began), "segment int, clock long")
    handed = firsts.join(F.broadcast(clocks), "segment")  # a row for each range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in batches:
            times, keep = batch.column("t").to_numpy(zero_copy_only=False), []
            for value, a, b in _spans(batch, "segment"):
                if value != own:
                    own, last = value, batch.column("clock")[a].as_py()
                found, last = accepted(times[a:b], last, gap)
                keep += [a + i for i in found]
            yield batch.take(pa.array(keep, pa.int64()))

    dealt = handed.select("segment", "t", "clock", "first").repartition("segment").sortWithinPartitions("segment", "t")
    return dealt.mapInArrow(run, dealt.schema).select("first.*")


def head_changes(polls: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from the one before; a key's first row only sets the value."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return polls.withColumn("previous", before).withColumn("_n", number).where((F.col("_n") > 1) & ~F.col(value).eqNullSafe(F.col("previous"))).drop("_n")
