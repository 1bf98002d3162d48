"""Events into memories as streams: classification, the stateful fold, and micro-batches into a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import rules
from ..functions.embedding import pack, unpack, with_packed
from ..operators.scoring import BATCH, History, Policy, judge
from ..operators.sequences import accepted
from ..shared.names import unused

#: Keys are dealt to so many cells, each with a table of its keys as state, as a group of its own for each key costs milliseconds a batch. Not to be changed while a checkpoint is in use.
CELLS = 1024
_STATE = "kept binary"
#: Kinds of events that bypass the fold.
URGENT = ("UserCorrection",)


def classified(events: DataFrame) -> DataFrame:
    """Events (kind, content, message, files_changed, ...) with the fields of their memories; dropped ones are gone."""
    memory = rules.classify(F.col("kind"), F.col("content"), F.col("message"), F.col("files_changed"))
    return events.withColumn("_memory", memory).where("_memory is not null").select(*events.columns, "_memory.*")


def lanes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(urgent, other): two streams of one source; the urgent one is not held up by the fold."""
    urgent = F.col("kind").isin(*URGENT)
    return events.where(urgent), events.where(~urgent)


def _in_cells(rows: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``rows`` with the cell of their key, and that column's name: nulls have one of their own."""
    cell = unused(rows, "cell")
    return rows.withColumn(cell, F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(CELLS)))), cell


def _same(value: object) -> object:
    """A key as it is looked up: null, and what isn't equal to itself, as None (a cell never holds both)."""
    return None if value is None or value != value else value


def _by_key(batch: pd.DataFrame, key: str) -> tuple[list, list[np.ndarray]]:
    """The keys of a batch and the places of their rows, in the batch's order."""
    codes, names = pd.factorize(batch[key], use_na_sentinel=False)
    at = np.argsort(codes, kind="stable")
    return [_same(v) for v in names.tolist()], np.split(at, np.searchsorted(codes[at], np.arange(1, len(names))))


def _load(state: GroupState) -> list[list]:
    """The columns of a cell's table."""
    return [c.to_pylist() for c in pa.ipc.open_stream(state.get[0]).read_all().columns] if state.exists else []


def _save(state: GroupState, *columns: list) -> None:
    table = pa.table([pa.array(c) for c in columns], [f"c{i}" for i in range(len(columns))])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    state.update((out.getvalue().to_pybytes(),))


def stateful_fold(rows: DataFrame, key: str, policy: Policy = BATCH, carried: tuple[str, ...] = ()) -> DataFrame:
    """The fold of ``scoring.fold`` over a stream of (id, key, timestamp, strength, embedding): also the columns ``carried``, and then the time.

    A cell's state is the packed vectors and the times of its keys' kept rows,
    all of them or as many as the policy's ``history`` says. Within a
    micro-batch a key's rows are taken in order of (timestamp, id).
    """

    def run(at: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: dict[object, list[tuple[int, bytes]]] = {}
        for name, time, vector in zip(*_load(state), strict=True):
            kept.setdefault(name, []).append((time, vector))
        batch = pd.concat(list(frames)).sort_values(["timestamp", "id"], kind="stable")
        times, strengths = batch["timestamp"].astype("datetime64[us]").astype("int64").tolist(), batch["strength"].tolist()
        vectors = unpack(batch["embedding"].tolist())
        outcomes, scores, changed = np.empty(len(batch), object), np.empty(len(batch), object), not state.exists
        for name, places in zip(*_by_key(batch, key), strict=True):
            history, mine = History(policy.history), kept.get(name)
            if mine:
                history.load(unpack([v for _, v in mine]), np.array([t for t, _ in mine], np.int64))
            saved = False
            for i in places.tolist():
                outcomes[i], scores[i] = judge(history, vectors[i], times[i], strengths[i], policy)
                saved |= outcomes[i] == "saved"
            if saved:
                own, when = history.kept()
                kept[name], changed = list(zip(when.tolist(), pack(own).to_pylist(), strict=True)), True
        if changed:
            _save(state, [name for name, mine in kept.items() for _ in mine], *([x[i] for mine in kept.values() for x in mine] for i in (0, 1)))
        out = batch[["id", key]].assign(outcome=outcomes, score=pd.Series(scores, batch.index, float))
        yield out.assign(**{name: batch[name] for name in ("timestamp", *carried)}) if carried else out

    kind = dict(rows.dtypes)
    out = ", ".join([f"id {kind['id']}, {key} {kind[key]}, outcome string, score double", *(f"{c} {kind[c]}" for c in (("timestamp", *carried) if carried else ()))])
    dealt, cell = _in_cells(with_packed(rows.select("id", key, "timestamp", "strength", "embedding", *carried)), key)
    return dealt.groupBy(cell).applyInPandasWithState(run, out, _STATE, "append", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """The throttle over a stream of (event_id, key, ts): (event_id, key, ts) of the accepted ones; those without a time are left out."""

    def run(at: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*_load(state), strict=True)) if state.exists else {}
        batch = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        times, keep = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy(), np.zeros(len(batch), bool)
        for name, places in zip(*_by_key(batch, key), strict=True):
            found, last[name] = accepted(times[places], last.get(name), seconds * 1_000_000)
            keep[places[found]] = True
        _save(state, list(last), list(last.values()))
        yield batch.loc[keep, ["event_id", key, "ts"]]

    kind = dict(events.dtypes)
    out = f"event_id {kind['event_id']}, {key} {kind[key]}, ts {kind['ts']}"
    dealt, cell = _in_cells(events.where("ts is not null").select("event_id", key, "ts"), key)
    return dealt.groupBy(cell).applyInPandasWithState(run, out, _STATE, "append", GroupStateTimeout.NoTimeout)


def head_changed(polls: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Over a stream of polls (key, value, order columns): those whose value differs from the one before, with ``previous``; a key's first poll only sets the value.

    A cell's state is the last value of each key. Within a micro-batch a key's
    polls are taken in their order, across batches as these come.
    """

    def run(at: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*_load(state), strict=True)) if state.exists else {}
        batch = pd.concat(list(frames)).sort_values(order, kind="stable")
        names, places = _by_key(batch, key)
        batch = batch.iloc[np.concatenate(places)]
        own = batch[value].to_numpy(object)
        first = np.cumsum([0, *map(len, places)])[:-1]
        before = np.append(None, own[:-1])
        before[first] = [last.get(name) for name in names]
        a, b = pd.isna(before), pd.isna(own)
        changed = (a != b) | (~a & ~b & (before != own))
        changed[first] &= [name in last for name in names]
        last |= dict(zip(names, own[np.append(first[1:], len(own)) - 1].tolist(), strict=True))
        _save(state, list(last), [_same(v) for v in last.values()])
        yield batch.assign(previous=before).loc[changed, [*columns, "previous"]]

    kind = dict(polls.dtypes)
    columns = [key, *(c for c in order if c != key), value]
    out = ", ".join(f"{c} {kind[c]}" for c in columns) + f", previous {kind[value]}"
    dealt, cell = _in_cells(polls.select(*columns), key)
    return dealt.groupBy(cell).applyInPandasWithState(run, out, _STATE, "append", GroupStateTimeout.NoTimeout)


def into_table(rows: DataFrame, path: str, checkpoint: str, sinks: tuple[Callable[[DataFrame], None], ...] = (), every: str | None = "5 seconds") -> StreamingQuery:
    """Append each micro-batch to a Parquet table and hand it to further sinks; a sink's failure only warns.

    A batch is written under its number, so one that is repeated after a
    failure replaces itself. ``every`` None takes what is there and ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        # Sinks get the rows as they were written, so that none of them computes the batch again.
        written = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={number}")
        for sink in sinks:
            try:
                sink(written)
            except Exception as error:
                print(f"a sink failed on batch {number}: {error}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
