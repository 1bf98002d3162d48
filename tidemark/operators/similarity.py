"""Nearest vectors of a set of queries, exactly.

Few queries go to the data: each task holds them and keeps its best, so no data
vector is shuffled. Many queries meet the data in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared.scratch import Scratch

#: Vectors of a data block and of a query block.
DATA_BLOCK, QUERY_BLOCK = 4096, 256
#: Queries that are sent to all tasks, at most.
FEW = 2048
#: Vectors of a block where a group's rows are compared with each other, and pivots that blocks are told apart by.
PAIR_BLOCK, PIVOTS = 1024, 16
#: Blocks on a side of a tile of pairs of blocks.
TILE = 32
# Blocks are joined by merging, as a side that looks small when compressed would else be broadcast, through the driver.
#: Slack of angles, for rounding.
_SLACK = 1e-6


def unit(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1; zero vectors stay zero."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _cosines(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
    """Cosines of rows; -3 for zero vectors and rows of one id."""
    s = a @ b.T
    s[~a.any(1)] = -3
    s[:, ~b.any(1)] = -3
    s[a_ids[:, None] == b_ids[None, :]] = -3
    return s


def _kept(s: np.ndarray, k: int | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each row, ties with the last of them too, of at least that cosine."""
    if k is not None and k < s.shape[1]:
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return np.nonzero((s >= np.maximum(cut - 1e-9, least)[:, None]) & (s > -3))
    return np.nonzero((s >= least) & (s > -3))


def _placed(found: DataFrame, k: int | None) -> DataFrame:
    if k is None:
        return found
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "id"))
    return found.withColumn("place", best).where(F.col("place") <= k)


_FOUND = "query long, id long, similarity double"


def near(data: DataFrame, queries: DataFrame, key: str, vector: str = "embedding", k: int | None = None, least: float = -2.0) -> DataFrame:
    """(query, id, similarity): for each query its k most similar other rows of at least that cosine.

    Zero vectors are similar to none. Vectors must have one length. Up to
    ``FEW`` queries, after a count, are held by every task; more of them are
    packed into blocks that meet all blocks of the data. What is shuffled then
    is the best k of each task or block.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    found = asked.limit(FEW + 1).toArrow()
    if found.num_rows > FEW:
        return _placed(_in_blocks(data, asked, key, vector, k, least), k)
    ids, vectors = found.column("id").to_numpy(), unit(found.column("vector").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # places of queries, ids, cosines
        for batch in batches:
            for at in range(0, batch.num_rows, DATA_BLOCK):
                part = batch.slice(at, DATA_BLOCK)
                own = part.column("id").to_numpy(zero_copy_only=False)
                s = _cosines(vectors, ids, unit(part.column("vector")), own)
                i, j = _kept(s, k, least)
                fresh = [i, own[j], s[i, j]]
                if k is None:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(fresh[1]), pa.array(fresh[2])], ["query", "id", "similarity"])
                    continue
                best = [np.concatenate(x) for x in zip(best, fresh, strict=True)]
                order = np.lexsort((best[1], -np.round(best[2], 9), best[0]))
                best = [x[order] for x in best]
                first = np.searchsorted(best[0], best[0])
                best = [x[np.arange(len(first)) - first < k] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query", "id", "similarity"])

    rows = data.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    return _placed(rows.mapInArrow(run, _FOUND), k) if len(ids) else _placed(data.sparkSession.createDataFrame([], _FOUND), k)


def _blocks(df: DataFrame, key: str, vector: str, parts: int, name: str) -> DataFrame:
    """So many rows of about equally many vectors: (name, name_ids, name_vectors)."""
    block = F.pmod(F.xxhash64(key), F.lit(parts)).alias(name)
    return df.where(F.col(vector).isNotNull()).groupBy(block).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v"))).alias("rows")).select(name, F.col("rows.id").alias(f"{name}_ids"), F.col("rows.v").alias(f"{name}_vectors"))


def _meet(k: int | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, mine, q_ids, q = (batch.column(c)[row].values for c in ("data_ids", "data_vectors", "asked_ids", "asked_vectors"))
                ids, q_ids = (x.to_numpy(zero_copy_only=False) for x in (ids, q_ids))
                s = _cosines(unit(q), q_ids, unit(mine), ids)
                i, j = _kept(s, k, least)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(s[i, j])], ["query", "id", "similarity"])

    return run


def _in_blocks(data: DataFrame, asked: DataFrame, key: str, vector: str, k: int | None, least: float) -> DataFrame:
    """Every query block meets every data block by an equi-join on the data block's number, for each of which the query blocks are repeated."""
    parts = max(1, -(-data.count() // DATA_BLOCK))
    blocks = _blocks(data.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")), "id", "vector", parts, "data")
    asked = _blocks(asked, "id", "vector", max(1, -(-asked.count() // QUERY_BLOCK)), "asked")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("data")
    met = asked.select("asked_ids", "asked_vectors", every).join(blocks.hint("merge"), "data")
    return met.select("data_ids", "data_vectors", "asked_ids", "asked_vectors").mapInArrow(_meet(k, least), _FOUND)


def in_lists(stored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, id, similarity, place): the k best of the lists that each query asks for, from (list, id, vector) of both.

    Up to ``FEW`` rows of ``asked`` (a row for each query and list) are held by
    every task, and only folders of their lists are read. More of them are
    joined to the lists, both sides in blocks.
    """
    found = asked.limit(FEW + 1).toArrow()
    if found.num_rows > FEW:
        lists = lambda rows, size, name: rows.groupBy("list", F.pmod(F.xxhash64("id"), F.lit(size)).alias("cell")).agg(F.collect_list(F.struct("id", "vector")).alias("rows")).select("list", F.col("rows.id").alias(f"{name}_ids"), F.col("rows.vector").alias(f"{name}_vectors"))
        largest = lambda rows: rows.groupBy("list").count().agg(F.max("count")).first()[0] or 1
        data, queries = lists(stored, -(-largest(stored) // DATA_BLOCK), "data"), lists(asked, -(-largest(asked) // QUERY_BLOCK), "asked")
        met = data.join(queries.hint("merge"), "list").select("data_ids", "data_vectors", "asked_ids", "asked_vectors")
        return _placed(met.mapInArrow(_meet(k, -2.0), _FOUND), k)
    number = found.column("list").to_numpy()
    ids, vectors = found.column("id").to_numpy(), unit(found.column("vector").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("list").to_numpy(zero_copy_only=False)
            for one in np.unique(of):
                part, own = batch.filter(pa.array(of == one)), np.flatnonzero(number == one)
                here = part.column("id").to_numpy(zero_copy_only=False)
                s = _cosines(vectors[own], ids[own], unit(part.column("vector")), here)
                i, j = _kept(s, k, -2.0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own][i]), pa.array(here[j]), pa.array(s[i, j])], ["query", "id", "similarity"])

    wanted = stored.where(F.col("list").isin(sorted({int(x) for x in number})))
    return _placed(wanted.select("list", F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, _FOUND), k)


def pairs_within(rows: DataFrame, scratch: Scratch, group: str, key: str, least: float, vector: str = "embedding") -> DataFrame:
    """(group, a, b, similarity): the pairs of rows of one group of at least that cosine, a < b by ``key``.

    Rows of a group that are nearest to one of a few pivots, which the table's
    own vectors are, go to blocks of about ``PAIR_BLOCK`` vectors; a small group
    is one block. A block knows its least and largest angle to every pivot, and
    by the triangle inequality two blocks whose angles to any pivot lie further
    apart than the threshold's can't hold a pair: they are not compared. All
    other pairs of blocks are, in tiles that are dealt to many tasks, so the
    result is exact; zero vectors are similar to none.
    """
    blocks = pair_blocks(rows, scratch, group, key, vector)
    numbers = blocks.select("group", "cell", "low", "high")
    pairs = scratch.keep(block_pairs(numbers, least), "pairs")

    def block(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
        one = batch.column("rows")[row].values
        return one.field("id").to_numpy(zero_copy_only=False), unit(one.field("v"))

    def meet(batch: pa.RecordBatch, row: int, x: tuple, y: tuple, same: bool) -> pa.RecordBatch:
        (x_ids, a), (y_ids, b) = x, y
        i, j, s = _at_least(a, b, least)
        once = (x_ids[i] < y_ids[j] if same else x_ids[i] != y_ids[j]) & a.any(1)[i] & b.any(1)[j]
        i, j, s = i[once], j[once], s[once]
        low, high = np.minimum(x_ids[i], y_ids[j]), np.maximum(x_ids[i], y_ids[j])
        return pa.RecordBatch.from_arrays([batch.column("group").take(pa.array(np.full(len(i), row, np.int64))), pa.array(low), pa.array(high), pa.array(s)], ["group", "a", "b", "similarity"])

    kind = dict(rows.dtypes)
    dealt = in_tiles(pairs, blocks.select("group", "cell", "rows"))
    return dealt.mapInArrow(meet_in_tiles(block, lambda *met: [meet(*met)]), f"group {kind[group]}, a {kind[key]}, b {kind[key]}, similarity double")


def _at_least(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and cosines of the pairs of unit vectors of at least that cosine: single precision, with room for its rounding, finds those to be looked at."""
    room = (a.shape[1] + 4) * float(np.finfo(np.float32).eps)
    maybe = a.astype(np.float32) @ b.astype(np.float32).T >= least - room
    if np.count_nonzero(maybe) > maybe.size // 64:
        s = a @ b.T
        i, j = np.nonzero(s >= least)
        return i, j, s[i, j]
    i, j = np.nonzero(maybe)
    s = np.einsum("ij,ij->i", a[i], b[j])
    return i[s >= least], j[s >= least], s[s >= least]


class _Places:
    """A block's vectors, the order of their rows, which of them are roots if that is told, and which have an earlier neighbour."""

    def __init__(self, batch: pa.RecordBatch, row: int, told: bool):
        one = batch.column("rows")[row].values
        at = one.field("id")
        self.told, self.group, self.cell = told, batch.column("group").slice(row, 1), batch.column("cell").slice(row, 1)
        self.time = pc.fill_null(pc.cast(at.field("timestamp"), pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        self.id, self.v = at.field("id").to_numpy(zero_copy_only=False), unit(one.field("v"))
        self.hit, self.root = np.zeros(len(self.v), bool), np.ones(len(self.v), bool)
        if told:
            self.root[batch.column("places")[row].values.to_numpy(zero_copy_only=False)] = False

    def look(self, other: _Places, mine: np.ndarray, its: np.ndarray, least: float) -> None:
        """Marks those of ``mine`` that one of the other's ``its`` is near to and comes before."""
        if len(mine) and len(its):
            i, j = _near(self.v[mine], other.v[its], least)
            i, j = mine[i], its[j]
            first = (other.time[j] < self.time[i]) | ((other.time[j] == self.time[i]) & (other.id[j] < self.id[i]))
            self.hit[i[first]] = True

    def found(self) -> list[pa.RecordBatch]:
        at = np.flatnonzero(self.hit)
        again = pa.array(np.zeros(len(at), np.int64))
        return [pa.RecordBatch.from_arrays([self.group.take(again), self.cell.take(again), pa.array(at)], ["group", "cell", "place"])] if len(at) else []


def preceded(blocks: DataFrame, pairs: DataFrame, least: float, told: DataFrame | None = None) -> DataFrame:
    """(group, cell, places): the places in their blocks of rows with an earlier near row, from ``pair_blocks`` whose ``id`` is (timestamp, id).

    With ``told``, such places themselves, it is those of them that have an
    earlier near row that is not of them. However many near rows a row has, a
    tile tells it once.
    """
    rows = blocks.select("group", "cell", "rows")
    if told is not None:
        rows = rows.join(told, ["group", "cell"], "left").withColumn("places", F.coalesce("places", F.array().cast("array<long>")))
    known = told is not None

    def meet(batch: pa.RecordBatch, row: int, x: _Places, y: _Places, same: bool) -> tuple:
        if known:
            for a, b in ((x, y),) if same else ((x, y), (y, x)):
                a.look(b, np.flatnonzero(~a.root), np.flatnonzero(b.root), least)
            return ()
        i, j = _near(x.v, y.v, least)
        y_first = (y.time[j] < x.time[i]) | ((y.time[j] == x.time[i]) & (y.id[j] < x.id[i]))
        x.hit[i[y_first]] = True
        x_first = (x.time[i] < y.time[j]) | ((x.time[i] == y.time[j]) & (x.id[i] < y.id[j]))
        y.hit[j[x_first]] = True
        return ()

    kind = dict(blocks.dtypes)
    found = in_tiles(pairs, rows).mapInArrow(meet_in_tiles(lambda batch, row: _Places(batch, row, known), meet, _Places.found), f"`group` {kind['group']}, cell long, place long")
    return found.groupBy("group", "cell").agg(F.collect_set("place").alias("places"))


def _near(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``_at_least`` without cosines: only those that rounding may change are told in double precision."""
    room = (a.shape[1] + 4) * float(np.finfo(np.float32).eps)
    s = a.astype(np.float32) @ b.astype(np.float32).T
    i, j = np.nonzero(s >= least - room)
    near = s[i, j] >= least + room
    doubt = np.flatnonzero(~near)
    for at in range(0, len(doubt), 4096):
        some = doubt[at : at + 4096]
        near[some] = np.einsum("ij,ij->i", a[i[some]], b[j[some]]) >= least
    return i[near], j[near]


def in_tiles(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(group, left, right, cell, asks, ...): the blocks (group, cell, ...) that tasks need for the pairs (group, from, cell), ``from`` at most ``cell``.

    The pairs of a group's blocks make a square that is cut into tiles of
    ``TILE`` by ``TILE`` blocks. A tile is one task's, in which a block goes once
    and meets up to ``TILE`` others, so blocks are sent that much less often
    than pairs are compared. ``asks`` names the earlier blocks that it meets.
    """
    tile = [F.floor(F.col(c) / TILE).alias(side) for c, side in (("from", "left"), ("cell", "right"))]
    placed = pairs.select("group", "from", "cell", *tile)
    meets = placed.select("group", "left", "right", "cell", F.col("from").alias("ask"))
    held = placed.where("left < right").select("group", "left", "right", F.col("from").alias("cell"), F.lit(None).cast("long").alias("ask"))
    wanted = meets.unionByName(held).groupBy("group", "left", "right", "cell").agg(F.collect_list("ask").alias("asks"))
    sent = blocks.hint("merge").join(wanted, ["group", "cell"])
    names = [c for c in blocks.columns if c not in ("group", "cell")]
    return sent.select("group", "left", "right", "cell", "asks", *names).repartition("group", "left", "right").sortWithinPartitions("group", "left", "right", "cell")


def meet_in_tiles(block, meet, done=lambda own: ()):
    """A task's work on ``in_tiles``: ``block(batch, row)`` reads a block, ``meet(batch, row, earlier, own, same)`` gives the batches of two, and ``done(own)`` those of a block after all it meets in a tile. What is held is a tile's left side."""
    size = TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                group, left, right, cell, asks = (batch.column(c)[row].as_py() for c in ("group", "left", "right", "cell", "asks"))
                if (group, left, right) != tile:
                    for one in held.values():
                        yield from done(one)
                    tile, held = (group, left, right), {}
                own = block(batch, row)
                if cell // size == left:
                    held[cell] = own
                for other in asks:
                    yield from (b for b in meet(batch, row, held[other], own, other == cell) if b.num_rows)
                if cell // size != left:
                    yield from done(own)
        for one in held.values():
            yield from done(one)

    return run


def pair_blocks(rows: DataFrame, scratch: Scratch, group: str, key: str, vector: str) -> DataFrame:
    """(group, cell, rows, low, high): the blocks of each group, with their angles to the pivots."""
    known = rows.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).alias("group"), F.col(key).alias("id"), F.col(vector).alias("v"))
    found = known.select("v").orderBy(F.xxhash64("v")).limit(PIVOTS).toArrow()
    pivots = unit(found.column("v").combine_chunks()) if found.num_rows else np.zeros((0, 1))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = np.arccos(np.clip(unit(batch.column("v")) @ pivots.T, -1, 1))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * angles.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles.argmin(1).astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(angles.ravel()))], [*batch.schema.names, "pivot", "angles"])

    aimed = scratch.keep(known.mapInArrow(aim, f"{', '.join(f'{n} {t}' for n, t in known.dtypes)}, pivot long, angles array<double>".replace("group ", "`group` ")), "aimed")
    counts = aimed.groupBy("group", "pivot").agg(F.count(F.lit(1)).alias("n"))
    # A row for each group and pivot.
    of_group = Window.partitionBy("group")
    before = F.sum("cells").over(of_group.orderBy("pivot").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cells")
    small = F.sum("n").over(of_group) <= PAIR_BLOCK
    cells = counts.withColumn("small", small).withColumn("cells", F.ceil(F.col("n") / PAIR_BLOCK)).withColumn("first", before)
    cells = scratch.keep(cells.select("group", "pivot", "small", "cells", "first"), "cells")
    cell = F.when(F.col("small"), F.lit(0)).otherwise(F.col("first") + F.pmod(F.xxhash64("id"), F.col("cells"))).cast("long").alias("cell")
    dealt = aimed.join(cells, ["group", "pivot"]).select("group", cell, "id", "v", "angles")
    edges = [(F.min if low else F.max)(F.get("angles", F.lit(i))) for low in (True, False) for i in range(len(pivots))]
    blocks = dealt.groupBy("group", "cell").agg(F.collect_list(F.struct("id", "v")).alias("rows"), *(e.alias(f"e{i}") for i, e in enumerate(edges)))
    side = lambda at: F.array(*(F.col(f"e{at + i}") for i in range(len(pivots)))).cast("array<double>")
    return scratch.keep(blocks.select("group", "cell", "rows", side(0).alias("low"), side(len(pivots)).alias("high")), "blocks")


def block_pairs(numbers: DataFrame, least: float) -> DataFrame:
    """(group, from, cell): the pairs of blocks, each with itself too, that may hold a pair of at least that cosine; ``from`` is at most ``cell``."""
    y = numbers.select("group", F.col("cell"), F.col("low").alias("y_low"), F.col("high").alias("y_high"))
    x = numbers.select("group", F.col("cell").alias("from"), "low", "high")
    gap = F.coalesce(F.array_max(F.zip_with(F.zip_with("low", "y_high", lambda a, b: a - b), F.zip_with("y_low", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b))), F.lit(0.0))
    near = gap <= float(np.arccos(np.clip(least, -1, 1))) + _SLACK
    return x.join(y, "group").where((F.col("from") <= F.col("cell")) & near).select("group", "from", "cell")
