"""Importance from frequency, recency and signal, and the fold that keeps memories.

Every row that is kept changes what later rows are compared with, so keeping
is a fold over the rows of a key in order. A row is a repeat if any kept row of
its key is near enough; frequency and recency look back at the newest 100 and
50. The state is one vector for each kept row of a key (a kilobyte at 256
dimensions), and near repeats are never kept. A ``Policy`` may bound it to the
newest rows for keys without end, at the price of forgetting older ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import unpack, with_packed
from ..shared.prefix import prefix_sums
from ..shared.scratch import Scratch
from .similarity import block_pairs, in_tiles, meet_in_tiles, pair_blocks, preceded, unit

#: Weights, limits and rows looked back at.
W_FREQUENCY, W_RECENCY, W_SIGNAL = 0.3, 0.3, 0.4
SIMILAR, FREQUENT, LOOK_FREQUENCY, LOOK_RECENCY, DECAY_HOURS, FLOOR = 0.5, 5.0, 100, 50, 24.0, 0.75
#: Rows of a block where a key's rows are compared by many tasks.
FOLD_BLOCK = 1024
#: Blocks of a key whose bits of similar rows take less than a row's vector does, about; keys of more blocks are large.
BITS = 8
#: Undecided rows of a key that one task decides in order, at most.
FINISH = 4096
#: Signal by kind of event, else by type of memory.
SIGNAL_OF_KIND = {"UserCorrection": 1.0, "ErrorFixed": 0.8, "manual": 0.8, "GitCommit": 0.6}
SIGNAL_OF_TYPE = {"feedback": 1.0, "security": 0.9, "decision": 0.7, "session_summary": 0.5, "note": 0.4}

@dataclass(frozen=True)
class Policy:
    """What a path of intake does with its rows; ``history`` bounds the kept rows that are looked back at."""

    dedup: float | None = 0.92
    score: bool = True
    threshold: float | None = 0.4
    history: int | None = None

    def drops(self, score: float) -> bool:
        return self.threshold is not None and bool(np.float32(score) < np.float32(self.threshold))


#: Batches of events; corrections, which pass at once; single saves, by hand or by a tool, which keep what scores low; rebuilding.
BATCH, URGENT, SAVE, BACKFILL = Policy(), Policy(None, False, None), Policy(threshold=None), Policy(None, False, None)
#: Kinds of event that a save by hand and one by a tool have: the first has a signal of its own, the second that of its type.
BY_HAND, BY_TOOL = "manual", "mcp"


def signal(kind: Column, memory_type: Column) -> Column:
    out = F.lit(None).cast("double")
    for names, column in ((SIGNAL_OF_TYPE, memory_type), (SIGNAL_OF_KIND, kind)):
        found = F.when(F.lit(False), 0.0)
        for name, value in names.items():
            found = found.when(column == name, value)
        out = F.coalesce(found, out)
    return F.coalesce(out, F.lit(SIGNAL_OF_TYPE["note"]))


def combine(frequency: Column, recency: Column, strength: Column) -> Column:
    """The weighted sum; a topic without any similar row keeps a share of its signal."""
    score = W_FREQUENCY * frequency + W_RECENCY * recency + W_SIGNAL * strength
    score = F.when((frequency == 0) & (recency == 0), F.greatest(score, FLOOR * strength)).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


class History:
    """Kept rows of one key, oldest first, as vectors and times."""

    def __init__(self, most: int | None = None):
        self.most, self.n, self.vectors, self.times = most, 0, None, np.zeros(0, np.int64)

    def load(self, vectors: np.ndarray, times: np.ndarray) -> None:
        self.n, self.vectors, self.times = len(times), vectors.copy(), times.copy()

    def add(self, vector: np.ndarray, time: int) -> None:
        if self.vectors is None:
            self.vectors, self.times = np.zeros((16, len(vector)), np.float32), np.zeros(16, np.int64)
        if self.most is not None and self.n >= 2 * self.most:
            self.vectors[: self.most], self.times[: self.most] = self.vectors[self.n - self.most : self.n].copy(), self.times[self.n - self.most : self.n].copy()
            self.n = self.most
        if self.n == len(self.times):
            self.vectors, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.vectors, self.times))
        self.vectors[self.n], self.times[self.n] = vector, time
        self.n += 1

    def kept(self) -> tuple[np.ndarray | None, np.ndarray]:
        """Vectors and times, the newest ``most`` of them."""
        first = max(0, self.n - self.most) if self.most is not None else 0
        return (None if self.vectors is None else self.vectors[first : self.n]), self.times[first : self.n]

    def similar(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and times, newest first; a zero vector is similar to none."""
        vectors, times = self.kept()
        if vectors is None:
            return np.zeros(0), np.zeros(0, np.int64)
        return (vectors @ vector)[::-1], times[::-1]


def judge(history: History, vector: np.ndarray, time: int, strength: float, policy: Policy) -> tuple[str, float | None]:
    """Outcome and score of the next row: saved, deduped or low_importance. ``time`` is in microseconds."""
    near, times = history.similar(vector)
    if policy.dedup is not None and len(near) and near.max() >= policy.dedup:
        return "deduped", None
    score = None
    if policy.score:
        recent = times[:LOOK_RECENCY][near[:LOOK_RECENCY] >= SIMILAR]
        score = weigh(int((near[:LOOK_FREQUENCY] >= SIMILAR).sum()), int(recent.max()) if len(recent) else None, time, strength)
        if policy.drops(score):
            return "low_importance", score
    history.add(vector, time)
    return "saved", score


def weigh(often: int, newest: int | None, time: int, strength: float) -> float:
    """The score of a row with so many similar ones among the kept rows looked back at, the newest at that time (microseconds)."""
    frequency = min(1.0, often / FREQUENT)
    recency = 0.0 if newest is None else math.exp(-((time - newest) // 60_000_000 / 60) / DECAY_HOURS)
    score = W_FREQUENCY * frequency + W_RECENCY * recency + W_SIGNAL * strength
    if frequency == 0 and recency == 0:
        score = max(score, FLOOR * strength)
    return min(1.0, max(0.0, score))


def fold(rows: DataFrame, key: str, policy: Policy = BATCH) -> DataFrame:
    """(id, key, outcome, score) of each row of (id, key, timestamp, strength, embedding), in order of (timestamp, id).

    Rows are dealt by key and sorted; a task streams them and holds one key's
    history. Keys run in parallel, and no key's rows are gathered. A key is one
    stream, as the fate of a row depends on that of all before it, so keys
    should be fine enough. Embeddings are sorted packed, so that a task's rows
    take no more memory than they take bytes in the shuffle.
    """
    dealt = with_packed(rows.select("id", key, "timestamp", "strength", "embedding")).repartition(key).sortWithinPartitions(key, "timestamp", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, history = object(), History(policy.history)
        for batch in batches:
            times = pc.cast(batch.column("timestamp"), pa.int64()).to_pylist()
            keys, strengths = batch.column(key).to_pylist(), batch.column("strength").to_pylist()
            outcomes, scores, vectors = [], [], unpack(batch.column("embedding").to_pylist())
            for i, at in enumerate(keys):
                if at != own:
                    own, history = at, History(policy.history)
                outcome, score = judge(history, vectors[i], times[i], strengths[i], policy)
                outcomes.append(outcome)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column(key), pa.array(outcomes, pa.string()), pa.array(scores, pa.float64())], ["id", key, "outcome", "score"])

    kind = dict(rows.dtypes)
    return dealt.mapInArrow(run, f"id {kind['id']}, {key} {kind[key]}, outcome string, score double")


def _looks(policy: Policy, size: int):
    """What each vector of a block has in another: (group, w, seen, similar, repeats), a bit for each vector of the block seen, of that cosine and of near-repeats.

    Vectors look at blocks before their own and at their own block; those of
    several rows look at later blocks too, as rows may lie between theirs. A
    large key's rows bring their vectors, so it has no bits of that cosine.
    """

    def seen(batch: pa.RecordBatch, row: int, s: np.ndarray, mine: int, other: int, wanted: np.ndarray) -> pa.RecordBatch:
        brief = policy.score and not batch.column("large")[row].as_py()
        similar = s >= SIMILAR if brief else np.zeros((len(s), 0), bool)
        repeat = s >= policy.dedup if policy.dedup is not None else np.zeros(s.shape, bool)
        at = np.flatnonzero((similar.any(1) | repeat.any(1)) & wanted)
        bits = lambda x: pa.array([b.tobytes() for b in np.packbits(x[at], axis=1)], pa.binary())
        columns = [batch.column("group").take(pa.array(np.full(len(at), row, np.int64))), pa.array(mine * size + at), pa.array(np.full(len(at), other, np.int64)), bits(similar), bits(repeat)]
        return pa.RecordBatch.from_arrays(columns, ["group", "w", "seen", "similar", "repeats"])

    def block(batch: pa.RecordBatch, row: int) -> tuple[int, np.ndarray, np.ndarray]:
        v = batch.column("v")[row].values
        return batch.column("cell")[row].as_py(), v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(v), -1), batch.column("many")[row].values.to_numpy(zero_copy_only=False)

    def meet(batch: pa.RecordBatch, row: int, x: tuple, y: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        (earlier, other, many), (later, mine, _) = x, y
        s = mine @ other.T
        yield seen(batch, row, s, later, earlier, np.ones(len(mine), bool))
        if not same:
            yield seen(batch, row, s.T, earlier, later, many)

    return meet_in_tiles(block, meet)


class _Kept:
    """The kept rows of a key without their vectors: the number of each one's vector, its time, and the newest kept row of each vector."""

    def __init__(self, size: int):
        self.size = size
        self.n, self.of, self.times, self.newest = 0, np.zeros(64, np.int64), np.zeros(64, np.int64), np.full(64, -1, np.int64)

    def add(self, w: int, time: int) -> None:
        if self.n == len(self.of):
            self.of, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.of, self.times))
        if w >= len(self.newest):
            self.newest = np.concatenate([self.newest, np.full(max(len(self.newest), w + 1 - len(self.newest)), -1, np.int64)])
        self.of[self.n], self.times[self.n], self.newest[w] = w, time, self.n
        self.n += 1

    def repeated(self, looks: dict, history: int | None) -> bool:
        """Whether a near-repeat is among the kept rows, the newest ``history`` of them."""
        least = 0 if history is None else max(0, self.n - history)
        for block, (_, bits) in looks.items():
            own = self.newest[block * self.size : (block + 1) * self.size]
            if (own[np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[: len(own)])] >= least).any():
                return True
        return False

    def similar(self, looks: dict, back: int) -> np.ndarray:
        """Numbers, from the oldest, of the similar ones among the newest ``back`` kept rows."""
        first = max(0, self.n - back)
        block, within = np.divmod(self.of[first : self.n], self.size)
        found = np.zeros(len(block), bool)
        for one in set(block.tolist()) & looks.keys():
            here = np.flatnonzero(block == one)
            bits = np.frombuffer(looks[one][0], np.uint8)
            found[here] = bits[within[here] >> 3] >> (7 - (within[here] & 7)) & 1
        return first + np.flatnonzero(found)


def fold_in_blocks(rows: DataFrame, key: str, scratch: Scratch, policy: Policy = BATCH, size: int = FOLD_BLOCK) -> DataFrame:
    """The same rows as ``fold``, with the vectors of a key compared by many tasks.

    Rows are numbered within their key (prefix sums over ranges), and so are
    the key's different vectors, in the order of their first rows; however
    often a vector comes, it is compared once. Vectors are packed into blocks
    of ``size``. Every block meets itself and all earlier ones of its key, in
    tiles (``in_tiles``), and leaves for each of its vectors that has one a bit
    for every near-repeat in the other block. Through each key in order go
    these bits, the times, and what finds similar rows among the newest kept
    ones: bits too for a key of up to ``BITS`` blocks, and for a larger one the
    row's vector, which costs the same however large the key is. What is held is the
    vectors of the newest kept rows that are looked back at, and no lists.
    """
    told = F.coalesce("embedding", F.array().cast("array<float>")) if policy.dedup is not None or policy.score else F.array().cast("array<float>")
    named = rows.select("id", key, "timestamp", "strength", told.alias("embedding"), F.to_json(F.struct(F.col(key))).alias("group"))
    # Written first, as dealing by ranges goes through its rows twice. 128 bits tell a vector.
    named = scratch.keep(named.withColumns({"d1": F.xxhash64("embedding"), "d2": F.xxhash64(F.lit(1), "embedding")}), "named")
    numbered = scratch.keep(prefix_sums(scratch, named, ["group"], [F.col("timestamp"), F.col("id")], F.lit(1).cast("long"), "ranged", "n"), "numbered")
    scratch.drop("named", "ranged")
    vectors = numbered.groupBy("group", "d1", "d2", "embedding").agg(F.min("n").alias("first"), (F.count(F.lit(1)) > 1).alias("many"))
    vectors = scratch.keep(prefix_sums(scratch, vectors, ["group"], [F.col("first")], F.lit(1).cast("long"), "firsts", "w"), "vectors")
    scratch.drop("firsts")
    large = scratch.keep(vectors.where(F.col("w") == BITS * size).select("group"), "large")
    block = F.floor(F.col("w") / size).alias("cell")
    blocks = vectors.groupBy("group", block).agg(F.sort_array(F.collect_list(F.struct("w", "many", F.col("embedding").alias("v")))).alias("rows")).select("group", "cell", F.col("rows.v").alias("v"), F.col("rows.many").alias("many"))
    blocks = scratch.keep(blocks.join(large.withColumn("large", F.lit(True)), "group", "left").withColumn("large", F.coalesce("large", F.lit(False))), "blocks")
    numbers = blocks.select("group", "cell", "large")
    numbers = numbers if policy.dedup is not None else numbers.where(~F.col("large"))
    pairs = numbers.select("group", F.explode(F.sequence(F.lit(0).cast("long"), "cell")).alias("from"), "cell")
    looks = in_tiles(pairs, blocks).mapInArrow(_looks(policy, size), "group string, w long, seen long, similar binary, repeats binary")
    looks = scratch.keep(looks, "looks")
    facts = ["group", "n", "id", key, "timestamp", "strength"]
    placed = numbered.select(*facts, "d1", "d2").join(vectors.select("group", "d1", "d2", "w"), ["group", "d1", "d2"])
    told = placed.select(*facts, "w").join(looks, ["group", "w"], "left")
    if policy.score:
        # A row for each row of a large key, beside those with its bits.
        told = told.unionByName(numbered.join(large, "group", "left_semi").select(*facts, "embedding"), allowMissingColumns=True)
    else:
        told = told.withColumn("embedding", F.lit(None).cast("array<float>"))
    dealt = told.select(*facts, "w", "seen", "similar", "repeats", "embedding").repartition("group").sortWithinPartitions("group", "n", "seen")
    kind = dict(rows.dtypes)
    back = LOOK_FREQUENCY if policy.history is None else min(LOOK_FREQUENCY, policy.history)

    def decide(kept: _Kept, newest: History, row: dict, looks: dict) -> tuple[str, float | None]:
        if kept.repeated(looks, policy.history):
            return "deduped", None
        score, vector = None, row["embedding"]
        if policy.score:
            if vector is None:
                near = kept.similar(looks, back)
                often, last = len(near), int(kept.times[near[-1]]) if len(near) and near[-1] >= kept.n - LOOK_RECENCY else None
            else:
                cosines, times = newest.similar(vector)
                recent = times[:LOOK_RECENCY][cosines[:LOOK_RECENCY] >= SIMILAR]
                often, last = int((cosines >= SIMILAR).sum()), int(recent.max()) if len(recent) else None
            score = weigh(often, last, row["time"], row["strength"])
            if policy.drops(score):
                return "low_importance", score
        kept.add(row["w"], row["time"])
        if vector is not None:
            newest.add(vector, row["time"])
        return "saved", score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is told of a row follows each other, maybe into the next batch; it is decided when the next row begins."""
        own, kept, newest, row, looks = object(), _Kept(size), History(back), None, {}
        for batch in batches:
            ids, keys, outcomes, scores = [], [], [], []
            place = list(zip(batch.column("group").to_pylist(), batch.column("n").to_pylist(), strict=True))
            seen, similar, repeats, numbers = (batch.column(c).to_pylist() for c in ("seen", "similar", "repeats", "w"))
            told = {c: batch.column(c).to_pylist() for c in ("id", key, "strength")}
            times = pc.cast(batch.column("timestamp"), pa.int64()).to_pylist()
            lists = batch.column("embedding")
            vectors, ends, there = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist(), lists.is_valid().to_pylist()
            for i in range(len(place)):
                if row is None or place[i] != row["place"]:
                    if row:
                        outcome, score = decide(kept, newest, row, looks)
                        for to, value in zip((ids, keys, outcomes, scores), (row["id"], row[key], outcome, score), strict=True):
                            to.append(value)
                    if place[i][0] != own:
                        own, kept, newest = place[i][0], _Kept(size), History(back)
                    row, looks = {c: v[i] for c, v in told.items()} | {"place": place[i], "time": times[i], "w": None, "embedding": None}, {}
                if there[i]:
                    row["embedding"] = vectors[ends[i] : ends[i + 1]].copy()
                if numbers[i] is not None:
                    row["w"] = numbers[i]
                if seen[i] is not None:
                    looks[seen[i]] = similar[i], repeats[i]
            yield made(batch, ids, keys, outcomes, scores)
            shape = batch
        if row:
            outcome, score = decide(kept, newest, row, looks)
            yield made(shape, [row["id"]], [row[key]], [outcome], [score])

    def made(batch: pa.RecordBatch, ids: list, keys: list, outcomes: list, scores: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(keys, batch.column(key).type), pa.array(outcomes, pa.string()), pa.array(scores, pa.float64())], ["id", key, "outcome", "score"])

    return dealt.mapInArrow(run, f"id {kind['id']}, {key} {kind[key]}, outcome string, score double")


def keep_first(rows: DataFrame, scratch: Scratch, key: str, least: float = Policy.dedup) -> DataFrame:
    """(id, key, outcome) of rows (id, key, timestamp, embedding): saved, or deduped by an earlier saved row of the key.

    The fold without scores, as sets, so no large key is one stream. Of a key's
    undecided rows those without an earlier neighbour among them are saved, and
    later neighbours of these are not; each is a join of blocks (``preceded``)
    that tells a row once and lists no pairs, whose number grows with the
    square of a group of near rows. The rest goes to the next round, until up
    to ``FINISH`` rows of a key are left, which one task decides in order. A
    later row of an equal vector shares the fate of a repeat, so only the first
    of equal vectors take part in the comparison.
    """
    at = F.struct("timestamp", "id")
    zero = F.exists("embedding", lambda x: x != 0)
    rows = scratch.keep(rows.select("id", key, "timestamp", "embedding"), "rows")
    same = rows.withColumn("_digest", F.xxhash64("embedding"))
    first = same.groupBy(key, "_digest", "embedding").agg(F.min(at).alias("at")).select(F.col(key).alias("group"), "at", F.col("embedding").alias("v"))
    first = scratch.keep(first, "first")
    # Rows that take no part: without a key or a vector, or of zeros.
    apart = F.col("group").isNull() | F.col("v").isNull() | ~F.exists("v", lambda x: x != 0)
    kept, step, left = [first.where(apart).select("at.id")], 0, first.where(~apart)
    while True:
        large = scratch.keep(left.groupBy("group").count().where(F.col("count") > FINISH).select("group"), f"large{step}")
        kept.append(scratch.keep(_first_in_order(left.join(large, "group", "left_anti"), least), f"last{step}"))
        if large.isEmpty():
            break
        # Blocks are made anew of what is left; a row is known by its block and its place there.
        blocks = pair_blocks(left.join(large, "group", "left_semi"), Scratch(scratch.spark, "round", f"{scratch.path}/round{step}"), "group", "at", "v")
        pairs = scratch.keep(block_pairs(blocks.select("group", "cell", "low", "high"), least), f"pairs{step}")
        late = scratch.keep(preceded(blocks, pairs, least), f"late{step}")
        gone = scratch.keep(preceded(blocks, pairs, least, late), f"gone{step}")
        each = blocks.join(late, ["group", "cell"], "left").join(gone.withColumnRenamed("places", "gone"), ["group", "cell"], "left").select("group", "places", "gone", F.posexplode("rows").alias("place", "row"))
        among = lambda c: F.coalesce(F.array_contains(c, F.col("place").cast("long")), F.lit(False))
        kept.append(scratch.keep(each.where(~among("places")).select("row.id.id"), f"kept{step}"))
        left = scratch.keep(each.where(among("places") & ~among("gone")).select("group", F.col("row.id").alias("at"), "row.v"), f"left{step}")
        scratch.drop(f"round{step}", *([f"left{step - 1}"] if step else []))
        step += 1
    saved = reduce(DataFrame.unionByName, kept).withColumn("_kept", F.lit(True))
    out = rows.join(saved, "id", "left")
    # A zero vector is never a repeat, not of itself either.
    return out.select("id", key, F.when(F.col("_kept") | ~zero, "saved").otherwise("deduped").alias("outcome"))


def _first_in_order(rows: DataFrame, least: float) -> DataFrame:
    """(id) of the rows (group, at, v) without an earlier such row that is near; a task holds one group's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, n = object(), np.zeros((0, 0)), 0
        for batch in batches:
            groups, vectors, saved = batch.column("group").to_pylist(), unit(batch.column("v")), []
            for i, at in enumerate(groups):
                if at != own:
                    own, held, n = at, np.zeros((64, vectors.shape[1])), 0
                if not n or (held[:n] @ vectors[i]).max() < least:
                    if n == len(held):
                        held = np.concatenate([held, np.zeros_like(held)])
                    held[n], n = vectors[i], n + 1
                    saved.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(saved, pa.int64()))], ["id"])

    told = rows.select("group", "at.timestamp", "at.id", "v").repartition("group").sortWithinPartitions("group", "timestamp", "id")
    return told.mapInArrow(run, f"id {dict(told.dtypes)['id']}")


def outcomes(folded: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(outcome, n): rows saved, deduped and of low importance, and rows of ``dropped`` as skipped."""
    each = folded.select("outcome")
    if dropped is not None:
        each = each.unionByName(dropped.select(F.lit("skipped").alias("outcome")))
    return each.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
