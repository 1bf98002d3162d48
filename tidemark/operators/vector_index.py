"""A stored index of vectors: an inverted file over centroids, for many searches of few lists each.

Centroids are fitted on a bounded sample; every row is filed under its nearest
centroid, and lists are folders, so a search reads the lists it names and no
others. How many lists a search needs is measured when the index is built: on
vectors of the sample held against the whole sample, as many lists are read as
reach the wanted recall. What the lists hold is compared exactly, and
``similarity.near`` stays the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .similarity import in_lists, unit

#: Rows that centroids are fitted and recall is measured on, at most; lists at most; rows of the sample that are searched for.
SAMPLE, MOST_LISTS, ASKED = 20_000, 1_024, 400
#: Neighbours and share of them that the number of lists read is chosen for; the rest is for rows outside the sample.
FOR_K, RECALL = 10, 0.97
_ROUNDS = 12


@dataclass
class VectorIndex:
    """Where an index lies, its centroids (a row for each list), and how many lists a search reads."""

    path: str
    centroids: np.ndarray
    probes: int

    def lists(self, vectors: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Numbers of the lists to read for each vector, nearest centroid first."""
        s = vectors @ self.centroids.T
        n = min(probes or self.probes, s.shape[1])
        best = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.argsort(-s, axis=1)
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), 1), 1)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = _ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors, by k-means on angles; an empty list takes the vector that is farthest from its own centroid."""
    rng = np.random.Generator(np.random.PCG64(5))
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        s = sample @ centroids.T
        own, fit = s.argmax(1), s.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(fit)[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.divide(sums, norm, out=centroids.copy(), where=norm > 0)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int = FOR_K, recall: float = RECALL) -> int:
    """Fewest lists whose vectors hold that share of the k nearest of some of the sample's vectors."""
    asked = sample[:: max(1, len(sample) // ASKED)]
    s = asked @ sample.T
    s[np.arange(len(asked)), np.arange(len(asked)) * max(1, len(sample) // ASKED)] = -2
    k = min(k, max(1, len(sample) - 1))
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    order = np.argsort(-(asked @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    needed = np.take_along_axis(place, (sample @ centroids.T).argmax(1)[best], 1)
    return int(np.quantile(needed, recall, method="higher")) + 1


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return unit(vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors)


def _filed(rows: DataFrame, key: str, vector: str, centroids: np.ndarray) -> DataFrame:
    """(list, id, vector) of every row that has a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (_matrix(batch.column("vector")) @ centroids.T).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("id"), batch.column("vector")], ["list", "id", "vector"])

    known = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    return known.mapInArrow(run, f"list int, id {dict(rows.dtypes)[key]}, vector array<float>")


def build(rows: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", lists: int | None = None) -> VectorIndex:
    """Fit, file every row, and store below ``path``; rows without a vector are left out, zero vectors are filed but similar to none. An index of no rows finds nothing.

    The driver sees ``SAMPLE`` vectors at most, chosen by a hash of their keys,
    and ``MOST_LISTS`` centroids; there are about as many lists as the square
    root of the rows. Rows are dealt to files by ranges of (list, key), so a
    large list has several.
    """
    known = rows.where(F.col(vector).isNotNull())
    n = known.count()
    sample = known.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(F.col(vector).cast("array<float>").alias("v"))
    found = _matrix(sample.toArrow().column("v")) if n else np.zeros((0, 0))
    length, found = found.shape[1], found[found.any(1)]
    count = max(1, min(lists or int(n**0.5), MOST_LISTS, len(found)))
    centroids = fit_centroids(found, count) if len(found) else np.zeros((min(n, 1), length))
    probes = probes_for(found, centroids) if len(found) > 1 else 1
    filed = _filed(rows, key, vector, centroids).repartitionByRange("list", "id").sortWithinPartitions("list")
    filed.write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spark = rows.sparkSession
    listed = spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centroids)], "list int, centroid array<double>, probes int")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return VectorIndex(path, centroids, probes)


def append(index: VectorIndex, rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
    """File further rows under the centroids there are."""
    if not len(index.centroids):
        raise ValueError("an index of no rows has no centroids; build it of the rows")
    filed = _filed(rows, key, vector, index.centroids).repartitionByRange("list", "id").sortWithinPartitions("list")
    filed.write.mode("append").partitionBy("list").parquet(f"{index.path}/lists")


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()
    return VectorIndex(path, np.array(rows.column("centroid").to_pylist()), rows.column("probes")[0].as_py())


def search(index: VectorIndex, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query, id, similarity, place): for each query the k most similar other rows of the lists nearest to it."""
    spark = queries.sparkSession
    if not len(index.centroids):
        return spark.createDataFrame([], "query long, id long, similarity double, place int")
    kind = dict(queries.dtypes)[key]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = index.lists(_matrix(batch.column("vector")), probes)
            at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column("id").take(at), batch.column("vector").take(at)], ["list", "id", "vector"])

    known = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    asked = known.mapInArrow(ask, f"list int, id {kind}, vector array<float>")
    stored = spark.read.schema(f"id {kind}, vector array<float>, list int").parquet(f"{index.path}/lists")
    return in_lists(stored, asked, k)
