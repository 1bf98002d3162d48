"""Whitening of embeddings by the exact eigenvalues of their integer scatter.

Components are floored to integers, so their scatter is an exact integer
matrix. Its characteristic polynomial is found modulo many primes (each a Spark
task's work), its roots are isolated exactly, and the components are vectors of
the null spaces, one task for each root (``characteristic``). What the driver
holds is the scatter and the polynomial, whose sizes follow the vectors' length
and not their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared.scratch import Scratch
from .characteristic import RealRoots, coefficient_bound, enough_primes, from_remainders, null_vectors, polynomial_modulo
from .vectors import LEAST, MOST, by_length, floors, usable

#: Units of an entry, and components that are kept. A shift of all entries, as the contract has, changes no difference, so it is left out.
SCALE, COMPONENTS = 64, 32
#: Sums are sent in parts of so many bits, of which very many fit into a long.
_LIMB, _LIMBS = 40, 5
_ROWS = 1024


@dataclass
class Whitening:
    """Rows and sums of the fit list, and its components: eigenvalues of n^2 times the covariance, unit vectors as rows."""

    n: int
    sums: list[int]
    trace: int
    roots: list[Fraction]
    vectors: np.ndarray

    @property
    def length(self) -> int:
        return len(self.sums)

    def explained(self) -> list[float]:
        return [float(r / self.trace) for r in self.roots]


def _products(z: np.ndarray) -> np.ndarray:
    """z' z as exact integers, by the quickest arithmetic that holds them."""
    most = max(int(z.max()), -int(z.min()))
    size = len(z) * most * most
    if size < 1 << 53:
        z = z.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = z if size < 1 << 63 else z.astype(object)
    return (z.T @ z).astype(object)


def _scatter(scale: float):
    """Sums of products of all entries and a one, by vector length: (length, i, j, limb, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, rows in by_length(batch, "vector").items():
                for at in range(0, len(rows), _ROWS):
                    y = floors(batch, "vector", rows[at : at + _ROWS], length, scale)
                    total[length] = total.get(length, 0) + _products(np.concatenate([y, np.ones((len(y), 1), np.int64)], 1))
        for length, sums in total.items():
            i, j = np.triu_indices(length + 1)
            values = sums[i, j]
            for limb in range(_LIMBS):
                part = np.array([(v >> (_LIMB * limb)) & ((1 << _LIMB) - 1) if limb < _LIMBS - 1 else v >> (_LIMB * limb) for v in values], np.int64)
                there = np.flatnonzero(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(there), length, np.int32)), pa.array(i[there].astype(np.int32)), pa.array(j[there].astype(np.int32)), pa.array(np.full(len(there), limb, np.int32)), pa.array(part[there])],
                    ["length", "i", "j", "limb", "value"],
                )

    return run


def scatter(vectors: DataFrame, vector: str = "embedding", scale: float = SCALE) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums, and n times the sum of products less the products of sums: n^2 times the covariance, as exact integers.

    Of vectors of several lengths those of the commonest take part, of equally
    common ones the longest.
    """
    found = vectors.where(usable(vector)).select(F.col(vector).alias("vector")).mapInArrow(_scatter(scale), "length int, i int, j int, limb int, value long")
    sums: dict[int, dict[tuple[int, int], int]] = {}
    for r in found.groupBy("length", "i", "j", "limb").agg(F.sum("value").alias("value")).toArrow().to_pylist():
        cells = sums.setdefault(r["length"], {})
        cells[r["i"], r["j"]] = cells.get((r["i"], r["j"]), 0) + (r["value"] << (_LIMB * r["limb"]))
    if not sums:
        return 0, [], np.zeros((0, 0), object)
    length = max(sums, key=lambda d: (sums[d][d, d], d))
    cells = sums[length]
    n = cells[length, length]
    own = [cells.get((i, length), 0) for i in range(length)]
    out = np.zeros((length, length), object)
    for i in range(length):
        for j in range(i, length):
            out[i, j] = out[j, i] = n * cells.get((i, j), 0) - own[i] * own[j]
    return n, own, out


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(x - matrix), the constant one first; a task takes some of the primes."""
    primes = enough_primes(coefficient_bound(int(matrix.trace()), len(matrix)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("p").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array([polynomial_modulo(matrix, p).tolist() for p in own], pa.list_(pa.int64()))], ["p", "found"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    return from_remainders([(r["p"], r["found"]) for r in dealt.mapInArrow(run, "p long, found array<long>").toArrow().to_pylist()])


def components(spark: SparkSession, matrix: np.ndarray, roots: list[tuple[Fraction, int]]) -> np.ndarray:
    """Unit vectors as rows for each root as often as it occurs; a task takes some of the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = null_vectors(matrix, Fraction(r["root"]), r["count"])
                yield pa.RecordBatch.from_arrays([pa.array([r["place"]] * r["count"], pa.int32()), pa.array(range(r["count"]), pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], ["place", "number", "vector"])

    rows = [(i, str(root), count) for i, (root, count) in enumerate(roots)]
    dealt = spark.createDataFrame(rows, "place int, root string, count int").repartition(min(len(rows), spark.sparkContext.defaultParallelism))
    found = dealt.mapInArrow(run, "place int, number int, vector array<double>").toArrow().sort_by([("place", "ascending"), ("number", "ascending")])
    return np.array(found.column("vector").to_pylist())


def fit(vectors: DataFrame, vector: str = "embedding", scale: float = SCALE, most: int = COMPONENTS) -> Whitening:
    """The ``most`` components of largest eigenvalue; those of eigenvalue zero can't be whitened and are no components."""
    spark = vectors.sparkSession
    n, sums, matrix = scatter(vectors, vector, scale)
    trace = int(matrix.trace()) if len(matrix) else 0
    if not trace:
        return Whitening(n, sums, 0, [], np.zeros((0, len(sums))))
    roots = RealRoots(characteristic_polynomial(spark, matrix)).largest(most)
    each = [root for root, count in roots for _ in range(count)][:most]
    return Whitening(n, sums, trace, each, components(spark, matrix, roots)[:most])


def _whiten(model: Whitening, scale: float):
    """(id, deviation, whitened) of the rows of the model's length."""
    turned = model.vectors.T / np.sqrt(np.array([float(r) for r in model.roots]))
    most = max(map(abs, model.sums), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = by_length(batch, "vector").get(model.length, np.zeros(0, np.int64))
            for at in range(0, len(rows), _ROWS):
                part = rows[at : at + _ROWS]
                y = floors(batch, "vector", part, model.length, scale)
                size = model.n * (max(int(y.max()), -int(y.min())) if y.size else 0) + most
                y = y if size < 1 << 62 else y.astype(object)
                centred = y * model.n - np.array(model.sums, y.dtype)
                square = centred if size * size * max(model.length, 1) < 1 << 63 else centred.astype(object)
                deviation = [min(max(int(x), LEAST), MOST) for x in (square * square).sum(1)]
                flat = pa.array((centred.astype(np.float64) @ turned).ravel())
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(model.roots))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(part)), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["id", "deviation", "whitened"])

    return run


def _centred_products(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"])

    return run


def identity_error(whitened: DataFrame) -> float:
    """Largest entry of the covariance of a column of whitened vectors minus the identity."""
    means = whitened.select(F.posexplode("whitened").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n")).toArrow().sort_by("i")
    if not means.num_rows:
        return 0.0
    mean, n = means.column("mean").to_numpy(), means.column("n")[0].as_py()
    found = whitened.select("whitened").mapInArrow(_centred_products(mean), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    return max(abs(r["value"] / n - (r["i"] == r["j"])) for r in found.toArrow().to_pylist())


def whiten(vectors: DataFrame, scratch: Scratch, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE, most: int = COMPONENTS) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error): a row for each usable vector, with arrays over the components.

    Vectors that are null or hold null or non-finite entries are left out, as
    are those of another length than the commonest (see ``scatter``). Entries
    are floor(``scale`` * entry); entries and deviations beyond a long count as
    its ends. Equal rows, rows of one id and rows without id count each for
    itself. Where all vectors are alike, or there is but one, no component has
    a positive eigenvalue and the arrays are empty; an empty table gives no
    rows. Further columns are ignored.

    The table is read twice, once for the scatter and once to be whitened;
    nothing but sums is shuffled. Work on the driver and in the tasks of primes
    and roots grows with the cube of the vectors' length, which should be a few
    hundred at most.
    """
    model = fit(vectors, vector, scale, most)
    rows = vectors.where(usable(vector)).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    kept = scratch.keep(rows.mapInArrow(_whiten(model, scale), f"id {dict(rows.dtypes)['id']}, deviation long, whitened array<double>"), "whitened")
    explained = F.array(*map(F.lit, model.explained())).cast("array<double>")
    return kept.select("id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(identity_error(kept)).alias("identity_error"))
