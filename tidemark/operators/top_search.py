"""The best rows of a search without reading the whole lists of its terms.

Rows are cut into bands of similar length, and the index keeps, for each term
and band, the number of rows and the best that the term adds to a score there.
A band's bound is the sum over the terms. The bands of the highest bounds are
scored first; the n-th best score found is a score to beat, and only bands whose
bounds reach it are read then. What is left out can't be among the best, so the
rows are those of a search through everything.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared.ranges import stretches
from ..shared.scratch import Scratch
from .search import K1, LEAST_IDF, B, Match, best, dealt, parts_of, postings, times, tokens

#: Bands of rows of about the same length, and bytes of a row group, so that a band of a term is few of them.
BANDS, GROUP_BYTES = 64, 1 << 20


def write_bands(rows: DataFrame, key: str, columns: tuple[str, ...], path: str, bands: int = BANDS) -> None:
    """Store each term's rows by band, sorted, and each band's bounds.

    A term of very many rows has several files, in each of which a band is found
    by its place.
    """
    scratch = Scratch(rows.sparkSession, "bands")
    length = reduce(lambda a, b: a + b, (F.size(tokens(F.col(c))) for c in columns))
    sizes = scratch.keep(rows.select(length.alias("length")), "sizes")
    facts = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    band = stretches(sizes, "length", bands).cast("int").alias("band")
    found = postings(rows, key, columns)
    counted = found.select("term", band, key, "length", times(found).cast("long").alias("tf"))
    dealt(counted, key, "band").write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/rows")
    tf, part = F.col("tf"), K1 * (1 - B + B * F.col("length") / F.lit(float(facts["mean"] or 1.0)))
    bounds = rows.sparkSession.read.parquet(f"{path}/rows").groupBy("term", "band").agg(F.count(F.lit(1)).alias("rows"), F.max(tf * (K1 + 1) / (tf + part)).alias("most"))
    bounds.repartitionByRange("term", "band").sortWithinPartitions("term", "band").write.mode("overwrite").parquet(f"{path}/bounds")
    rows.sparkSession.createDataFrame([(facts["n"], facts["mean"])], "n long, mean double").write.mode("overwrite").parquet(f"{path}/facts")
    scratch.drop("sizes")


class TopSearch:
    """One search of single words over a stored index of bands."""

    def __init__(self, spark: SparkSession, path: str, match: Match, key: str, n: int):
        self.match, self.key, self.n = match, key, n
        terms = match.all_of + match.any_of + match.none_of
        if any(t.prefix or t.column or len(parts_of(t)) > 1 for t in terms):
            raise ValueError("phrases, prefixes and columns are searched for by search.lookup")
        self.words = [parts_of(t)[0] for t in terms]
        self.rows = spark.read.parquet(f"{path}/rows").where(F.col("term").isin(self.words))
        self.facts = spark.read.parquet(f"{path}/facts").first().asDict()
        #: For each word its bands: rows and most; at most as many as there are words and bands.
        self.bounds: dict[str, dict[int, tuple[int, float]]] = {w: {} for w in self.words}
        for r in spark.read.parquet(f"{path}/bounds").where(F.col("term").isin(self.words)).collect():
            self.bounds[r["term"]][r["band"]] = (r["rows"], r["most"])
        self.facts |= {f"n{i}": sum(rows for rows, _ in self.bounds[w].values()) for i, w in enumerate(self.words)}
        self.read: set[int] = set()

    def bands(self) -> dict[int, tuple[float, int]]:
        """Bands that can hold a hit: the bound of their scores, a little above it for rounding, and rows of their commonest word."""
        a, b = len(self.match.all_of), len(self.match.all_of) + len(self.match.any_of)
        idf = [max(math.log((self.facts["n"] - have + 0.5) / (have + 0.5)), LEAST_IDF) for have in (self.facts[f"n{i}"] for i in range(b))]
        every = {x for w in self.words[:b] for x in self.bounds[w]}
        fits = lambda x: all(x in self.bounds[w] for w in self.words[:a]) and (a == b or any(x in self.bounds[w] for w in self.words[a:b]))
        own = lambda x: [(i, *self.bounds[w][x]) for i, w in enumerate(self.words[:b]) if x in self.bounds[w]]
        return {x: (sum(idf[i] * most for i, _, most in own(x)) * (1 + 1e-9), max(rows for _, rows, _ in own(x))) for x in every if fits(x)}

    def _scored(self, bands: list[int]) -> DataFrame:
        self.read |= set(bands)
        tf = [F.max(F.when(F.col("term") == w, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, w in enumerate(self.words)]
        return best(self.rows.where(F.col("band").isin(bands)).groupBy(self.key, "length").agg(*tf), self.match, self.key, self.n, self.facts)

    def run(self) -> DataFrame:
        """(key, score) of the n best rows, as ``search.search`` gives them."""
        bands = self.bands()
        order, first, rows = sorted(bands, key=lambda x: -bands[x][0]), [], 0
        while order and rows < self.n:
            first.append(order.pop(0))
            rows += bands[first[-1]][1]
        found = self._scored(first)
        scores = [r["score"] for r in found.collect()]  # n rows at most
        beat = scores[-1] if len(scores) == self.n else -math.inf
        rest = [x for x in order if bands[x][0] >= beat]
        return self._scored(first + rest) if rest else found
