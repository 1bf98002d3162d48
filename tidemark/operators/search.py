"""Ranked full-text search over title, content and tags, and its merge with vector hits.

A search either reads a stored index (``write_index``, ``lookup``), of which it
needs the rows of its terms only, or goes through the texts once (``search``).
Both give the same scores.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..shared.scratch import Scratch

#: Fixed values of the ranking.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Words that a task gathers at once, about, and tasks that the rows of one term are dealt to.
WORDS, SHARES = 1 << 19, 8


def _unaccented() -> dict[str, str]:
    """Latin letters with a mark, and the letters below the marks."""
    found = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250)}
    return {c: b for c, b in found.items() if b != c and b.isascii()}


MARKED, PLAIN = ("".join(x) for x in zip(*_unaccented().items(), strict=True))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-case and without marks."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    plain = F.when(F.octet_length(lower) > F.char_length(lower), F.translate(lower, MARKED, PLAIN)).otherwise(lower)
    return F.filter(F.split(plain, r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")


@dataclass(frozen=True)
class Term:
    """A word, a phrase of several words, or a prefix; in one column if that is named."""

    text: str
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Match:
    """What a text must hold: all of these, any of those where given, none of the last."""

    all_of: tuple[Term, ...] = ()
    any_of: tuple[Term, ...] = ()
    none_of: tuple[Term, ...] = ()

    def __post_init__(self):
        if not self.all_of and not self.any_of:
            raise ValueError("a search needs a term to look for")


def parts_of(term: Term) -> list[str]:
    parts = term.text.lower().translate(str.maketrans(MARKED, PLAIN)).split()
    if not parts:
        raise ValueError("an empty term")
    return parts


def _occurrences(words: Column, term: Term) -> Column:
    parts = parts_of(term)
    if len(parts) == 1:
        hit = lambda w: w.startswith(parts[0]) if term.prefix else w == parts[0]
        return F.size(F.filter(words, hit))
    last = len(parts) - 1

    def stands(w: Column, i: Column) -> Column:
        rest = [F.get(words, i + j) for j in range(1, len(parts))]
        ends = [r.startswith(p) if term.prefix and j == last else r == p for j, (r, p) in enumerate(zip(rest, parts[1:], strict=True), 1)]
        return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), ends, w == parts[0])

    return F.size(F.filter(words, stands))


def search(rows: DataFrame, match: Match, key: str, columns: tuple[str, ...], n: int) -> DataFrame:
    """The n best rows: (key, score), higher is better.

    One pass counts, for each row, its tokens and the occurrences of each term.
    Rows with a term are written, and what is observed on the way, over all
    rows, are their number, their average length and each term's frequency.
    """
    terms = match.all_of + match.any_of + match.none_of
    words = rows.select(F.col(key), *(tokens(F.col(c)).alias(f"_{c}") for c in columns))
    count = lambda t: reduce(lambda a, b: a + b, (_occurrences(F.col(f"_{c}"), t) for c in columns if t.column in (None, c)))
    length = reduce(lambda a, b: a + b, (F.size(f"_{c}") for c in columns))
    counted = words.select(key, length.alias("length"), *(count(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    seen = Observation()
    counted = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *_frequencies(terms))
    held = reduce(lambda a, b: a | b, (F.col(f"tf{i}") > 0 for i in range(len(terms))))
    counted = Scratch(rows.sparkSession, "search").keep(counted.where(held), "counted")
    return best(counted, match, key, n, seen.get)


def _frequencies(terms: tuple[Term, ...]) -> list[Column]:
    return [F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"n{i}") for i in range(len(terms))]


def best(counted: DataFrame, match: Match, key: str, n: int, facts: dict) -> DataFrame:
    """The n best of the rows (key, length, tf0, tf1, ...), with the numbers and the mean length of all rows at hand."""
    terms = match.all_of + match.any_of + match.none_of
    score = F.lit(0.0)
    for i in range(len(match.all_of) + len(match.any_of)):
        have = facts[f"n{i}"]
        idf = max(math.log((facts["n"] - have + 0.5) / (have + 0.5)), LEAST_IDF) if facts["n"] else 0.0
        tf = F.col(f"tf{i}")
        score = score + F.when(tf > 0, F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(facts["mean"] or 1.0)))).otherwise(0.0)
    a, b = len(match.all_of), len(match.all_of) + len(match.any_of)
    wanted = reduce(lambda x, y: x & y, (F.col(f"tf{i}") > 0 for i in range(a)), F.lit(True))
    if match.any_of:
        wanted = wanted & reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(a, b)))
    wanted = reduce(lambda x, y: x & y, (F.col(f"tf{i}") == 0 for i in range(b, len(terms))), wanted)
    return counted.where(wanted).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(n)


def postings(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(term, key, length, at): a row for each term of each row; length is that of the row, all columns, and ``at`` has the term's places in each column."""
    words = rows.select(F.col(key), *(tokens(F.col(c)).alias(c) for c in columns if c != key))
    places = ", ".join(f"`{c}`: array<int>" for c in columns)
    return words.mapInArrow(_gathered(key, columns), f"term string, `{key}` {dict(rows.dtypes)[key]}, length int, at struct<{places}>")


def _gathered(key: str, columns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = sum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
            # Some rows at a time, as what a task holds follows their words.
            bounds = np.unique(np.concatenate([[0], 1 + np.flatnonzero(np.diff(np.cumsum(length) // WORDS)), [batch.num_rows]]))
            for start, end in itertools.pairwise(bounds.tolist()):
                yield _places(batch.slice(start, end - start), length[start:end], key, columns)

    return run


def _places(batch: pa.RecordBatch, length: np.ndarray, key: str, columns: tuple[str, ...]) -> pa.RecordBatch:
    """A row for each term of each row of the batch."""
    flat, row, place, column = [], [], [], []
    for i, c in enumerate(columns):
        sizes = pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64)
        flat.append(pc.list_flatten(batch.column(c)))
        row.append(np.repeat(np.arange(len(sizes)), sizes))
        place.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        column.append(np.full(sizes.sum(), i))
    terms = pa.concat_arrays(flat).dictionary_encode()
    row, place, column = (np.concatenate(x) for x in (row, place, column))
    one = row * max(len(terms.dictionary), 1) + terms.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(one, kind="stable")  # places of a column stay in their order
    one, place, column = one[order], place[order], column[order]
    first = np.ones(len(one), bool)
    first[1:] = one[1:] != one[:-1]
    group, own = np.cumsum(first) - 1, one[first]
    at = []
    for i in range(len(columns)):
        ends = np.cumsum(np.bincount(group[column == i], minlength=len(own)))
        at.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(place[column == i].astype(np.int32))))
    held = own // max(len(terms.dictionary), 1)
    return pa.RecordBatch.from_arrays(
        [terms.dictionary.take(pa.array(own % max(len(terms.dictionary), 1))), batch.column(key).take(pa.array(held)), pa.array(length[held].astype(np.int32)), pa.StructArray.from_arrays(at, list(columns))],
        ["term", key, "length", "at"],
    )


def columns_of(index: DataFrame) -> list[str]:
    """Columns that an index has places of."""
    return index.schema["at"].dataType.names


def times(index: DataFrame, column: str | None = None) -> Column:
    """How often a term stands in a row, or in one column of it."""
    names = columns_of(index) if column is None else [c for c in columns_of(index) if c == column]
    return reduce(lambda a, b: a + b, (F.size(F.col("at")[c]) for c in names), F.lit(0))


def dealt(found: DataFrame, key: str, *order: str) -> DataFrame:
    """Postings dealt to tasks by term and sorted by it, a term of very many rows to ``SHARES`` tasks.

    Dealing by hash needs no sample of the terms, for which each text would be split once more.
    """
    return found.repartition("term", F.pmod(F.xxhash64(key), F.lit(SHARES))).sortWithinPartitions("term", *order)


def write_index(rows: DataFrame, key: str, columns: tuple[str, ...], path: str) -> None:
    """Store the postings below ``path``, sorted by term so that a search reads few row groups, and a row of facts: n, mean, and whether each row has a key of its own."""
    dealt(postings(rows, key, columns), key).write.mode("overwrite").parquet(f"{path}/postings")
    index = rows.sparkSession.read.parquet(f"{path}/postings")
    places = index.agg(F.coalesce(F.sum(times(index)), F.lit(0)).alias("places"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys")).join(F.broadcast(places))  # one row each
    facts = facts.select("n", F.when(F.col("n") > 0, F.col("places") / F.col("n")).alias("mean"), (F.col("n") == F.col("keys")).alias("keyed"))
    facts.write.mode("overwrite").parquet(f"{path}/facts")


def term_frequencies(index: DataFrame, key: str, keyed: bool = False) -> DataFrame:
    """(term, tf, df): places of each term, and keys of rows that hold it.

    Where each row has a key of its own (``keyed``), these are counted as rows,
    and what a task remembers are terms; else keys are told apart.
    """
    return index.groupBy("term").agg(F.sum(times(index)).alias("tf"), (F.count(F.lit(1)) if keyed else F.count_distinct(key)).alias("df"))


def lookup(spark: SparkSession, path: str, match: Match, key: str, n: int) -> DataFrame:
    """The n best rows of a stored index: (key, score), as ``search`` gives them.

    Reads the rows of the terms only. A phrase is where its words' places,
    shifted by their position in the phrase, agree.
    """
    facts = spark.read.parquet(f"{path}/facts").first().asDict()
    return lookup_in(spark.read.parquet(f"{path}/postings"), facts, match, key, n)


def lookup_in(index: DataFrame, facts: dict, match: Match, key: str, n: int) -> DataFrame:
    """The n best rows by their postings, with the numbers of rows (n) and their mean length at hand."""
    terms = match.all_of + match.any_of + match.none_of
    hits = []
    for i, term in enumerate(terms):
        parts = parts_of(term)
        each = [index.where(F.col("term").startswith(p) if term.prefix and j == len(parts) - 1 else F.col("term") == p) for j, p in enumerate(parts)]
        if len(parts) == 1:
            found = each[0].select(key, "length", times(index, term.column).alias("times")).where("times > 0")
        else:
            inside = [c for c in columns_of(index) if term.column in (None, c)]
            starts = [e.select(key, "length", F.lit(c).alias("column"), F.explode(F.col("at")[c]).alias("place"), F.lit(j).alias("part")) for j, e in enumerate(each) for c in inside]
            starts = [x.withColumn("place", F.col("place") - F.col("part")) for x in starts]
            if not starts:
                starts = [index.where("false").select(key, "length", F.lit("").alias("column"), F.lit(0).alias("place"), F.lit(0).alias("part"))]
            met = reduce(DataFrame.unionByName, starts).groupBy(key, "length", "column", "place").agg(F.bit_or(F.expr("shiftleft(1L, part)")).alias("parts"))
            found = met.where(F.col("parts") == (1 << len(parts)) - 1).select(key, "length", F.lit(1).alias("times"))
        hits.append(found.withColumn("number", F.lit(i)))
    tf = [F.coalesce(F.sum(F.when(F.col("number") == i, F.col("times"))), F.lit(0)).alias(f"tf{i}") for i in range(len(terms))]
    counted = Scratch(index.sparkSession, "lookup").keep(reduce(DataFrame.unionByName, hits).groupBy(key, "length").agg(*tf), "counted")
    facts = facts | counted.agg(*_frequencies(terms)).first().asDict()
    return best(counted, match, key, n, facts)


def in_order(hits: DataFrame, rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The rows of a short list of hits, all columns and those of the hits, with their ``place`` in the given order; keys without a row are left out."""
    placed = hits.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # the results of a limit
    return rows.join(F.broadcast(placed), key)


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, key: str) -> DataFrame:
    """Vector hits first, then text hits not among them: (key, similarity, place).

    Without vector hits the text hits are not consulted. Both inputs are short
    lists, the results of a limit.
    """
    hits = vector_hits.select(key, "similarity", F.lit(0).alias("source"), F.col("similarity").alias("rank"))
    other = text_hits.select(key, F.lit(None).cast("double").alias("similarity"), F.lit(1).alias("source"), F.col("score").alias("rank"))
    every = hits.unionByName(other).withColumn("any", F.min("source").over(Window.partitionBy(F.lit(0))) == 0)  # two short lists
    both = every.where("any").groupBy(key).agg(F.min_by(F.struct("similarity", "source", "rank"), "source").alias("h"))
    return both.select(key, F.col("h.similarity").alias("similarity"), F.col("h.source").alias("source"), F.col("h.rank").alias("rank"))
