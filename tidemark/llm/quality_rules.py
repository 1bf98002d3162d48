"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per text. The ledger stores the measurements and
one bit for each rule that failed. Policies are versioned sets of rules: they
are applied to the ledger with bitwise operations, so a new policy, or the
effect of leaving out a rule, needs no second look at the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import NOT_SPACE, Text, byte_set, grams, slices

SYMBOLS = byte_set(*((ord(c), ord(c)) for c in "#*$%&|<>"))
CHARS_IN_WORDS = NOT_SPACE & ~byte_set((0x80, 0xBF))
#: Words of a window that counts as repeated when it occurs again.
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules in the order of their bits: a text fails where the condition holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the rules that a text must not fail."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, tuple(RULES))


def _sorted_repeats(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (doc, value), and for each place whether it equals the one before."""
    order = np.lexsort((values, doc))
    d, v = doc[order], values[order]
    again = np.zeros(len(order), bool)
    again[1:] = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    return order, again


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The ``MEASURES`` of each text."""
    text = Text(texts)
    words = text.runs(NOT_SPACE)
    n_words = words.counts()
    lines = text.lines()
    full = np.flatnonzero(np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts))
    order, again = _sorted_repeats(lines.doc[full], text.hashes(lines.starts[full], lines.ends[full]))
    dup_lines = np.bincount(lines.doc[full][order][again], minlength=text.n)
    values, at = grams(words.hashes(), words.doc, WINDOW)
    order, again = _sorted_repeats(words.doc[at], values)
    twice = again.copy()
    twice[:-1] |= again[1:]
    begins = at[order][twice]
    cover = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(cover, begins, 1)
    np.add.at(cover, np.minimum(begins + WINDOW, len(cover) - 1), -1)
    repeated = np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=text.n)
    return [n_words, text.count(CHARS_IN_WORDS), text.count(SYMBOLS), np.bincount(lines.doc[full], minlength=text.n), dup_lines, repeated]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            columns = [pa.array(m, pa.int64()) for m in measure(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, failed_bits): a row for each row of ``docs``.

    Reads (doc_id, text); further columns are ignored. A null or empty text has
    zero for every measure and fails ``few_words`` alone. Very long texts are
    measured whole, repeated rows each for itself. An empty table gives an empty
    ledger.
    """
    found = docs.select("doc_id", "text").mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = None
    for name, fails in RULES.items():
        bit = F.when(F.expr(fails), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return found.withColumn("failed_bits", bits)


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does: (rule, failed, only_this, kept_without).

    One aggregation over the ledger. ``only_this`` counts texts that no other
    rule of the policy rejects, and ``kept_without`` the texts kept without it.
    """
    own = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    by_bits = entries.groupBy(own.alias("bits")).agg(F.count(F.lit(1)).alias("texts"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules)))
    each = by_bits.select("bits", "texts", rules.alias("r")).select("bits", "texts", "r.rule", "r.bit")
    texts = lambda condition: F.sum(F.when(condition, F.col("texts")).otherwise(0)).alias
    bits, bit = F.col("bits"), F.col("bit")
    return each.groupBy("rule").agg(texts(bits.bitwiseAND(bit) != 0)("failed"), texts(bits == bit)("only_this"), texts((bits == 0) | (bits == bit))("kept_without"))


def evaluate(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's verdict ``kept``."""
    entries = ledger(docs)
    return entries.withColumn("base_failed", ~passes(BASE)).withColumn("kept", passes(BASE) & passes(policy))
