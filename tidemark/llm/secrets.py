"""Secrets in texts, and credentials that come in several parts, in DataFrame functions only.

Strong patterns are reported wherever they stand. Weak parts (short values of
secret-like names, names of accounts and keys, addresses of services) mean
little alone: they are interval-joined within a scope of the same text, and
reported only where complementary parts co-occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared.scratch import Scratch


#: Code points between two parts of one credential, at most.
SCOPE = 200
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Kind:
    """A pattern; a match is kept if the given group is of ``least`` to ``most`` characters.

    ``quick`` matches in every text that holds a kept match. ``part`` is the
    role in a credential.
    """

    name: str
    pattern: str
    part: str
    strong: bool
    least: int
    most: int = 1 << 30
    group: int = 0
    quick: str = ""


#: Fixed values, in the order that spans with one start are listed.
KINDS = (
    Kind("assign", r"(?i:(password|passwd|secret|token|api_?key))" + _VALUE + r"([A-Za-z0-9+/_.=-]+)", "secret", True, 12, group=2, quick=r"(?i:password|passwd|secret|token|api_?key)" + _VALUE + r"[A-Za-z0-9+/_.=-]{12}"),
    Kind("access", r"AKIA[A-Z0-9]+", "identifier", True, 18, quick=r"AKIA[A-Z0-9]{14}"),
    Kind("hex", r"[0-9a-f]{16,}", "secret", True, 16, quick=r"[0-9a-f]{16}"),
    Kind("weak_secret", r"(?i:(password|passwd|pwd|secret|token|api_?key))" + _VALUE + r"([A-Za-z0-9+/_.-]+)", "secret", False, 6, 11, 2, quick=r"(?i:password|passwd|pwd|secret|token|api_?key)" + _VALUE + r"[A-Za-z0-9+/_.-]{6}"),
    Kind("weak_identifier", r"(?i:(client_?id|access_?key_?id|user_?name|account_?id|login))" + _VALUE + r"([A-Za-z0-9@._-]+)", "identifier", False, 4, group=2, quick=r"(?i:client_?id|access_?key_?id|user_?name|account_?id|login)" + _VALUE + r"[A-Za-z0-9@._-]{4}"),
    Kind("endpoint", r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9@:%._/?&=-]+", "endpoint", False, 10, quick=r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://"),
)


def _matches(kind: Kind) -> Column:
    """The kind's matches in ``text``: lengths of the gap before, of the match and of the checked group."""
    all_of = lambda group: F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(group))
    length = lambda found: F.transform(found, lambda x: F.char_length(x))
    gaps = length(F.split("text", kind.pattern, -1))
    found = F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.arrays_zip(gaps.alias("gap"), length(all_of(0)).alias("size"), length(all_of(kind.group)).alias("checked")).alias("places"))
    return F.when(F.col("text").rlike(kind.quick), found)


def find(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Kept matches: (row, doc_id, kind, start, stop); a text without any has one row of nulls.

    One pass over the texts; what is shuffled are lengths, never text.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.xxhash64("text"))
    kinds = F.filter(F.array(*map(_matches, KINDS)), lambda x: x.isNotNull())
    found = texts.select("row", "doc_id", "digest", F.explode_outer(kinds).alias("k"))
    found = found.select("row", "doc_id", "digest", F.col("k.kind").alias("kind"), F.posexplode_outer("k.places").alias("pos", "p"))
    # The gap after the last match has no match; a text without matches keeps its row.
    found = found.where("kind is null or p.size is not null").select("row", "doc_id", "digest", "kind", "pos", "p.gap", "p.size", "p.checked")
    found = scratch.keep(found, "matches")
    along = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(along)).withColumn("start", F.col("stop") - F.col("size"))
    limits = F.array(*(F.struct(F.lit(k.least).alias("least"), F.lit(k.most).alias("most")) for k in KINDS))
    limit = F.get(limits, F.col("kind"))
    kept = F.col("checked").between(limit["least"], limit["most"])
    blank = lambda c: F.when(kept, F.col(c)).alias(c)
    return found.select("row", "doc_id", "digest", blank("kind"), blank("start"), blank("stop"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak matches with complementary parts in scope: (row, kind, start, stop, has_...).

    Parts meet by an equi-join on (row, stretch of ``scope`` code points), the
    stretches beside included. A stretch holds few parts, as parts don't
    overlap within a kind, so no text or row gathers all its pairs.
    """
    parts = F.array(*(F.lit(k.part) for k in KINDS))
    strong = F.array(*(F.lit(k.strong) for k in KINDS))
    spans = found.where("kind is not null").withColumn("part", F.get(parts, F.col("kind"))).withColumn("strong", F.get(strong, F.col("kind")))
    weak = spans.where("not strong").withColumn("stretch", F.floor(F.col("start") / scope))
    last = F.floor((F.col("stop") + scope) / scope)
    other = spans.select("row", F.col("part").alias("other"), F.col("start").alias("from"), F.col("stop").alias("to"), F.explode(F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / scope), last)).alias("stretch"))
    # Long parts reach past the stretch they begin in, so the weak one's end counts as well.
    weak = weak.withColumn("stretch", F.explode(F.sequence(F.col("stretch"), F.floor(F.col("stop") / scope))))
    gap = F.greatest(F.col("from") - F.col("stop"), F.col("start") - F.col("to"))
    met = weak.join(other, ["row", "stretch"]).where((gap <= scope) & (F.col("other") != F.col("part")))
    has = lambda part: F.max(F.col("other") == part).alias(f"has_{part}")
    met = met.groupBy("row", "kind", "part", "start", "stop").agg(has("secret"), has("identifier"), has("endpoint"))
    enough = F.when(F.col("part") == "endpoint", F.col("has_secret") & F.col("has_identifier")).otherwise(F.when(F.col("part") == "secret", F.col("has_identifier") | F.col("has_endpoint")).otherwise(F.col("has_secret")))
    return met.where(enough)


def scan_secrets(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc_id, digest, spans): a row for each row of ``docs``.

    Reads (doc_id, text); further columns are ignored. ``spans`` are structs
    (start, kind, stop), in code points with the end exclusive, by start and
    then by the kind's place in ``KINDS``: strong matches, and weak ones that
    are part of a credential. A null or empty text has none, a very long one is
    scanned whole, repeated rows each for itself. An empty table gives no rows.
    """
    found = scratch.keep(find(docs, scratch), "found")
    scratch.drop("matches")
    strong = F.array(*(F.lit(k.strong) for k in KINDS))
    weak = linked(found).select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("digest"), "kind", "start", "stop")
    # A row without a kind stands for the text itself.
    own = found.select("row", "doc_id", "digest", F.when(F.get(strong, F.col("kind")), F.col("kind")).alias("kind"), "start", "stop")
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "stop"))
    return own.unionByName(weak).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("digest").alias("digest"), F.sort_array(F.collect_list(span)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    wanted = [i for i, k in enumerate(KINDS) if k.name in kinds]
    return F.filter(spans, lambda s: s["kind"].isin(wanted))


def redact(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with every span replaced by its kind's name in brackets.

    Only ``text`` changes. Spans that overlap are replaced as one, named after
    the first. Texts are joined to their spans by id and hash; a text without
    spans stays as it is, null included. Very long texts are cleaned whole,
    repeated rows alike, and an empty table stays empty.
    """
    spans = scan_secrets(docs, scratch).where(F.size("spans") > 0)
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.first("spans").alias("_spans"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_digest"))
    names = ", ".join(f"'{k.name}'" for k in KINDS)
    # The pieces are listed and joined once, so that a text with many spans is not copied for each.
    clean = F.expr(f"""aggregate(_spans, named_struct('at', 0L, 'done', cast(array() as array<string>)),
        (a, s) -> case
            when s.start >= a.at then named_struct('at', s.stop, 'done', concat(a.done, array(substring(text, cast(a.at as int) + 1, cast(s.start - a.at as int)), concat('[', get(array({names}), s.kind), ']'))))
            else named_struct('at', greatest(a.at, s.stop), 'done', a.done) end,
        a -> concat(array_join(a.done, ''), substring(text, cast(a.at as int) + 1)))""")
    return docs.join(spans, same, "left").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
