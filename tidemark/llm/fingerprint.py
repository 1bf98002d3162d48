"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A fingerprint is the sorted list of the k smallest distinct 32-bit hashes of a
text's word shingles. Fingerprints of parts merge into that of the whole, and
two of them estimate resemblance, containment and the number of distinct
shingles. Words are runs of other characters than ASCII white space; a text of
fewer words than a shingle's has its word sequence as its only shingle, a text
without words has an empty fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared.ranges import stretches
from ..shared.scratch import Scratch


#: Words of a shingle, and hashes of a fingerprint.
WIDTH, K = 5, 128
SPACE = 1 << 32
_LEAST = -(1 << 63)


def with_fingerprint(df: DataFrame, text: str, into: str, width: int = WIDTH, k: int = K) -> DataFrame:
    """``df`` with the fingerprint (array of long) of a column of texts; null counts as empty."""
    cells = f"_{into}_cells"
    low = f"_{into}_low"
    gram = ", ".join(f"h[i + {j}]" for j in range(width))
    df = df.withColumn(cells, F.expr(f"transform(filter(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), w -> xxhash64(w))"))
    rolling = f"transform(sequence(0, size({cells}) - {width}), i -> shiftrightunsigned(xxhash64({gram.replace('h[', cells + '[')}), 32))"
    whole = f"array(shiftrightunsigned(xxhash64({cells}), 32))"
    df = df.withColumn(cells, F.expr(f"case when size({cells}) >= {width} then {rolling} when size({cells}) > 0 then {whole} else cast(array() as array<bigint>) end"))
    # Of many hashes only the low ones can be among the k least; where repeats leave too few of them, all are sorted.
    bound = f"cast({SPACE}L * {3.0 * k}D / size({cells}) as bigint)"
    df = df.withColumn(low, F.expr(f"array_distinct(case when size({cells}) > {4 * k} then filter({cells}, x -> x < {bound}) else {cells} end)"))
    least = F.expr(f"case when size({low}) >= {k} or size({cells}) <= {4 * k} then {low} else array_distinct({cells}) end")
    return df.withColumn(into, F.slice(F.sort_array(least), 1, k)).drop(cells, low)


def merged(x: Column, y: Column, k: int = K) -> Column:
    """Fingerprint of two parts together."""
    return F.slice(F.sort_array(F.array_union(x, y)), 1, k)


def resemblance(x: Column, y: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; texts without words equal each other."""
    union = merged(x, y, k)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(x, y), union)) / F.size(union))


def distinct_shingles(x: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for fewer than k."""
    return F.when(F.size(x) < k, F.size(x).cast("double")).otherwise((k - 1) * F.lit(float(SPACE)) / (F.element_at(x, k) + 1))


def containment(x: Column, y: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second holds."""
    shared = resemblance(x, y, k) * distinct_shingles(merged(x, y, k), k)
    return F.when(F.size(x) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(x, k)))


def as_text(x: Column) -> Column:
    """Eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(x, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def with_edits(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Fingerprints of each text, of its edited form, and of the next document.

    Reads (doc_id, text); further columns are ignored, a null text is empty. In
    the edited form the last quarter of the code points (rounded down) is
    replaced by as many from the beginning of the next document by doc_id; after
    the last comes the first, so a lone document follows itself. A null id comes
    before all others; rows that share an id follow each other by text, and lie
    in one stretch. Very long texts are read whole, and an empty table gives no
    rows.

    Texts are shuffled once, by stretches of ids of about equal numbers of rows,
    four for each shuffle partition. Within a stretch the next row is a window's
    lead; for its last row the beginning of the next stretch's first row is
    brought there, one row for each stretch.
    """
    parts = 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LEAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    # A generated column, as the optimizer else carries the expression over to the other side of the join below.
    own = own.withColumn("stretch", F.explode(F.array(stretches(own, "key", parts))))
    ends = own.groupBy("stretch").agg(F.min("key").alias("first"), F.max(F.struct("key", F.char_length("text").alias("chars"))).alias("last"))
    ends = scratch.keep(ends, "ends")
    # One row for each stretch from here on.
    every = Window.orderBy("stretch")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ends.select("stretch", F.coalesce(F.lead("first").over(every), F.first("first").over(whole)).alias("key"), F.floor(F.col("last.chars") / 4).cast("int").alias("need"))
    begins = own.select("key", "text").join(F.broadcast(after), "key")
    begins = with_fingerprint(begins.groupBy("stretch", "need").agg(F.min("text").alias("text")), "text", "outer_print")
    begins = scratch.keep(begins.select("stretch", F.expr("left(text, need)").alias("outer_text"), "outer_print"), "begins")
    dealt = with_fingerprint(own.repartition("stretch"), "text", "print")
    order = Window.partitionBy("stretch").orderBy("key", "text")
    dealt = dealt.withColumn("inner", F.lead(F.struct(F.col("text").alias("passage"), F.col("print").alias("next_print"))).over(order))
    both = dealt.join(begins, "stretch").withColumn("next", F.coalesce("inner", F.struct(F.col("outer_text").alias("passage"), F.col("outer_print").alias("next_print"))))
    both = both.withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(left(text, cast(n_chars - floor(n_chars / 4) as int)), left(next.passage, cast(floor(n_chars / 4) as int)))"))
    both = both.select("doc_id", "text", "n_chars", "edited", "print", F.col("next.next_print").alias("next_print"))
    return with_fingerprint(both, "edited", "edited_print")
