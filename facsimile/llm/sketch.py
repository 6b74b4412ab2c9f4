"""Bottom-k sketches of shingle hashes (DataFrame functions only).

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes
of a text's word shingles (a text with fewer words than a shingle is one
shingle, a text without words has an empty sketch). Sketches of parts merge
into the sketch of their union, and estimate

* resemblance: the share of the ``k`` smallest hashes of the union that both
  sketches hold;
* containment of one set in another, from resemblance and distinct counts;
* the number of distinct shingles, from the k-th smallest hash.

``edited`` puts beside each document the one that follows it in descending id
order (after the last, the first) and the text in which the last half of the
code points is replaced by the start of that next text. Documents are dealt
out once, into ranges of ids whose bounds are ids of the table; the document
at a bound is also sent, marked, to the range before it, so each range knows
its successor without a global sort.

Null text counts as empty. Two empty sketches have likeness 1, an empty and a
non-empty one 0. Equal ids follow each other in the order of their text
digest; null ids come last. A single document is its own next one. Repeated
rows keep their rows. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm.common import text_of, words_of
from facsimile.session import shuffle_partitions

SHINGLE = 5  # words
SIZE = 128  # hashes kept
_RANGE = float(1 << 64)


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """Distinct hashes of all shingles of an array of words."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (shingle - 1)), lambda i: F.xxhash64(F.slice(words, i, shingle)))
    one = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.when(F.size(words) >= shingle, many).otherwise(one))


def bottom(hashes: Column, k: int = SIZE) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def merge(a: Column, b: Column, k: int = SIZE) -> Column:
    """Sketch of the union of two sets, from their sketches."""
    return bottom(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both)).cast("double")


def distinct_count(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles (exact below ``k``)."""
    top = (F.element_at(a, -1).cast("double") + _RANGE / 2) / _RANGE  # the largest kept hash on (0, 1)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of the first set that lies in the second (0 to 1)."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def printed(a: Column) -> Column:
    """The hashes as 16 hex digits each, one after the other."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _with_sketch(df: DataFrame, text: str, words: str, hashes: str, out: str) -> DataFrame:
    """Add the sketch of a text in steps, so that no step is computed twice."""
    return df.withColumn(words, words_of(F.col(text))).withColumn(hashes, shingle_hashes(F.col(words))).withColumn(out, bottom(F.col(hashes))).drop(words, hashes)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, sketch) of every document."""
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return _with_sketch(base.withColumn("n_chars", F.length("text").cast("bigint")), "text", "w", "h", "sketch").drop("text")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, sketch, edited, edited_sketch, next_sketch) of every document."""
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text_of(text_col).alias("text"))
    parts = shuffle_partitions(spark)
    shares = [i / parts for i in range(1, parts)] + [1.0]
    found = base.agg(F.percentile_approx("id", shares, 100 * parts)).first()[0] or []
    heads = sorted(set(found), reverse=True)  # the largest id of each range; range 0 has the largest ids
    last = max(0, len(heads) - 1)
    tops = F.array(*[F.lit(h).cast("bigint") for h in heads]).cast("array<bigint>")
    place = F.when(F.col("id").isNull(), last).otherwise(F.size(F.filter(tops, lambda h: h >= F.col("id"))) - 1)
    copies = F.array(F.struct(F.col("place").alias("part"), F.lit(0).alias("guest")))
    if heads:
        guest = F.array(F.struct(F.when(F.col("place") == 0, last).otherwise(F.col("place") - 1).alias("part"), F.lit(1).alias("guest")))
        is_head = F.array_contains(tops, F.col("id"))
        copies = F.when(F.coalesce(is_head, F.lit(False)), F.concat(copies, guest)).otherwise(copies)
    dealt = base.withColumn("place", place).select("id", "text", F.inline(copies)).repartition(parts, "part")
    known = _with_sketch(dealt.withColumn("tie", F.xxhash64("text")), "text", "w", "h", "sketch")
    in_order = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("id"), "tie")
    ahead = F.lead(F.struct("text", "sketch")).over(in_order)
    first = F.first(F.struct("text", "sketch")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = known.withColumn("next", F.coalesce(ahead, first)).filter("guest = 0")
    n = F.length("text").cast("bigint")
    cut = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next.text", F.lit(1), cut))
    changed = both.select("id", n.alias("n_chars"), "sketch", text.alias("edited"), F.col("next.sketch").alias("next_sketch"))
    return _with_sketch(changed, "edited", "w", "h", "edited_sketch")
