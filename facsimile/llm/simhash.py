"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit majority votes over hashed word shingles. Two
fingerprints link when at most ``max_bits`` (3) bits differ. Of 3 differing
bits at most one lies in one of the two 32-bit halves, so each half is
searched at threshold 1 with anchors:

* the anchors of a half are the codewords of the perfect Hamming(31, 26) code
  over its low 31 bits (the bit left over takes part in the comparison only).
  The code covers every 31-bit word within radius 1, and each word has
  exactly one codeword -- its home -- that near;
* a fingerprint is replicated to every anchor within covering radius plus
  threshold, 1 + 1 = 2: its home and 15 more, or the home alone if it is a
  codeword itself. If two words differ in at most one bit, the home of either
  is within 2 of the other, so the pair meets at that anchor;
* at each anchor the fingerprints at home there are compared, over all 64
  bits, with everything replicated there.

There are 2^26 anchors per half, so unrelated fingerprints hardly meet.
Equal fingerprints are one row before the replication. An anchor with many
members (near copies) is dealt out as pairs of blocks: each task compares one
block of home fingerprints with one block of replicas and returns only a
spanning forest of the links found, at most one row per member, never the
pairs. Components are then joined up by ``components.connected_components``.

Null text counts as empty and has fingerprint zero, like any text without
words; zero links like any other value. Repeated rows and repeated ids keep
their rows. Null ids never become a component id; a component of null ids
only has a null component id. Empty tables give empty tables.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import free_name, ship, text_of, written
from facsimile.llm.components import connected_components

BLOCK = 512  # fingerprints compared with as many others in one step
_BITS = 64
# Parity masks of the Hamming(31, 26) code; bit p-1 stands for position p.
PARITY_MASKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
LOW31 = (1 << 31) - 1


def fingerprint_of(text: bytes, shingle_words: int = 3) -> int:
    """Fingerprint of UTF-8 bytes as an unsigned integer."""
    words = text.lower().split()  # bytes.lower changes A-Z only; split() breaks at ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[shingle_words - 1 :] or [len(line)]
    votes = np.zeros(_BITS, np.int64)
    spans = [line[a:b] for a, b in zip(starts, ends)]
    for at in range(0, len(spans), 1 << 16):
        digests = b"".join(map(xxhash.xxh64_digest, spans[at : at + (1 << 16)], repeat(42)))
        votes += np.add.reduce(np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, _BITS), axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(spans)).tobytes(), "big")


def fingerprint_column(text: str, shingle_words: int = 3):
    """Signed 64-bit fingerprint of a text column (Arrow batches)."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        out = [fingerprint_of(t.as_buffer().to_pybytes(), shingle_words) for t in texts.cast(pa.large_binary())]
        return pa.array(np.array(out, np.uint64).view(np.int64))

    return run(text_of(text))


def _syndrome(half):
    return sum((F.bit_count(half.bitwiseAND(F.lit(m))) % 2) * (1 << j) for j, m in enumerate(PARITY_MASKS)).cast("int")


def _flip(half, position):
    """``half`` with the bit of a position (1..31, 0: none) turned over."""
    return half.bitwiseXOR(F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), position - 1)).otherwise(F.lit(0).cast("bigint")))


def anchors(fingerprints: DataFrame) -> DataFrame:
    """(fp, side, anchor, home): every anchor a fingerprint is replicated to."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("fp").bitwiseAND(F.lit(LOW31)).alias("half")),
        F.struct(F.lit(1).alias("side"), F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32)).bitwiseAND(F.lit(LOW31)).alias("half")),
    )
    rows = fingerprints.select("fp", F.inline(sides)).withColumn("s", _syndrome(F.col("half")))
    near = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (F.col("s") > 0) & (i < i.bitwiseXOR(F.col("s")))),
        lambda i: F.struct(_flip(_flip(F.col("half"), i), i.bitwiseXOR(F.col("s"))).alias("anchor"), F.lit(False).alias("home")),
    )
    home = F.array(F.struct(_flip(F.col("half"), F.col("s")).alias("anchor"), F.lit(True).alias("home")))
    return rows.select("fp", "side", F.inline(F.concat(home, near)))


def _forest(homes: np.ndarray, others: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (member, smallest member) of the components between two blocks."""
    close = np.bitwise_count(homes[:, None] ^ others[None, :]) <= max_bits
    touched = close.any(axis=0)
    others, close = others[touched], close[:, touched]
    top = np.iinfo(np.int64).max
    left = homes.view(np.int64).copy()
    right = others.view(np.int64).copy()
    while True:
        down = np.minimum(left, np.where(close, right[None, :], top).min(axis=1, initial=top))
        over = np.minimum(right, np.where(close, down[:, None], top).min(axis=0, initial=top))
        if (down == left).all() and (over == right).all():
            break
        left, right = down, over
    nodes = np.concatenate([homes.view(np.int64), others.view(np.int64)])
    roots = np.concatenate([left, right])
    return [(a, b) for a, b in zip(nodes.tolist(), roots.tolist()) if a != b]


def _compare(max_bits: int):
    def run(batches):
        for batch in batches:
            links: set[tuple[int, int]] = set()
            for homes, others in zip(batch.column("homes").to_pylist(), batch.column("others").to_pylist()):
                if len(homes) * len(others) <= 32:
                    links.update((max(a, b), min(a, b)) for a in homes for b in others if a != b and ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= max_bits)
                else:
                    links.update(_forest(np.array(homes, np.int64).view(np.uint64), np.array(others, np.int64).view(np.uint64), max_bits))
            pairs = sorted(links)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return run


def links(fingerprints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) that join up all fingerprints at most ``max_bits`` apart.

    ``fingerprints`` has distinct values in a bigint column ``fp``. Every pair
    within the distance is compared; the result is a set of links with the
    same connected components as all those pairs.
    """
    if max_bits > 3:
        raise ValueError("two halves at threshold 1 find at most 3 differing bits")
    ship(fingerprints.sparkSession)
    placed = anchors(fingerprints)
    busy = written(
        placed.groupBy("side", "anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("home"), 1)).alias("n_home"))
        .filter("n > 1 and n_home > 0")
        .select("side", "anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
        "anchors",
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_other = F.transform(every, lambda k: F.struct(k.alias("x"), own.alias("y"), F.lit(False).alias("is_home")))
    as_home = F.transform(every, lambda k: F.struct(own.alias("x"), k.alias("y"), F.lit(True).alias("is_home")))
    blocks = placed.join(busy, ["side", "anchor"]).select(
        "fp", "side", "anchor", F.inline(F.concat(as_other, F.when(F.col("home"), as_home).otherwise(F.expr("filter(array(), z -> false)").cast("array<struct<x:int,y:int,is_home:boolean>>"))))
    )
    groups = (
        blocks.groupBy("side", "anchor", "x", "y")
        .agg(F.collect_list(F.when(F.col("is_home"), F.col("fp"))).alias("homes"), F.collect_list(F.when(~F.col("is_home"), F.col("fp"))).alias("others"))
        .filter((F.size("homes") > 0) & (F.size("others") > 0))
    )
    return groups.select("homes", "others").mapInArrow(_compare(max_bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: (id, text_key, fp, component_id).

    ``fp`` is the signed fingerprint, ``text_key`` a 64-bit digest of the text
    that tells rows with the same id apart, ``component_id`` the smallest id
    reachable over links (null if there are only null ids).
    """
    ship(docs.sparkSession)
    slim = written(
        docs.select(
            F.col(f"`{id_col}`").cast("bigint").alias("id"),
            F.xxhash64(text_of(text_col)).alias("text_key"),
            fingerprint_column(text_col, shingle_words).alias("fp"),
        ),
        "fingerprints",
    )
    least = written(slim.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    roots = connected_components(links(least.select("fp"), max_bits))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "roots")
    tops = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "tops")
    classes = written(rooted.join(tops, "root").select("fp", "component_id"), "classes")
    return slim.join(classes, "fp").select("id", "text_key", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """The columns of ``docs`` for one row of each component.

    Kept is the row with the smallest id (null ids last, then the smaller text
    digest); of rows equal in both only one stays.
    """
    id_, key, null = (free_name(docs, c) for c in ("_near_id", "_near_key", "_near_null"))
    classes = near_duplicates(docs, id_col, text_col, shingle_words, max_bits)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_key")))
    # Components without any id have a null component id: there, each fingerprint keeps one row.
    group = F.coalesce(F.col("component_id"), F.col("fp"))
    keepers = written(
        classes.groupBy(F.col("component_id").isNull().alias("g"), group.alias("k")).agg(first.alias("f")).select(F.coalesce("f.id", F.lit(0)).alias(id_), F.col("f.text_key").alias(key), F.col("f.none").alias(null)),
        "keepers",
    )
    marked = docs.withColumns({id_: F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(0)), key: F.xxhash64(text_of(text_col)), null: F.col(f"`{id_col}`").isNull()})
    return marked.join(keepers, [id_, key, null], "left_semi").dropDuplicates([id_, key, null]).drop(id_, key, null)
