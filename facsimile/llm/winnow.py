"""Benchmark decontamination by winnowed word fingerprints.

A fingerprint is the hash of ``gram`` consecutive words. In every window of
``span`` words the fingerprint with the smallest hash is kept (the last of
equals). Which one that is depends on the window's words alone, so a window of
an item and its occurrence in a document keep the same fingerprint: every
shared span of ``span`` words or more is found. An item of fewer words is one
window, with the hash of all its words as its fingerprint; documents then keep
all grams of that length too.

The distinct windows of the items, each with its fingerprint and its list of
items, are one small table. Its fingerprints are put into a bit table whose size
follows their number up to ``MAX_BITS`` (bounded, so it can be sent to every
task). Documents are read once: a window goes on only if the bit of its
fingerprint is set. These are joined with the item windows on the fingerprint
and extended from it to the whole window, whose words must be equal; false bits
end here. Runs of adjacent windows are joined into maximal spans.

Both sides of the join are dealt over ``SALTS`` parts per fingerprint, with the
small item side repeated, so a passage that a third of all documents share is
not one task's work; the item windows are distinct, so a place of a document
meets one row at most. Items that share their windows share one list, which is
joined once per document.

Null text counts as empty and has no words. Repeated documents keep their rows,
null ids too. Repeated items are one item; an item without id hits words but is
in no list. Empty tables give no hits or no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import ship, written
from facsimile.llm.tokens import array_slices, hashes_of
from facsimile.llm.words import ALPHANUMERIC, Words, find_words

SLICE = 1 << 22  # bytes of text read together
MIN_BITS, MAX_BITS = 16, 27  # base-2 logarithm of the bit table's size
BITS_PER_FINGERPRINT = 512
SALTS = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)  # any odd number
_STIR = np.uint64(0xD6E8FEB86659FD93)  # any odd number


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STIR
    h = (h ^ (h >> np.uint64(29))) * _STIR
    return h ^ (h >> np.uint64(32))


def word_hashes(words: Words) -> np.ndarray:
    return _stirred(hashes_of(words.distinct))[words.codes]


def gram_hashes(hashes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` words from each word on (the last ones have none)."""
    n = max(0, len(hashes) - gram + 1)
    out = hashes[:n].copy()
    for j in range(1, gram):
        out = out * _MIX + hashes[j : n + j]
    return _stirred(out + np.uint64(gram))


def smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of ``width`` consecutive hashes, the last of equals, for each window."""
    n = max(0, len(hashes) - width + 1)
    best, place = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        other = hashes[j : n + j]
        better = other <= best
        best[better] = other[better]
        place[better] = j
    return place + np.arange(n)


def windows(words: Words, hashes: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, kept fingerprint) of every window of ``span`` words that lies in one text."""
    grams = gram_hashes(hashes, gram)
    kept = grams[smallest(grams, span - gram + 1)]
    texts = words.texts
    inside = np.flatnonzero(texts[: len(kept)] == texts[span - 1 :])
    return inside, kept[inside]


def _item_windows(span: int, gram: int):
    def run(batches):
        for batch in batches:
            for at, texts in array_slices(batch, "text", SLICE):
                words = find_words(texts, ALPHANUMERIC, lower=True)
                hashes = word_hashes(words)
                sizes = np.diff(words.places)
                item_of = words.texts
                items = batch.column("id").slice(at, len(texts))
                for m in range(1, span + 1):
                    first, kept = windows(words, hashes, m, min(m, gram) if m == span else m)
                    ours = sizes[item_of[first]] >= span if m == span else sizes[item_of[first]] == m
                    first, kept = first[ours], kept[ours]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kept.view(np.int64)), pa.array([m] * len(first), pa.int32()), words.lines(first, m), items.take(pa.array(item_of[first]))],
                        ["fp", "size", "line", "item"],
                    )

    return run


def _hits(bits: bytes, log_bits: int, sizes: list[int], span: int, gram: int):
    def run(batches):
        table = np.frombuffer(bits, np.uint8)
        for batch in batches:
            for at, texts in array_slices(batch, "text", SLICE):
                words = find_words(texts, ALPHANUMERIC, lower=True)
                hashes = word_hashes(words)
                found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), words.lines(words.places[:0], 1))]
                for m in sizes:
                    first, kept = windows(words, hashes, m, gram if m == span else m)
                    bit = (kept >> np.uint64(64 - log_bits)).astype(np.int64)
                    hit = (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    found.append((first[hit], kept[hit], np.full(int(hit.sum()), m), words.lines(first[hit], m)))
                *parts, lines = zip(*found)
                first, kept, size = map(np.concatenate, parts)
                by = np.lexsort((size, first))
                first, kept, size = first[by], kept[by], size[by]
                lines = pa.concat_arrays(lines).take(pa.array(by))
                text = np.searchsorted(words.places, first, side="right") - 1
                fields = [pa.array(kept.view(np.int64)), pa.array(first - words.places[text]), pa.array(size, pa.int32()), lines]
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, names=["fp", "at", "size", "line"]))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array(np.diff(words.places), pa.int64()), hits], ["id", "n_words", "hits"])

    return run


def _bit_table(fingerprints: DataFrame) -> tuple[bytes, int]:
    """(bits set at the top bits of each fingerprint, base-2 logarithm of their number)."""
    n = fingerprints.count()
    log_bits = min(MAX_BITS, max(MIN_BITS, (BITS_PER_FINGERPRINT * n).bit_length()))
    bit = F.shiftrightunsigned("fp", 64 - log_bits)
    bytes_ = fingerprints.select(F.shiftright(bit, 3).alias("byte"), F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int")).alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bit"))
    table = np.zeros(1 << (log_bits - 3), np.uint8)
    found = bytes_.toArrow()  # at most the table's size
    table[found.column("byte").to_numpy()] = found.column("bit").to_numpy()
    return table.tobytes(), log_bits


def _salted(many: DataFrame, few: DataFrame, on: list[str], seed: Column) -> DataFrame:
    """Inner join in which each key of ``many`` is dealt over SALTS parts by ``seed``."""
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(seed), F.lit(SALTS)).cast("int"))
    spread = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(spread, [*on, "salt"]).drop("salt")


def _maximal(found: Column) -> Column:
    """Overlapping or adjacent (at, size) pairs, sorted, as maximal spans (start, end)."""
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(spans, x):
        last = F.element_at(spans, -1)
        end = x["at"] + x["size"]
        joined = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(span(last["start"], F.greatest(last["end"], end))))
        return F.when((F.size(spans) > 0) & (x["at"] <= F.try_element_at(spans, F.lit(-1))["end"]), joined).otherwise(F.concat(spans, F.array(span(x["at"], end))))

    return F.aggregate(F.array_sort(found), empty, add)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, gram: int = 6
) -> DataFrame:
    """(id, n_words, spans, items) per document.

    ``spans`` are the maximal spans (start, end; in words) that windows of items
    cover, ``items`` the ids of the items with such windows, as sorted strings.
    """
    if not 1 <= gram <= span:
        raise ValueError("a gram is at most a span long")
    spark = docs.sparkSession
    ship(spark)
    item_texts = items.select(F.col(f"`{item_col}`").cast("string").alias("id"), F.col(f"`{item_text_col}`").alias("text"))
    pieces = item_texts.mapInArrow(_item_windows(span, gram), "fp bigint, size int, line string, item string")
    listed = pieces.groupBy("fp", "size", "line").agg(F.array_sort(F.collect_set("item")).alias("items"))
    known = written(listed.withColumn("list", F.sha2(F.to_json("items"), 256)), "item-windows")
    bits, log_bits = _bit_table(known.select("fp").distinct())
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # at most ``span`` numbers

    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    read = texts.mapInArrow(_hits(bits, log_bits, sizes, span, gram), "id bigint, n_words bigint, hits array<struct<fp:bigint,at:bigint,size:int,line:string>>")
    scanned = written(read.select(F.monotonically_increasing_id().alias("row"), "*"), "window-hits")
    hits = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    met = _salted(hits, known.select("fp", "size", "line", "list"), ["fp", "size", "line"], F.struct("row", "at"))
    per_list = met.groupBy("row", "list").agg(F.collect_list(F.struct("at", "size")).alias("places"))
    lists = known.select("list", "items").distinct()
    per_row = (
        _salted(per_list, lists, ["list"], F.col("row"))
        .groupBy("row")
        .agg(F.flatten(F.collect_list("places")).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select("row", _maximal(F.col("places")).alias("spans"), "items")
    )
    none = {"spans": F.array().cast("array<struct<start:bigint,end:bigint>>"), "items": F.array().cast("array<string>")}
    return scanned.drop("hits").join(per_row, "row", "left").select("id", "n_words", *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def hit_words(spans: Column) -> Column:
    """Number of words that the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


# The same result in SQL: every window of a document joined with the items' windows by its words.
CONTAMINATION_SQL = r"""
WITH words_of AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'i', item_id, row_number() OVER (),
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), item_windows AS (
  SELECT id AS item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS line
  FROM words_of WHERE kind = 'i' AND len(w) > 0
), sizes AS (SELECT DISTINCT m FROM item_windows
), doc_windows AS (
  SELECT r, m, unnest(range(1, len(w) - m + 2)) AS place, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS line
  FROM words_of, sizes WHERE kind = 'd' AND len(w) >= m
), met AS (
  SELECT r, place, m, item_id FROM doc_windows JOIN item_windows USING (m, line)
), hit AS (
  SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(place, place + m)) AS word FROM (SELECT DISTINCT r, place, m FROM met)) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words_of LEFT JOIN hit USING (r) LEFT JOIN found USING (r) WHERE kind = 'd'
"""
