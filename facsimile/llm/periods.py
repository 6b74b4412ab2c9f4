"""Periodic runs of words by a dictionary of basic factors.

The words of a batch of texts are one sequence of codes. Level k of the
dictionary names the factors of 2^k words: equal names, equal words; a name of
level k + 1 is the pair of the names of its halves. Only places whose factor
occurs again in the same text are kept, because no other can lie in a
repetition that is proposed at that level or above; of ordinary prose nothing
is left after a few levels.

At each level the successor of a place is the next one of the same name. A
distance below twice the factor's length proposes itself as a period: inside a
run of smallest period q the places of a name form an arithmetic progression,
and of the factors of 2^k <= q < 2^(k+1) words at least one occurs only once in
a period (a primitive word of length q has more than q / 2 different factors of
that length), so its successor lies exactly q further. Periods up to the
largest power of two within a third of the shortest run are proposed together
at that level, whose factors there occur once in a period. A proposal is
extended word by word to both sides, in blocks of doubling size, and gives one
run however many places propose it. A run of at least three periods has no
smaller period than its proposal: by the periodicity lemma the smaller one
would divide it, and the successor would have been nearer.

Texts are rows of one task each and are read whole; nothing is shuffled. Null
text counts as empty and has no words. Repeated rows and ids keep their rows,
null ids too. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import let, ship, words_of
from facsimile.llm.tokens import array_slices
from facsimile.llm.words import BETWEEN_SPACES, find_words, joined

SLICE = 1 << 22  # bytes of text searched together


def _successors(names: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by name and place, whether the next in order is the same name in the same text, new name of each in order)."""
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    changed = ranked[1:] != ranked[:-1]
    follows = ~changed & (texts[order[1:]] == texts[order[:-1]])
    return order, follows, np.append(0, np.cumsum(changed))


def _extended(words: np.ndarray, d: int, at: int, low: int, high: int) -> tuple[int, int]:
    """The longest [a, b) around ``at`` within [low, high - d) on which words d apart are equal."""
    b, step = at, 64
    while b < high - d:
        same = words[b : min(b + step, high - d)] == words[b + d : min(b + step, high - d) + d]
        if not same.all():
            b += int(np.argmin(same))
            break
        b += len(same)
        step = min(2 * step, 1 << 16)
    a, step = at, 64
    while a > low:
        first = max(low, a - step)
        same = (words[first:a] == words[first + d : a + d])[::-1]
        if not same.all():
            a -= int(np.argmin(same))
            break
        a = first
        step = min(2 * step, 1 << 16)
    return a, b


def find_runs(words: np.ndarray, places: np.ndarray, min_length: int = 24, min_periods: int = 3) -> np.ndarray:
    """Rows (first word, length, smallest period) of all runs, ordered by start and period.

    ``words`` are codes of the words of several texts, ``places`` each text's first word and the end.
    """
    if min_periods < 3 or min_length < min_periods:
        raise ValueError("runs of at least three periods")
    lengths = np.diff(places)
    texts = np.repeat(np.arange(len(lengths)), lengths)
    base = (min_length // min_periods).bit_length() - 1
    longest = int(lengths.max(initial=0))
    found: set[tuple[int, int, int]] = set()
    at, names, level = np.arange(len(words)), words, 0
    while len(at) and (min_periods << level) <= longest:
        order, follows, renamed = _successors(names, texts[at])
        if level >= base:
            first, second = at[order[:-1][follows]], at[order[1:][follows]]
            d = second - first
            near = (d < 2 << level) & ((d >= 1 << level) | (level == base))
            first, d = first[near], d[near]
            by = np.lexsort((first, d))
            first, d = first[by], d[by]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (first[1:] != first[:-1] + 1)
            last, done = 0, -1
            for i, q in zip(first[new].tolist(), d[new].tolist()):
                if q == last and i < done:
                    continue
                text = texts[i]
                a, b = _extended(words, q, i, int(places[text]), int(places[text + 1]))
                last, done = q, b
                if b + q - a >= max(min_length, min_periods * q):
                    found.add((a, b + q - a, q))
        again = np.zeros(len(at), bool)
        again[order[:-1][follows]] = again[order[1:][follows]] = True
        named = np.empty(len(at), np.int64)
        named[order] = renamed
        at, names = at[again], named[again]
        other = np.searchsorted(at, at + (1 << level))
        inside = other < len(at)
        inside[inside] = at[other[inside]] == at[inside] + (1 << level)
        inside[inside] &= texts[at[inside]] == texts[at[other[inside]]]
        top = int(names.max(initial=0)) + 1
        at, names = at[inside], names[inside] * top + names[other[inside]]
        level += 1
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _search(min_length: int, min_periods: int):
    def run(batches):
        for batch in batches:
            for at, texts in array_slices(batch, "text", SLICE):
                words = find_words(texts, BETWEEN_SPACES)
                runs = find_runs(words.codes, words.places, min_length, min_periods)
                gone = np.zeros(len(words.codes) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                text = np.searchsorted(words.places, runs[:, 0], side="right") - 1
                fields = [pa.array(runs[:, 0] - words.places[text]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), pa.array(np.diff(words.places), pa.int64()), lists, joined(words, np.cumsum(gone[:-1]) == 0)],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return run


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_periods: int = 3) -> DataFrame:
    """(id, n_words, runs, collapsed) per document.

    ``runs`` lists every run (start, length, period; in words) by start and
    period; ``collapsed`` is the text without the words that lie in a run behind
    its first period, its words joined by one space.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(_search(min_length, min_periods), "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the greatest exact length / period, the first of equals; null if there is none."""
    return F.aggregate(found, F.get(found, F.lit(0)), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def listed(found: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeats planted in about a tenth of the texts, by the crc32 of the id; a null id stays as it is."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words):
        n = F.size(words).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w)), " ")

    text = F.col(f"`{text_col}`")
    planted = let(words_of(text), lambda words: F.when(F.size(words) > 0, rewritten(words)).otherwise(text))
    return docs.withColumn(text_col, F.when((h % 10 == 0) & text.isNotNull(), planted).otherwise(text))
