"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from facsimile.llm import periods, queries
from tests.conftest import SMALL


def plain_runs(words, min_length=24, min_periods=3):
    """All runs of a list of words, by every period and every maximal stretch."""
    n, out = len(words), []
    for q in range(1, n // min_periods + 1):
        x = 0
        while x < n - q:
            if words[x] != words[x + q]:
                x += 1
                continue
            y = x
            while y < n - q and words[y] == words[y + q]:
                y += 1
            run = words[x : y + q]
            if len(run) >= max(min_length, min_periods * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((x, len(run), q))
            x = y + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc, text, planted=True):
    """The contract's columns of one document."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if planted and doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(listed), digest(kept))


def broken(rng):
    """A list of words made of repeated blocks."""
    words = []
    while rng.random() < 0.8:
        letters = rng.randint(1, 4)
        block = [rng.randint(0, letters) for _ in range(rng.randint(1, rng.choice([2, 5, 20, 40])))]
        words += (block * rng.randint(1, 12))[: rng.randint(1, 200)]
    return words


@pytest.mark.parametrize("min_length, min_periods", [(24, 3), (6, 3), (10, 4), (3, 3)])
def test_runs_equal_those_of_every_period(min_length, min_periods):
    rng = random.Random(min_length)
    for _ in range(150):
        texts = [broken(rng) for _ in range(rng.randint(0, 5))]
        places = np.cumsum([0, *map(len, texts)])
        got = periods.find_runs(np.array([w for t in texts for w in t], np.int64), places, min_length, min_periods)
        want = [(int(places[i]) + s, length, q) for i, t in enumerate(texts) for s, length, q in plain_runs(t, min_length, min_periods)]
        assert [tuple(r) for r in got.tolist()] == want


def test_random_words_of_two_letters():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2, 3000)
    got = periods.find_runs(words, np.array([0, 1000, 1000, 3000]), 6, 3)
    want = [(a + s, n, q) for a, b in ((0, 1000), (1000, 3000)) for s, n, q in plain_runs(words[a:b].tolist(), 6, 3)]
    assert [tuple(r) for r in got.tolist()] == want


def test_one_word_repeated_many_times():
    words = np.zeros(300_000, np.int64)
    assert periods.find_runs(words, np.array([0, 300_000])).tolist() == [[0, 300_000, 1]]


def test_two_periods_are_refused():
    with pytest.raises(ValueError):
        periods.find_runs(np.zeros(9, np.int64), np.array([0, 9]), 24, 2)


def corpus():
    rng = random.Random(8)
    data = [(i, " ".join(f"w{x}é" for x in broken(rng))) for i in range(60)]
    data += [(100, None), (101, ""), (102, " \t\n"), (None, "a b " * 20), (None, None), (103, "tie " * 40), (103, "tie " * 40), (104, "\x1c \xa0 ▁ x\x0by"), (105, "a b c " * 9000 + "end"), (106, "x y " * 12 + "q " * 30)]
    return data


def test_documents(rows):
    data = corpus()
    docs = rows([(i, t, "no") for i, t in data], "doc_id bigint, text string, runs string")
    found = periods.runs(periods.with_repeats(docs)).withColumn("best", periods.strongest(periods.F.col("runs")))
    F = periods.F
    got = found.select("id", F.size("runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")), F.sha2(periods.listed(F.col("runs")).cast("binary"), 256), F.sha2("collapsed", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_row(i, t) for i, t in data), key=repr)


def test_empty_table(rows):
    assert periods.runs(periods.with_repeats(rows([], "doc_id bigint, text string"))).collect() == []


def test_query_on_a_whole_table(spark):
    got = queries.QUERIES["op13_periodic_runs"](spark, SMALL).collect()
    data = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted((plain_row(*r) for r in data), key=lambda r: r[0])
