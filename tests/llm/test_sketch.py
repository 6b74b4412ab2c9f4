"""Bottom-k sketches against exact sets and a plain walk over documents."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from facsimile.llm import sketch as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def walk(data):
    """(id, text, edited, next) in descending id order; ties are not used here."""
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 2
        yield k, t, t[: len(t) - cut] + nxt[:cut], nxt


@pytest.mark.parametrize("n", [1, 2, 7, 90])
def test_edited_texts_and_likeness(rows, n):
    rng = random.Random(n)
    data = [(i * 7 - 20, " ".join(rng.choice(["a", "bé", "𝔘x", "d", "ee"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 150)))) for i in range(n)]
    if n > 5:
        data[2] = (data[2][0], None)
        data[3] = (data[3][0], data[4][1])
        data.append((None, "no id at all here"))
    docs = rows([(i, t, 0) for i, t in data], "doc_id bigint, text string, part int")
    out = K.edited(docs).select("*", K.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("a"), K.resemblance(F.col("sketch"), F.col("next_sketch")).alias("b"))
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(data)
    for k, t, new, nxt in walk(data):
        r = got[k]
        assert r.n_chars == len(t) and r.edited == new
        for value, other in ((r.a, new), (r.b, nxt)):
            x, y = shingles(t), shingles(other)
            exact = len(x & y) / len(x | y) if x | y else 1.0
            assert value == pytest.approx(exact, abs=1e-9 if len(x | y) <= K.SIZE else 0.2)


def test_large_sets_merge_and_counts(spark):
    words = [str(i) for i in range(9000)]
    data = [(1, " ".join(words[:6000])), (2, " ".join(words[2000:8000])), (3, " ".join(words[:8000]))]
    s = {r.id: r.sketch for r in K.sketches(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    df = spark.createDataFrame([(s[1], s[2], s[3])], "a array<bigint>, b array<bigint>, c array<bigint>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    r = df.select(K.resemblance(a, b).alias("j"), K.distinct_count(a).alias("n"), K.containment(a, b).alias("c"), K.merge(a, b).alias("m"), K.resemblance(a, c).alias("jc")).first()
    assert r.j == pytest.approx(0.5, abs=0.15) and r.n == pytest.approx(5996, rel=0.3) and r.c == pytest.approx(0.67, abs=0.25) and r.jc == pytest.approx(0.75, abs=0.13)
    assert len(r.m) == K.SIZE and r.m == sorted(set(s[1]) | set(s[2]))[: K.SIZE]


def test_ties_and_empty(rows):
    docs = rows([(4, "one"), (4, "two"), (4, "two"), (9, "nine nine"), (None, None)], "doc_id bigint, text string")
    got = K.edited(docs).collect()
    assert len(got) == 5
    assert sorted(r.edited for r in got if r.id is None) == [""]
    assert K.edited(docs.limit(0)).count() == 0
    only = rows([(None, "lonely text of a few words")], "doc_id bigint, text string")
    assert K.edited(only).first().next_sketch == K.edited(only).first().sketch
    assert hashlib.sha256(b"").hexdigest()  # the digest the query derives for empty texts
