"""Benchmark windows against a plain search of every window."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from facsimile.llm import queries, winnow
from facsimile.llm.words import ALPHANUMERIC, find_words
from tests.conftest import SMALL


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, span=10):
    """(id, n_words, n_hit, item ids) of each document."""
    known = {}
    for item, text in items:
        words = plain_words(text)
        m = min(len(words), span)
        for i in range(len(words) - m + 1 if m else 0):
            known.setdefault(tuple(words[i : i + m]), set()).add(item)
    sizes = {len(k) for k in known}
    out = []
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for m in sizes:
            for i in range(len(words) - m + 1):
                if (who := known.get(tuple(words[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= who
        out.append((doc, len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def measured(docs, items, **kw):
    F = winnow.F
    found = winnow.contamination(docs, items, **kw).select("id", "n_words", winnow.hit_words(F.col("spans")).alias("n"), "items", "spans").collect()
    for r in found:  # spans are maximal and in order
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.id, r.n_words, r.n, r["items"]) for r in found), key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["one", "Two", "drei", "été", "5", "x1", "γ"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice([1, 2, 4, 6, 9, 10, 11, 15, 40]) if i % 3 else rng.randint(12, 30))) for i in range(3, 30)]
    items += [(7, items[4][1]), (7, items[4][1]), (None, prose(12)), (500, None), (501, ""), (502, "--- !"), (503, items[0][1] + " more words"), (504, "same " * 14)]
    docs = [(i, prose(rng.randint(0, 80))) for i in range(60)]
    for i in range(60, 110):
        text = rng.choice([t for _, t in items if t])
        words = re.split(r" +", text)
        a = rng.randint(0, max(0, len(words) - 1))
        docs.append((i, f"{prose(rng.randint(0, 20))}, {' -- '.join(words[a : a + rng.randint(5, 30)]).upper()}! {prose(3)}"))
    docs += [(200, None), (201, ""), (202, "same " * 50), (203, " ".join(t for _, t in items if t)), (203, "tie"), (203, "tie"), (None, items[0][1]), (None, None)]
    return docs, items


def test_windows_equal_a_plain_search(rows):
    docs, items = corpus()
    made = rows([(*d, 1, "x") for d in docs], "doc_id bigint, text string, items int, row string"), rows([(*i, 2) for i in items], "item_id bigint, text string, line int", parts=2)
    assert measured(*made) == plain(docs, items)
    long_items = [i for i in items if len(plain_words(i[1])) >= 10]
    assert measured(made[0], rows(long_items, "item_id bigint, text string"), span=10, gram=3) == plain(docs, long_items)


def test_full_bit_table_only_adds_rows_to_the_join(rows, monkeypatch):
    """With hardly any bits every window goes on, and the joined words decide."""
    monkeypatch.setattr(winnow, "MIN_BITS", 3)
    monkeypatch.setattr(winnow, "MAX_BITS", 3)
    docs, items = corpus(6)
    assert measured(rows(docs, "doc_id bigint, text string"), rows(items, "item_id bigint, text string")) == plain(docs, items)


def test_one_passage_in_all_documents(rows):
    passage = "a passage of rather many words that each of all these documents holds in the middle"
    docs = [(i, f"start {i} {passage} end {i}") for i in range(400)]
    items = [(i, f"item {i} {passage}") for i in range(50)]
    assert measured(rows(docs, "doc_id bigint, text string"), rows(items, "item_id bigint, text string")) == plain(docs, items)


def test_every_long_shared_span_has_a_shared_fingerprint():
    rng = random.Random(1)
    words = [rng.choice("abc") for _ in range(4000)]
    texts = find_words(pa.array([" ".join(words)]), ALPHANUMERIC, lower=True)
    first, kept = winnow.windows(texts, winnow.word_hashes(texts), 10, 6)
    assert first.tolist() == list(range(len(words) - 9))
    by_words = {}
    for i, fp in zip(first.tolist(), kept.tolist()):
        assert by_words.setdefault(tuple(words[i : i + 10]), fp) == fp
    grams = winnow.gram_hashes(winnow.word_hashes(texts), 6)
    assert all(fp == min(grams[i : i + 5].tolist()) for i, fp in zip(first.tolist(), kept.tolist()))
    assert len(np.unique(kept)) < len(np.unique(grams))


def test_empty_tables(rows):
    docs, items = rows([(1, "a b c")], "doc_id bigint, text string"), rows([], "item_id bigint, text string")
    assert measured(docs, items) == [(1, 3, 0, [])]
    assert measured(rows([], "doc_id bigint, text string"), rows([(1, "a b")], "item_id bigint, text string")) == []


def test_query_on_a_whole_table(spark):
    got = queries.QUERIES["op12_winnowing_decontamination"](spark, SMALL).collect()
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet").select(k, "text").collect() for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in plain(docs, items)]
    assert sorted(map(tuple, got)) == sorted(want) and any(r.contaminated for r in got)
