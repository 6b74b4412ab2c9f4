"""Alignment of two vocabularies against whole-text encodings."""

import collections
import functools
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from facsimile.llm import alignment, queries, tokens
from tests.conftest import SMALL
from tests.llm.test_tokens import ODD, soup


@pytest.fixture(scope="module")
def groups_of():
    """Ids of both vocabularies and the groups of a text, from whole encodings."""
    a_model = Tokenizer.from_file(tokens.default_vocabulary())
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=tokens.default_pieces())
    back = {c: b for b, c in tokens.byte_letters().items()}
    a_bytes = functools.cache(lambda i: bytes(back[c] for c in a_model.id_to_token(i)))
    b_bytes = functools.cache(lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode())

    def run(text):
        if not text:
            return [], [], []
        a, b, raw = a_model.encode(f" {text}", add_special_tokens=False).ids, b_model.encode(text), f" {text}".encode()
        if b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            return [], [], []
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes, a), (b_bytes, b))]
        out, i, j = [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(c) + 1, ends[1].index(c) + 1
            out.append((a[i:x], b[j:y]))
            i, j = x, y
        return a, b, out

    return run


def plain(rows, groups_of):
    found = [(doc, *groups_of(text)) for doc, text in rows]
    links = collections.Counter((x[-1], y[-1]) for *_, groups in found for x, y in groups)
    most = collections.Counter()
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    out = []
    for doc, a, b, groups in found:
        pairs = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(pairs), sum(links[p] == most[p[1]] for p in pairs), sum(links[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["alpha", "Beta,", "γ", "42", "\n", "naïve", "don't"]) for _ in range(n))
    data = list(enumerate([*ODD, *soup(200), None, "", " ", "▁x", "a" * 3000, "é" * 2000 + " x " + "中文" * 1500, prose(3000)]))
    return data + [(5, "tie"), (5, "tie"), (None, "no id"), (None, None)]


@pytest.mark.parametrize("range_bytes", [1 << 16, 300, 7])
def test_ranges_of_any_size_give_the_same_result(rows, groups_of, range_bytes):
    data = corpus() if range_bytes > 7 else [r for r in corpus() if r[1] is None or len(r[1]) < 400]
    docs = rows([(*r, "x", 1) for r in data], "doc_id bigint, text string, a string, part int")
    got = alignment.summaries(alignment.align(docs, range_bytes=range_bytes)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(data, groups_of)


def random_fragment(rng, n):
    a, b = (np.array(rng.choices(range(50), k=rng.randint(0, n)), np.uint16) for _ in range(2))
    cuts = rng.randint(0, min(len(a), len(b)))
    return alignment.fragment(a, b, *(np.array(sorted(rng.sample(range(len(x)), cuts)), np.int64) for x in (a, b)))


def test_composition_is_associative():
    rng = random.Random(7)
    for _ in range(300):
        x, y, z = (random_fragment(rng, 6) for _ in range(3))
        left, right = alignment.compose(alignment.compose(x, y), z), alignment.compose(x, alignment.compose(y, z))
        assert all(np.array_equal(left[k], right[k]) for k in left)
        empty = alignment.fragment(*(np.zeros(0, np.uint16),) * 2, *(np.zeros(0, np.int64),) * 2)
        assert all(np.array_equal(alignment.compose(empty, x)[k], x[k]) and np.array_equal(alignment.compose(x, empty)[k], x[k]) for k in x)


def test_ranges_cover_a_text_once_and_stay_short():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 2000)
        safe = np.array(sorted({0, *rng.sample(range(n), rng.randint(0, min(n, 30)))}))
        step = rng.randint(1, 300)
        found = alignment.byte_ranges(n, safe, step)
        assert [r[0] for r in found] == [0, *(r[1] for r in found[:-1])] and found[-1][1] == n
        assert all(first <= low < high <= last and first in safe and (last in safe or last == n) for low, high, first, last in found)
        assert sum(last - first for _, _, first, last in found) <= 4 * n + 2 * step


def test_pairs_are_bounded_by_the_vocabularies(rows):
    pairs, counts = alignment.pair_counts(alignment.align(rows(corpus(), "doc_id bigint, text string")))
    a, b = tokens.encoder(tokens.default_vocabulary()).token_bytes(), tokens.encoder(tokens.default_pieces(), tokens.PieceEncoder).token_bytes()
    assert all(a[p >> 16].endswith(b[p & 0xFFFF]) or b[p & 0xFFFF].endswith(a[p >> 16]) for p in pairs.tolist())
    assert (np.diff(pairs) > 0).all() and (counts > 0).all() and len(pairs) <= alignment.most_pairs() < 400_000


def test_sizes_of_any_number_are_packed():
    numbers = np.array([0, 1, 254, 255, 256, 509, 510, 511, 70_000, 1, 0])
    data, places = alignment.packed(numbers)
    back, upto = alignment.unpacked(data)
    assert back.tolist() == numbers.tolist() and upto[places].tolist() == list(range(len(numbers) + 1))
    assert [x.tolist() for x in alignment.unpacked(alignment.packed(np.zeros(0, np.int64))[0])] == [[], [0]]


def test_empty_table(rows):
    assert alignment.summaries(alignment.align(rows([], "doc_id bigint, text string"))).collect() == []


def test_query_on_a_whole_table(spark, groups_of):
    got = queries.QUERIES["op11_tokenizer_alignment"](spark, SMALL).collect()
    data = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == plain([tuple(r) for r in data], groups_of)
