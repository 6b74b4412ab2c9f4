"""Lattice scores against an enumeration of segmentations and plain counts."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from facsimile.llm import lattice_lm as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small():
    return M._normalised({"▁": 3.0, "▁a": 2.0, "a": 1.0, "ab": 4.0, "b": 1.0, "aba": 0.5, "é": 0.2}, [0.01] * 256, 0.7)


def enumerate_all(v, text):
    if not text:
        yield 0.0, []
        return
    found = False
    for j in range(1, len(text) + 1):
        if text[:j] in v.pieces:
            found = found or j == 1
            for p, rest in enumerate_all(v, text[j:]):
                yield v.pieces[text[:j]] + p, [text[:j], *rest]
    if not found:
        own = list(text[0].encode())
        for p, rest in enumerate_all(v, text[1:]):
            yield sum(v.spelled[b] for b in own) + p, own + rest


WORDS = ["", "a", "abab", "abaé", "xab", "ab𝔘a", "aaaaaaa", "a", "ba", "▁a"]


def test_forward_and_use_sum_all_segmentations(monkeypatch):
    v = small()
    totals, want = [], collections.Counter()
    for n, word in enumerate(WORDS, 1):
        paths = list(enumerate_all(v, "▁" + word))
        totals.append(math.log(sum(math.exp(p) for p, _ in paths)))
        for p, pieces in paths:
            for x in pieces:
                want[x] += n * math.exp(p - totals[-1])
    lattice = M.Lattice(v)
    for group in (M.GROUP, 12, 1):
        monkeypatch.setattr(M, "GROUP", group)
        assert lattice.forward(WORDS).tolist() == pytest.approx(totals)
        pieces, spelled = lattice.expected_use(WORDS, np.arange(1.0, len(WORDS) + 1))
        got = {k: x for k, x in [*zip(lattice.names, pieces.tolist()), *enumerate(spelled.tolist())] if x}
        assert {k: pytest.approx(x) for k, x in want.items()} == got


def test_long_words_do_not_underflow():
    got = M.Lattice(small()).forward(["ab" * 20_000, "a"])
    assert -1e6 < got[0] < -1e3 and got[1] > -10


def plain_log(v, word):
    """Log probability of a word, by a memory of its suffixes."""
    text, memory = "▁" + word, {}
    for i in range(len(text), -1, -1):
        if i == len(text):
            memory[i] = 0.0
            continue
        ways = [v.pieces[text[i:j]] + memory[j] for j in range(i + 1, min(len(text), i + v.longest) + 1) if text[i:j] in v.pieces]
        if text[i] not in v.pieces:
            ways.append(sum(v.spelled[b] for b in text[i].encode()) + memory[i + 1])
        top = max(ways)
        memory[i] = top + math.log(sum(math.exp(w - top) for w in ways))
    return memory[0]


def plain_scores(data, rounds=1):
    """Each document's score in log10, by numerical derivation of the training words' likelihood for the expected uses."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data}
    lower = lambda t: t.encode().lower().decode()
    words = {k: WORD.findall(lower(t or "")) for k, (_, t) in enumerate(data)}
    v = M.read_vocabulary(M.default_model())
    train = collections.Counter(w for k, (i, _) in enumerate(data) if not held[i] for w in words[k])
    ends = sum(not held[i] for i, _ in data)
    for _ in range(rounds):
        pieces, spelled = dict.fromkeys(v.pieces, M.SMOOTH), [M.SMOOTH] * 256
        for w, c in train.items():
            total = plain_log(v, w)
            text = "▁" + w
            for x in {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)} & v.pieces.keys():
                old = v.pieces[x]
                v.pieces[x] = old + 1e-5
                pieces[x] += c * (plain_log(v, w) - total) / 1e-5
                v.pieces[x] = old
            for b in {b for ch in text if ch not in v.pieces for b in ch.encode()}:
                v.spelled[b] += 1e-5
                spelled[b] += c * (plain_log(v, w) - total) / 1e-5
                v.spelled[b] -= 1e-5
        v = M._normalised(pieces, spelled, ends + M.SMOOTH)
    return [((data[k][0], len(words[k]) + 1), (sum(plain_log(v, w) for w in words[k]) + v.end) / math.log(10)) for k in words]


def plain(data):
    def toks(t):
        return [w.lower() if w.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(t or "")] + [None]

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data}
    count = collections.Counter(w for i, t in data if not held[i] for w in toks(t))
    n, v = sum(count.values()), len(count)
    for i, t in data:
        ts = toks(t)
        yield i, held[i], len(ts), sum(count[w] > 0 for w in ts), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ts)


@pytest.mark.parametrize("head", [3, 200_000])
def test_documents(rows, monkeypatch, head):
    monkeypatch.setattr(M, "HEAD", head)
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(["The", "the", "été", "İx", "running", "q𝔘", "of", "w" * 100]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    data += [(500, None), (500, ""), (None, "the end"), (7, "the the"), (900, "\x1c \x85 \xa0 </s>")]
    docs = rows([(i, t, 0.5) for i, t in data], "doc_id bigint, text string, score double")
    got = M.score(docs).collect()
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:4], round(r[5], 6))
    mine = sorted(key((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in got)
    assert [m[:4] for m in mine] == [p[:4] for p in sorted(map(key, plain(data)))]
    assert [m[4] for m in mine] == pytest.approx([p[4] for p in sorted(map(key, plain(data)))])
    assert len({r.train_tokens for r in got}) == 1
    order = lambda x: repr(x[0])
    mine, want = sorted((((r.id, r.n_tokens), r.score) for r in got), key=order), sorted(plain_scores(data), key=order)
    assert [m[0] for m in mine] == [w[0] for w in want]
    assert sorted(m[1] for m in mine) == pytest.approx(sorted(w[1] for w in want), rel=1e-5)
    only_end = [r.score for r in got if r.id == 500]
    assert len(only_end) == 2 and only_end[0] == only_end[1]
    assert M.score(docs.limit(0)).count() == 0


def test_training_helps_held_out_texts(rows):
    rng = random.Random(6)
    data = [(i, " ".join(rng.choice("thaner ertion onnthe andere stille".split()) for _ in range(40))) for i in range(120)]
    docs = rows(data, "doc_id bigint, text string")
    before, after = ({r.id: r.score for r in M.score(docs, rounds=k).collect() if r.held_out} for k in (0, 1))
    assert before and all(after[i] > before[i] for i in before)
