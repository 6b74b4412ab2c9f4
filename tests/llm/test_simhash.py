"""SimHash near-duplicates against a plain all-pairs version."""

import random

import numpy as np
import pytest
import xxhash

from facsimile.llm import simhash as S
from facsimile.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, bits=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints():
    rng = random.Random(5)
    texts = ["", " \n\t", "One", "one two", "one two three", "É é Z z\x0bq", "a b c " * 500]
    texts += [" ".join(rng.choice(["ab", "Cd", "é", "zz", "q"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    for t in texts:
        assert S.fingerprint_of(t.encode()) == plain_fingerprint(t)
    long = " ".join(str(rng.random()) for _ in range(70_000))  # over one chunk of hashes
    hashes = np.array([xxhash.xxh64_intdigest(s, seed=42) for s in [b" ".join(w) for w in zip(*(long.encode().split()[k:] for k in range(3)))]], dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert S.fingerprint_of(long.encode()) == want


def test_anchor_code_is_perfect(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(200)] + [0, (1 << 64) - 1, 1, 1 << 31, 1 << 32]
    got = S.anchors(spark.createDataFrame([(signed(v),) for v in values], "fp bigint")).collect()
    for v in values:
        for side in (0, 1):
            half = v >> 32 * side & S.LOW31
            mine = [r for r in got if r.fp == signed(v) and r.side == side]
            assert all((half ^ r.anchor).bit_count() <= 2 for r in mine)
            assert [(half ^ r.anchor).bit_count() <= 1 for r in mine if r.home] == [True]
            assert len({r.anchor for r in mine}) == len(mine) in (1, 16)
            assert all((r.anchor & m).bit_count() % 2 == 0 for r in mine for m in S.PARITY_MASKS)


@pytest.mark.parametrize("block", [4, 512])
def test_links_join_up_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(values)[:12]:  # dense groups and chains
        at = centre
        for _ in range(rng.choice([2, 40])):
            step = at if rng.random() < 0.5 else centre
            at = step
            for b in rng.sample(range(64), rng.randint(1, 4)):
                at ^= 1 << b
            values.add(at)
    values = sorted(values)
    found = S.links(spark.createDataFrame([(signed(v),) for v in values], "fp bigint")).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1) for r in found)
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame([(r.a, r.b) for r in found], "a bigint, b bigint")).collect()}
    want = plain_components(values)
    classes = {}
    for v in values:
        classes.setdefault(want[v], set()).add(roots.get(signed(v), signed(v)))
    assert all(len(x) == 1 for x in classes.values())
    assert len({next(iter(x)) for x in classes.values()}) == len(classes)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_documents_with_awkward_rows(rows):
    base = "the quick brown fox jumps over the lazy dog near the old river bank " * 30
    data = [(5, base, "x"), (3, base + "now", "x"), (9, base, "y"), (9, base, "y"), (None, base, "z"), (1, "", "q"), (2, None, "q"), (None, "only null id here", "r"), (8, "wholly other words " + "zeta eta theta " * 40, None)]
    docs = rows(data, "doc_id bigint, text string, fp string")
    got = {(r.id, r.fp): r.component_id for r in S.near_duplicates(docs).collect()}
    close = (plain_fingerprint(base) ^ plain_fingerprint(base + "now")).bit_count() <= 3
    assert got[5, signed(plain_fingerprint(base))] == (3 if close else 5)
    assert got[1, 0] == got[2, 0] == 1
    assert got[None, signed(plain_fingerprint("only null id here"))] is None
    assert S.near_duplicates(docs).count() == len(data)
    kept = S.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == ([0, 1, 3, 8] if close else [0, 1, 3, 5, 8])
    assert S.near_duplicates(docs.limit(0)).count() == 0 == S.keep_one(docs.limit(0)).count()
