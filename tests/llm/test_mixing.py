"""Mixture against a recursive budget and a plain walk through the epochs."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from facsimile.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def share_out(budget, children):
    """children: name -> (weight, capacity); plain rounds of redistribution."""
    given = dict.fromkeys(children, 0.0)
    open_ = {n for n, (w, c) in children.items() if w > 0 and c > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[n][0] for n in open_)
        full = {n for n in open_ if given[n] + left * children[n][0] / total >= children[n][1] - 1e-12}
        if not full:
            for n in open_:
                given[n] += left * children[n][0] / total
            break
        part = {n: left * children[n][0] / total for n in open_}
        for n in open_:
            take = min(part[n], children[n][1] - given[n])
            given[n] += take
            left -= take
        open_ -= full
    return given


def plain_targets(leaves, total, weights, epochs):
    def weight(depth, name):
        return weights.get(M.LEVELS[depth], {}).get(name, 1.0)

    def usable(leaf, depth):
        return all(weight(d, leaf[d]) > 0 for d in range(depth, 3))

    def go(path, budget):
        depth = len(path)
        if depth == 3:
            return {path: budget}
        below = {x[: depth + 1] for x in leaves if x[:depth] == path}
        children = {b: (weight(depth, b[-1]), sum(t * epochs for x, t in leaves.items() if x[: depth + 1] == b and usable(x, depth))) for b in below}
        out = {}
        for b, given in share_out(budget, children).items():
            out |= go(b, given)
        return out

    return go((), total)


def corpus(rng, n, names):
    for i in range(n):
        lang = rng.choice(["en", "en", "de", "fr", None])
        yield i, " ".join("w" for _ in range(rng.randint(0, 40))) + str(rng.random()), lang, rng.choice(names)


@pytest.mark.parametrize("seed,budget,epochs", [(1, 1.0, 4), (2, 0.3, 1), (3, 3.0, 4), (4, 9.0, 2)])
def test_targets_and_rows(rows, monkeypatch, seed, budget, epochs):
    monkeypatch.setattr(M, "FEW", 5)  # cut by digits also here
    rng = random.Random(seed)
    data = list(corpus(rng, 500, ["src0", "src0", "src1", "src2", None, "zero"]))
    data += [(9000, None, "en", "src0"), (None, "no id", "en", "src1"), (1, data[1][1], "en", "src0"), (1, data[1][1], "en", "src0")]
    weights = {"domain": {"crawl": 0.7}, "language": {"en": 2.0}, "origin": {"zero": 0.0, "src2": 3.0}}
    docs = rows([(i, t, lang, s, "x") for i, t, lang, s in data], "doc_id bigint, text string, lang string, source string, epoch string")
    place = lambda lang, s: ("crawl" if s == "src0" else "unknown" if s is None else "curated", lang or "unknown", s or "unknown")
    size = lambda t: len(WORD.findall(t or "")) + 1
    leaves = collections.Counter()
    for _, t, lang, s in data:
        leaves[place(lang, s)] += size(t)
    targets = plain_targets(leaves, budget * sum(leaves.values()), weights, epochs)
    want = collections.Counter()
    for leaf, tokens in leaves.items():
        whole = int(targets[leaf] / tokens + 1e-9)
        part = targets[leaf] - whole * tokens
        key = lambda r: hashlib.md5(f"7|{whole}|{'' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()  # noqa: B023, E731
        groups = collections.defaultdict(list)
        for r in data:
            if place(r[2], r[3]) == leaf:
                groups[key(r)].append(r)
        before = 0
        for k in sorted(groups):
            for r in groups[k]:
                for e in range(whole + (before < part - 1e-6)):
                    want[r[0], leaf, e] += 1
            before += sum(size(r[1]) for r in groups[k])
    mixed = M.mix(docs, weights=weights, budget=budget, max_epochs=epochs, carry=False).collect()
    for r in mixed:
        assert r.target == pytest.approx(targets[r.domain, r.language, r.origin])
    assert collections.Counter((r.id, (r.domain, r.language, r.origin), r.epoch) for r in mixed) == want
    carried = M.mix(docs, weights=weights, budget=budget, max_epochs=epochs)
    assert carried.columns == docs.columns
    assert collections.Counter(r.doc_id for r in carried.collect()) == collections.Counter(i for (i, _, _), n in want.items() for _ in range(n))


def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 1000)]
    df = spark.createDataFrame(leaves, "domain string, language string, origin string, tokens bigint")
    got = {(r.domain, r.language, r.origin): r.target for r in M.budgets(df, 800, {"domain": {}, "language": {}, "origin": {}}, 1).collect()}
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "1"): 200, ("b", "x", "1"): 400}


def test_empty(rows):
    docs = rows([(1, "a", "en", "s")], "doc_id bigint, text string, lang string, source string").limit(0)
    assert M.mix(docs).count() == 0 and M.mix(docs, carry=False).count() == 0
    one = rows([(1, None, None, None)], "doc_id bigint, text string, lang string, source string")
    assert M.mix(one).count() == 1
    assert M.mix(one.withColumn("domain", F.lit("d"))).columns == ["doc_id", "text", "lang", "source", "domain"]
