"""Quality statistics against a plain version; the learned list on held-out rows."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from facsimile.llm import quality as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def texts():
    rng = random.Random(3)
    out = ["", None, " \n \t", "one", "# $ & <|>", "a\nb\na\n\n\n \na", "x y \x1c z   w", "é𝔘 " * 30, "a b c d e f g h " * 3, "a b c d e f g h i a b c d e f g h", "q " * 3000]
    for _ in range(60):
        words = [rng.choice(["a", "b", "c", "dd", "e#", "é"]) for _ in range(rng.randint(1, 120))]
        out.append("".join(x + rng.choice([" ", "\n", "  ", "\x0b"]) for x in words))
    return out


def test_statistics(rows):
    data = [(i, t, i) for i, t in enumerate(texts())]
    docs = rows(data, "doc_id bigint, text string, n_words int")
    got = {r.k0: tuple(r.q)[:6] for r in K.text_statistics(docs, [F.col("doc_id")]).collect()}
    assert got == {i: plain(t) for i, t, _ in data}


def sample(rng, n):
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice("the of and to in it is on be at by he or we".split()) + str(rng.randint(0, 400)) for _ in range(rng.randint(40, 200))]
        kind = rng.randint(0, 2)
        if bad:
            words = [w + rng.choice("#$%&") for w in words] if kind == 0 else [w.upper() for w in words] if kind == 1 else words[:4] * 10 + words[4:30]
        yield i, " ".join(words), 0 if bad else 1


def test_list_is_learned_and_keeps_clean_texts(spark, rows):
    train = list(sample(random.Random(1), 500))
    held = [(10_000 + i, t, y) for i, t, y in sample(random.Random(2), 300)]
    docs = rows([(i, t) for i, t, _ in train + held], "doc_id bigint, text string")
    labels = rows([(i, y) for i, _, y in train] + [(None, 0), (3, None)], "doc_id bigint, quality int")
    judged, rules = K.assess(docs, labels)
    assert rules and all(r.conditions for r in rules)
    kept = {r.id: r.kept for r in judged.collect()}
    right = sum(kept[i] == bool(y) for i, _, y in held)
    assert right >= 0.95 * len(held)
    assert all(kept[i] for i, _, y in held if y)
    good = K.keep_good(docs, labels)
    assert good.columns == ["doc_id", "text"]
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, k in kept.items() if k)


def plain_list(rows, cuts, features, least_share=0.005):
    """Sequential covering over rows (label, pruning, values), one row at a time."""
    covers = lambda rule, r: all((r[2][f] > cuts[f][k]) == above for f, above, k in rule)

    def count(rule, some):
        c = [0, 0, 0, 0]
        for r in some:
            if covers(rule, r):
                c[(2 if r[1] else 0) + r[0]] += 1
        return c

    least = max(8, math.ceil(least_share * sum(not y and not p for y, p, _ in rows)))
    rules, left, aside = [], list(rows), set()
    while True:
        rule, counts, inside = [], [], left
        while len(rule) < 4:
            total = count([], inside)
            if total[0] < least or not total[1]:
                break
            before, best = math.log2(total[0] / (total[0] + total[1])), (0.0, None, None)
            for f in features:
                for k in range(len(cuts[f])):
                    for above in (False, True):
                        c = count([(f, above, k)], inside)
                        if (rule or (f, above) not in aside) and c[0] >= least and c[0] + c[1] < total[0] + total[1]:
                            gain = c[0] * (math.log2(c[0] / (c[0] + c[1])) - before)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, above, k), c)
            if not best[1]:
                break
            rule.append(best[1])
            counts.append(best[2])
            inside = [r for r in inside if covers(rule, r)]
            if not best[2][1]:
                break
        if not rule:
            return rules
        good = [(c[0] + c[2]) / sum(c) >= 0.97 and c[2] >= c[3] for c in counts]
        worth = [(c[2] - c[3]) / max(1, c[2] + c[3]) for c in counts]
        keep = worth.index(max(worth))
        if not good[keep]:
            keep = good.index(True) if True in good else None
        if keep is None:
            aside.add(rule[0][:2])
            continue
        rule = rule[: keep + 1]
        rules.append(tuple((f, above, cuts[f][k]) for f, above, k in rule))
        left = [r for r in left if not covers(rule, r)]


def noisy(rng, n):
    """(id, label, a, b, c): a frequent noisy pattern in a, rarer clean ones in b and c."""
    for i in range(n):
        y = int(rng.random() > 0.25)
        a = rng.random() + (0.25 if not y else 0)
        b = rng.random() + (1 if not y and rng.random() < 0.3 else 0)
        c = rng.random() - (1 if not y and rng.random() < 0.2 else 0)
        yield i, y, a, b, c


@pytest.mark.parametrize("seed", [1, 2])
def test_list_equals_a_plain_cover(rows, seed):
    data = list(noisy(random.Random(seed), 700))
    labelled = rows(data, "id bigint, label int, a double, b double, c double").select("id", "label", F.struct("a", "b", "c").alias("q"))
    features = ["a", "b", "c"]
    cuts = K.thresholds(labelled, features)
    plain_rows = [(r.label, r.p, r.q) for r in labelled.select("label", K.for_pruning(F.col("id")).alias("p"), "q").collect()]
    rules = K.fit_decision_list(labelled, features)
    got = [tuple((c.feature, c.above, c.threshold) for c in r.conditions) for r in rules]
    assert got == plain_list(plain_rows, cuts, features)
    # rarer clean patterns behind a noisy one are found
    assert {"b", "c"} <= {c[0] for rule in got for c in rule}


def test_edges(rows):
    docs = rows([(None, None), (1, "short"), (1, "short"), (2, " ".join(f"w{i}" for i in range(30)))], "doc_id bigint, text string")
    labels = rows([(1, 0)], "doc_id bigint, quality int")
    assert sorted((r.id or 0, r.kept) for r in K.assess(docs, labels)[0].collect()) == [(0, False), (1, False), (1, False), (2, True)]
    none = labels.limit(0)
    assert [r.doc_id for r in K.keep_good(docs, none).collect()] == [2]
    assert K.keep_good(docs.limit(0), labels).count() == 0
    assert K.assess(docs.limit(0), none)[0].count() == 0
    clash = docs.withColumnsRenamed({}).withColumn("q", F.lit(1)).withColumn("k0", F.lit(2)).withColumn("t", F.lit("x")).withColumn("id", F.lit(7))
    assert K.keep_good(clash, labels).columns == ["doc_id", "text", "q", "k0", "t", "id"]
