"""Markov walks: held and as tables, against a plain walk with the same draws."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from facsimile.functions.draws import Draws
from facsimile.operators import markov as M
from facsimile.operators import synth


def uniform(seed, name, i, tag):
    return int(hashlib.md5(f"{seed}:{name}:{i}:{tag}".encode()).hexdigest()[:13], 16) / 2**52


def plain_walks(texts, name, seed, n):
    follow = {}
    for t in texts:
        words = t.split()
        for a, b in zip(words, words[1:]):
            follow.setdefault(a.lower(), Counter())[b] += 1
    by_bytes = lambda w: w.encode()
    keys = sorted(follow, key=by_bytes)
    length = max(1, int(sum(len(t.split()) for t in texts) / len(texts)))
    out = []
    for i in range(n):
        word = keys[int(uniform(seed, name, i, "start") * len(keys))]
        words = [word[:1].upper() + word[1:].lower()]
        for j in range(1, length):
            successors = follow.get(word.lower())
            if successors is None:
                word = keys[int(uniform(seed, name, i, f"r{j}") * len(keys))]
            else:
                at = int(uniform(seed, name, i, f"m{j}") * sum(successors.values()))
                for word in sorted(successors, key=by_bytes):
                    at -= successors[word]
                    if at < 0:
                        break
            words.append(word)
        out.append((i, " ".join(words)))
    return out


def texts_of(seed=1):
    rng = random.Random(seed)
    some = ["the", "The", "cat", "Émile", "sat", "on", "a", "mat.", "dog", "ran"]
    texts = [" ".join(rng.choices(some, weights=[30, 5, *[1] * 8], k=rng.randint(2, 40))) + f" end{k}" for k in range(40)]
    return texts + ["alone", ""]


def test_bigrams_of_odd_white_space_equal_plain_counts(spark):
    texts = ["  The cat sat\n", "\u00a0the\u0085Cat\u3000sat \t\r\n", "the cat", "", " ", "\n\t\u2003", "one", " one ", "one\u2028two", "İx ẞa İx ẞa", "ΟΔΟΣ ΟΔΟΣ a\u200bb", "a\x1cb \x1c a\u0301", "x x x x"]
    rows = [(t,) for t in [*texts, None, *texts]]
    expected = Counter()
    for (t,) in rows:
        found = re.findall(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", t or "")
        expected.update((a.lower(), b) for a, b in zip(found, found[1:]))
    got = [tuple(r) for r in M.bigrams(spark.createDataFrame(rows, "`t.x` string").repartition(3), "t.x").collect()]
    assert len(got) == len(expected) and {(k, b): n for k, b, n in got} == expected


def test_bigrams_split_a_text_once_and_shuffle_one_string(spark, tmp_path):
    spark.createDataFrame([("a b c",), (" a b ",)], "t string").write.parquet(str(tmp_path / "t"))
    out = M.bigrams(spark.read.parquet(str(tmp_path / "t")), "t")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(t#") == 1 and "regexp" not in plan
    assert re.search(r"Aggregate \[pair#\d+\],", plan)


@pytest.mark.parametrize("held", [True, False])
def test_walks_equal_a_plain_walk(spark, monkeypatch, held):
    if not held:
        monkeypatch.setattr(M, "HELD_ROWS", 0)
    texts = texts_of()
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "`t.x` string").repartition(3)
    model = M.MarkovModel(df, "t.x")
    assert model.usable and model.length > 2 * M.STEPS
    got = sorted(tuple(r) for r in M.walk(model, spark.range(50), 7).collect())
    assert got == plain_walks(texts, "t.x", 7, 50)


@pytest.mark.parametrize("walked", [M.WALKED, 7])
def test_files_of_a_large_model_equal_a_plain_walk(spark, monkeypatch, walked):
    """A model too large to send is mapped: no job for each few steps, no table of walkers."""
    monkeypatch.setattr(M, "MAPPED_ROWS", 0)
    texts = [*texts_of(), "ẞa ẞa b", "İx İx ßy ßy c\u00a0d"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "`t.x` string").repartition(3)
    model = M.MarkovModel(df, "t.x")
    assert model.files
    written = []
    real = M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: written.append(1) or real(df))
    mapped = sorted(tuple(r) for r in M.walk(model, spark.range(50).repartition(2), 7).collect())
    assert not written
    monkeypatch.setattr(M, "MAPPED_ROWS", 1 << 40)
    assert mapped == sorted(tuple(r) for r in M.walk(M.MarkovModel(df, "t.x"), spark.range(50), 7).collect())
    plain = M.MarkovModel(spark.createDataFrame([(t,) for t in texts_of()], "t string"), "t")
    monkeypatch.setattr(M, "MAPPED_ROWS", 0)
    again = M.MarkovModel(spark.createDataFrame([(t,) for t in texts_of()], "t string"), "t")
    assert again.files and not plain.files
    run = M._walk_mapped(again.files, "7:t:", again.length, again.n_keys)
    monkeypatch.setattr(M, "WALKED", walked * again.length)
    monkeypatch.setattr(M, "TEXT_BYTES", 40 * walked)
    import pyarrow as pa

    out = [r for b in run([pa.RecordBatch.from_pydict({"id": list(range(50))})]) for r in b.to_pylist()]
    assert [(r["id"], r["text"]) for r in out] == plain_walks(texts_of(), "t", 7, 50)


def test_no_bigram_of_a_large_model_is_a_row(spark, monkeypatch):
    """The pairs are numbers in files; parts, stretches and buckets of few words give the same texts."""
    hot = ["a b " * 30 + "c", "A b", "the  \u2003the the\n", "x" * 300 + " the \u00e9\u0085the"]
    texts = [*texts_of(4), *hot, *["b a"] * 20]
    for name, value in (("MAPPED_ROWS", 0), ("SLOTS", 1 << 40), ("SLOT_LEAST", 6), ("SLOT_MOST", 6), ("PART_BYTES", 60), ("BUCKET_BITS", 2), ("WALKED", 5)):
        monkeypatch.setattr(M, name, value)
    monkeypatch.delattr(M, "bigrams")
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(3)
    model = M.MarkovModel(df, "t")
    assert model.files and model.texts == len(texts)
    assert sorted(tuple(r) for r in M.walk(model, spark.range(60), 3).collect()) == plain_walks(texts, "t", 3, 60)


def test_texts_without_pairs_are_not_laid_out(spark, monkeypatch):
    monkeypatch.setattr(M, "MAPPED_ROWS", 0)
    for texts in (["one", "", " two "], [""]):
        model = M.MarkovModel(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
        assert not model.files and not model.usable


def test_texts_are_cut_at_the_white_space_of_the_bigrams():
    texts = ["  The cat sat\n", "\u00a0the\u0085Cat\u3000sat \t\r\n", "", "", "the cat", " ", "\n\t\u2003", "one", "one\u2028two", "x\u205fy\u1680z\u202f", "a\u200bb \x1cc", "\u2001\u2030\u3001\u00a1\u1681 \u00e9", "end"]
    sizes = np.cumsum([len(t.encode()) for t in texts])
    flat, lengths, last = M._words_of(np.frombuffer("".join(texts).encode(), np.uint8), sizes)
    found = [re.findall(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", t) for t in texts]
    ends = np.cumsum(lengths)
    assert [flat[b - n : b].tobytes().decode() for b, n in zip(ends, lengths)] == [w for words in found for w in words]
    assert last.tolist() == [k == len(words) - 1 for words in found for k in range(len(words))]


def test_words_whose_digests_begin_alike_have_their_own_numbers(monkeypatch, tmp_path):
    import pyarrow as pa

    words = [b"a", b"b", b"c", b"d"]
    monkeypatch.setattr(M, "_digests", lambda some: (np.array([5 if w != b"d" else 1 << 59 for w in some]), np.array([w[0] for w in some])))
    one, two = M._digests(words)
    batch = pa.RecordBatch.from_pydict({"bucket": one >> 59, "one": one, "two": two, "number": np.arange(4, dtype=np.int32)})
    assert [r["rows"] for b in M._put_digests(str(tmp_path))([batch]) for r in b.to_pylist()] == [4]
    assert M._numbers_of(str(tmp_path), 1, [b"c", b"x", b"d", b"a", b"b"]).tolist() == [2, -1, 3, 0, 1]


@pytest.mark.parametrize("key", ["7:t.x:", "1:\u00e9" + "x" * 30 + ":", "1:" + "y" * 60 + ":"])
def test_draws_of_arrays_equal_the_digests(key):
    ids = np.array([0, 9, 10, 99, 100, 12345, -3, 10**18 - 1, 10**18, 2**63 - 1, -(2**63)])
    draws = Draws(key, ids)
    for tag in ("start", "m1", "r517"):
        assert draws.uniform(tag).tolist() == [int(hashlib.md5(f"{key}{i}:{tag}".encode()).hexdigest()[:13], 16) / 2**52 for i in ids.tolist()]


def test_a_folder_that_is_not_mounted_keeps_the_table(spark, monkeypatch):
    monkeypatch.setattr(M, "checkpoint_dir", lambda spark: "hdfs://nowhere/kept")
    assert M._mapped_folder(spark) is None


def test_rows_walked_in_parts(spark, monkeypatch):
    texts = texts_of(2)
    model = M.MarkovModel(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    held = type("Held", (), {"value": M._held(model)})
    monkeypatch.setattr(M, "WALKED", 3 * model.length)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"id": list(range(a, a + 25))}) for a in (0, 25)]
    out = [r for b in M._walk_rows(held, "7:t:", model.length, model.n_keys)(batches) for r in b.to_pylist()]
    assert [(r["id"], r["text"]) for r in out] == plain_walks(texts, "t", 7, 50)


def test_steps_of_a_job_share_the_transitions(spark, monkeypatch):
    """One job for STEPS steps, not one for each word."""
    monkeypatch.setattr(M, "HELD_ROWS", 0)
    model = M.MarkovModel(spark.createDataFrame([(t,) for t in texts_of(3)], "t string"), "t")
    written = []
    real = M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: written.append(1) or real(df))
    M.walk(model, spark.range(4), 1).collect()
    assert len(written) == 1 + -(-model.length // M.STEPS)


def test_few_texts_are_sampled(spark):
    df = spark.createDataFrame([("one two",), ("three four",)], "t string")
    out = synth.generate(synth.fit(df, {"t": {"generation_method": "markov_chain"}}), 20).collect()
    assert len(out) == 20 and {r.t for r in out} <= {"one two", "three four"}
