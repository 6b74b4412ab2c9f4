"""Heavy hitters and value counts against plain counts."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.operators import heavy as H
from facsimile.operators import profile as P
from facsimile.operators.columns import columns_of


@pytest.mark.parametrize("capacity", [4, 16, 64])
def test_merged_summaries_keep_their_bounds(capacity):
    rng = random.Random(capacity)
    data = [int(rng.paretovariate(0.7)) for _ in range(5000)]
    true = Counter(data)
    parts = [data[i::13] for i in range(13)]
    state = []
    for part in parts:
        keys, counts, error = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for i in range(0, len(part), 50):
            found, n = np.unique(part[i : i + 50], return_counts=True)
            keys, counts, more = H.merged(np.concatenate([keys, found]), np.concatenate([counts, n]), capacity)
            error += more
        state.append((keys, counts, error))
    while len(state) > 1:
        (a, n, x), (b, m, y), *rest = state
        keys, counts, more = H.merged(np.concatenate([a, b]), np.concatenate([n, m]), capacity)
        state = [*rest, (keys, counts, x + y + more)]
    keys, counts, error = state[0]
    lower = dict(zip(keys.tolist(), counts.tolist()))
    assert len(keys) <= capacity and error <= len(data) // capacity
    assert all(lower.get(v, 0) <= n <= lower.get(v, 0) + error for v, n in true.items())


def plain_top(values, k):
    found = Counter(v for v in values if v is not None)
    ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:k]
    return [(v, n, r) for r, (v, n) in enumerate(ranked, 1)]


def table_of(spark, n=1200):
    rng = random.Random(5)
    zipf = [f"v{int(rng.paretovariate(0.6))}" for _ in range(n)]
    unique = [f"customer {i * 7919 % n:06d}" for i in range(n)]
    tied = [f"é{i % 37}" for i in range(n)]
    holes = [None if rng.random() < 0.5 else rng.choice("ab") for _ in range(n)]
    twice = [f"{'long common beginning '}{i % (n // 2):05d}" for i in range(n)]
    rows = list(zip(zipf, unique, tied, holes, twice, [""] * n, [None] * n))
    return rows, spark.createDataFrame(rows, "zipf string, `u.q` string, tied string, holes string, twice string, blank string, none string").repartition(36)


@pytest.mark.parametrize("capacity, few", [(1024, 100_000), (40, 100_000), (8, 3)])
def test_top_texts_equal_plain_counts(spark, monkeypatch, capacity, few):
    monkeypatch.setattr(H, "FEW", few)
    rows, df = table_of(spark)
    cols = columns_of(df)
    found = H.top_texts(df, cols, 6, capacity=capacity).collect()
    by_counts = H.top_texts(df, cols, 6, counts=H.cut_lineage(H.value_counts(df, prefix=True))).collect()
    for c in cols:
        want = plain_top([r[c.position] for r in rows], 6)
        for got in (found, by_counts):
            assert sorted(((r.value, r.n, r["rank"]) for r in got if r.position == c.position), key=lambda r: r[2]) == want, c.name


def test_no_text_in_the_shuffle_but_for_candidates(spark):
    """Value counts and summaries move digests; only the values of the candidates are exchanged."""
    _, df = table_of(spark, 400)
    plan = H.value_counts(df, prefix=True)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and not any(name in line for line in exchanged for name in ("zipf", "u.q", "tied", "value"))
    assert dict(H.value_counts(df).dtypes) == {"position": "int", "column": "string", "a": "bigint", "b": "bigint", "num": "double", "start": "bigint", "n": "bigint"}


def test_order_of_the_first_bytes(spark):
    words = ["", "a", "a\x00", "ab", "b", "é", "zzzzzzzzz", "zzzzzzzzzz", "中", "\x7f", "𝔘"]
    got = {r.w: r.p for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", H.first_bytes(F.col("w")).alias("p")).collect()}
    ranked = sorted(words, key=lambda w: w.encode())
    assert [got[w] for w in ranked] == sorted(got.values())


def test_categories_of_all_kinds(spark):
    rows = [(i % 3, float(i % 4) / 2, f"t{i % 5}", None if i % 9 == 0 else i % 2 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d boolean")
    counts = H.cut_lineage(H.value_counts(df, prefix=True))
    stats = P.column_stats(df, freq=counts)
    got = {(r["column"], r.value): (r["count"], r["rank"], r.n_categories) for r in P.categories(df, stats, counts).collect()}
    want = {}
    for i, c in enumerate("abc"):
        values = [str(r[i]) for r in rows]
        found = Counter(values)
        for rank, (v, n) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0])), 1):
            want[c, v] = (n, rank, len(found))
    assert {k: v for k, v in got.items() if k[0] in "abc"} == want


def test_tables_without_text_or_rows(spark):
    assert P.most_common(spark.createDataFrame([(1,)], "a int")).collect() == []
    assert P.most_common(spark.createDataFrame([], "a string")).collect() == []
    assert H.value_counts(spark.createDataFrame([([1],)], "a array<int>")).collect() == []
