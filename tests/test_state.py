"""States of parts merge to the state of the whole."""

import random

import pytest
from pyspark.sql import functions as F

from facsimile.operators import profile as P
from facsimile.operators import state as S


@pytest.fixture()
def table(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(3, 2), None if rng.random() < 0.3 else rng.randint(0, 50), rng.choice(["", "one", "two words", None]), i % 3 == 0, None, 7.0, [i]) for i in range(900)]
    return spark.createDataFrame(rows, "k int, x double, i bigint, s string, b boolean, none double, same double, a array<int>").repartition(4)


SHARED = ["count", "non_null", "null_count", "unique_count", "mean", "std", "min", "max", "skewness", "kurtosis", "avg_length", "min_length", "max_length", "avg_words", "q25", "median", "q75"]


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_merged_states_equal_the_profile_of_the_union(spark, table, tmp_path):
    parts = [table.filter("k < 100"), table.filter("k >= 100 and k < 101"), table.filter("k >= 101"), table.limit(0)]
    for i, part in enumerate(parts):
        S.state_of(part).save(f"{tmp_path}/{i}")
    states = [S.load(spark, f"{tmp_path}/{i}") for i in range(len(parts))]
    whole = by_column(P.column_stats(table))
    for state in (S.merged(states), S.merged([S.merged(states[:2]), S.merged(states[2:])]), S.state_of(table)):
        got = by_column(S.statistics(state))
        assert set(got) == set(whole)
        for c, want in whole.items():
            for k in SHARED:
                if c == "a" and k == "unique_count":
                    continue
                assert got[c][k] == (pytest.approx(want[k], rel=1e-9, abs=1e-9) if isinstance(want[k], float) else want[k]), (c, k)


def test_sketched_distinct_counts(spark):
    df = spark.range(40_000).select((F.col("id") % 10_000).alias("a"), F.concat(F.lit("v"), F.col("id")).alias("s"))
    halves = [S.state_of(df.filter(F.col("a") % 2 == r), exact=False) for r in (0, 1)]
    got = by_column(S.statistics(S.merged(halves)))
    assert abs(got["a"]["unique_count"] - 10_000) < 400 and abs(got["s"]["unique_count"] - 40_000) < 1600


def test_exact_statistics_build_no_sketch(spark, table):
    """No value is hashed for a sketch that is not read; saved states keep theirs."""
    states = [S.state_of(table.filter("k < 100")), S.state_of(table.filter("k >= 100"))]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "hll_sketch_agg" not in plan(S.statistics(S.merged(states)))
    assert "hll_sketch_agg" in plan(states[0].columns)
    near = S.ProfileState(S.merged(states).columns, None)
    assert by_column(S.statistics(near))["k"]["unique_count"] == pytest.approx(900, rel=0.03)
