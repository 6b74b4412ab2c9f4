"""Bottom-n samples by keyed draws, and exactly rounded numbers."""

import random

import pytest
from pyspark.sql import functions as F

from facsimile.functions import format as FM
from facsimile.functions import rand as R
from facsimile.operators import compare as C
from facsimile.operators.reservoir import reservoir


@pytest.mark.parametrize("parts", [1, 5, 40])
@pytest.mark.parametrize("n", [1, 100, 10_000])
def test_smallest_draws(spark, parts, n):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 != 0, F.concat(F.lit("v"), F.col("id") % 7)).alias("`v"))
    draw = R.uniform(3, "x", F.col("id"))
    got = [(r["rank"], r.value) for r in reservoir(df.repartition(parts), F.col("```v`"), draw, n).orderBy("rank").collect()]
    ranked = sorted((r.u, r.v) for r in df.select(draw.alias("u"), F.col("```v`").alias("v")).collect() if r.v is not None)[:n]
    assert got == [(i, v) for i, (_, v) in enumerate(ranked, 1)]


def test_equal_draws_and_sides(spark):
    a = spark.createDataFrame([(i, random.Random(i).choice("abc")) for i in range(50)], "k int, s string")
    got = [r.value for r in reservoir(a, F.col("s"), F.lit(0.5), 20).orderBy("rank").collect()]
    assert got == sorted(r.s for r in a.collect())[:20]
    sides = C.raw_values(a, a.limit(0), "s", ["k"], 30).collect()
    assert len(sides) == 30 and {r.side for r in sides} == {C.ORIGINAL}
    assert reservoir(a.limit(0), F.col("s"), F.lit(0.5), 3).collect() == []


def test_numbers_are_rounded_by_their_exact_value(spark):
    values = [1.115, 1.125, 2.675, 0.5, 1.005, 999.995, 1234.565, 999_995.0, 1e6, 1_234_567.0, 2.5e9, -1.115, -2345.675, 0.0, 1e-9]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", FM.fixed(F.col("v"), 2).alias("two"), FM.fixed(F.col("v"), 1).alias("one"), FM.compact_number(F.col("v")).alias("short")).collect()

    def short(x):
        for size, mark in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
            if abs(x) >= size:
                return f"{x / size:.2f}{mark}"
        return f"{x:,.2f}"

    for r in rows:
        assert (r.two, r.one, r.short) == (f"{r.v:.2f}", f"{r.v:.1f}", short(r.v))
