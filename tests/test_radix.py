"""Radix selection against sorting, and against Spark's exact percentile."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.operators import profile as P
from facsimile.operators import radix as R

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_keys_order_as_the_values_do():
    values = np.array([-np.inf, -1e300, -2.0, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1e-9, 1.0, 1.0000000000000002, 3.5, 1e300, np.inf])
    keys = R.ordered_keys(values)
    assert (np.sort(keys) == keys).all() and keys[5] == keys[6] and len(np.unique(keys)) == len(values) - 1
    assert [R.value_of(int(k)) for k in keys] == values.tolist()


def columns(n=3000):
    rng = random.Random(1)
    hot = lambda: 7.25 if rng.random() < 0.4 else rng.gauss(0, 1)
    return [
        [rng.gauss(0, 1e6) for _ in range(n)],
        [hot() for _ in range(n)],
        [rng.randint(-3, 3) for _ in range(n)],
        [1e15 + rng.randint(0, 5) / 8 for _ in range(n)],  # differ in the last bits only
        [None if rng.random() < 0.7 else rng.random() for _ in range(n)],
        [None] * n,
        [4.0] * n,
    ]


@pytest.mark.parametrize("bits", [16, 8, 32])
def test_quantiles_of_a_table(spark, bits):
    cols = columns()
    df = spark.createDataFrame(list(zip(*[[None if v is None else float(v) for v in c] for c in cols])), ", ".join(f"c{i} double" for i in range(len(cols)))).repartition(5)
    got = R.quantiles(df, R.read_wide(list(range(len(cols)))), PROBS, bits)
    for i, c in enumerate(cols):
        values = [float(v) for v in c if v is not None]
        assert (i in got) == bool(values)
        if values:
            assert got[i] == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-15)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("p"), F.col(f"c{i}").alias("v")) for i in range(len(cols))]))).filter("v is not null").groupBy("p", "v").agg(F.count(F.lit(1)).alias("n"))
    assert R.quantiles(long, R.read_long, PROBS, bits) == got


def test_counts_of_a_task_are_arrays():
    """Half a million prefixes take a few dozen MB, not hundreds."""
    wanted = {p: sorted(int(k) for k in np.unique(R.ordered_keys(np.arange(1.0, 5.0)) >> np.uint64(48))) for p in (0, 1)}
    read = lambda seed: ((p, 1.0 + 4 * np.random.default_rng([p, seed]).random(40_000), None) for p in (0, 1))
    tracemalloc.start()
    out = list(R._count(read, 16, 16, wanted)(range(30)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    inside = [np.isin(R.ordered_keys(v) >> np.uint64(48), np.array(wanted[p], np.uint64)).sum() for s in range(30) for p, v, _ in read(s)]
    assert sum(sum(b.column("n").to_pylist()) for b in out) == sum(inside) and sum(b.num_rows for b in out) > 200_000
    assert peak < 48 << 20


def test_further_passes_have_few_counts(spark, monkeypatch):
    """No pass after the first gives more than 4,096 counts for a wanted prefix."""
    asked = []
    real = R._count
    monkeypatch.setattr(R, "_count", lambda read, done, bits, wanted: asked.append((done, bits)) or real(read, done, bits, wanted))
    df = spark.range(20_000).select((F.lit(1e15) + F.sqrt("id")).alias("x"))
    values = [r.x for r in df.collect()]
    assert R.quantiles(df, R.read_wide([0]), [0.5, 0.9])[0] == pytest.approx(np.quantile(values, [0.5, 0.9]).tolist(), rel=1e-15)
    assert asked[0] == (0, 16) and len(asked) > 2 and all(bits <= 12 for _, bits in asked[1:])


def test_percentiles_equal_the_exact_percentile(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 1009).alias("a"), F.when(F.col("id") % 3 != 0, F.sqrt("id")).alias("b"), F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.log1p("id")).alias("c"), (F.col("id") / 8).cast("decimal(10,3)").alias("d"), F.lit("x").alias("e"))
    got = {(r["column"], r.p): r.value for r in P.percentiles(df).collect()}
    row = df.withColumn("c", F.nanvl("c", F.lit(None).cast("double"))).agg(*[F.percentile(F.col(c).cast("double"), P.DISTRIBUTION_PROBS).alias(c) for c in "abcd"]).first()
    assert got == {(c, p): pytest.approx(row[c][i]) for c in "abcd" for i, p in enumerate(P.DISTRIBUTION_PROBS)}


def test_no_values(spark):
    assert P.percentiles(spark.createDataFrame([], "a int, b string")).collect() == []
