"""One index and one join for the sampled columns, against plain ranks."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from facsimile.operators import sampling as S
from facsimile.operators import synth

SCHEMA = "i int, big bigint, x double, f float, d decimal(20,3), s string, b boolean, day date, at timestamp, wall timestamp_ntz, none string, hot string"


def rows_of(n=300):
    rng = random.Random(3)
    some = lambda v: None if rng.random() < 0.2 else v
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 400))
    out = []
    for i in range(n):
        when = dt.datetime(2021, 3, 1) + dt.timedelta(seconds=rng.randint(0, 10**7))
        out.append((some(rng.randint(-5, 5)), some(2**62 + rng.randint(0, 400)), some(rng.gauss(0, 1)), some(float(rng.randint(0, 3)) / 2), some(Decimal(rng.randint(-9999, 9999)) / 1000),
                    some(rng.choice(["", "a", "ä", "Z"]) + str(rng.randint(0, 99))), some(rng.random() < 0.5), some(day()), some(when), some(when), None, "h" if i % 3 else f"u{i}"))
    return out


@pytest.mark.parametrize("few", [0, 40, 10_000])
@pytest.mark.parametrize("nulls", [True, False])
def test_values_at_ranks(spark, monkeypatch, few, nulls):
    monkeypatch.setattr(S, "FEW", few)
    data = rows_of()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    cols = [S.Sampled(i, f.name, f.dataType, nulls) for i, f in enumerate(df.schema.fields)]
    index = S.rank_index(df, cols)
    n = 500
    ranks = {c.position: (F.col("id") * 7919 + c.position) % max(1, index.total(c.position)) for c in cols}
    got = {r.id: r for r in S.sample(spark.range(n), index, ranks, lambda p: f"c{p}").collect()}
    assert len(got) == n
    for c in cols:
        values = [r[c.position] for r in data]
        values = sorted(values, key=lambda v: (v is not None, v if v is not None else 0)) if nulls else sorted(v for v in values if v is not None)
        if c.name == "s":
            values = sorted(values, key=lambda v: (v is not None, (v or "").encode()))
        assert index.total(c.position) == len(values)
        for i in range(n):
            want = values[(i * 7919 + c.position) % len(values)] if values else None
            have = got[i][f"c{c.position}"]
            assert have == (pytest.approx(want) if c.name == "f" and want is not None else want), (c.name, i)


def test_scans_and_joins_do_not_grow_with_columns(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW", 0)
    df = spark.createDataFrame([tuple(range(k, k + 8)) for k in range(50)], ", ".join(f"c{i} int" for i in range(8)))

    def joins(k):
        cols = [S.Sampled(i, f"c{i}", df.schema[i].dataType) for i in range(k)]
        index = S.rank_index(df, cols)
        plan = S.sample(spark.range(20), index, {c.position: F.col("id") % 50 for c in cols}, lambda p: f"o{p}")._jdf.queryExecution().optimizedPlan().toString()
        return sum("Join" in line for line in plan.splitlines())

    assert joins(1) == joins(8) == 1


def test_generation_of_all_kinds(spark):
    df = spark.createDataFrame(rows_of(60), SCHEMA).withColumn("nested", F.array("i", "i")).withColumn("raw", F.col("s").cast("binary"))
    out = synth.generate(synth.fit(df, {c: {"generation_method": "sample"} for c in df.columns}, seed=3), 200)
    assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    assert out.count() == 200
    for c in df.columns:
        assert out.select(c).subtract(df.select(c)).count() == 0


def test_no_columns_and_no_rows(spark):
    df = spark.createDataFrame([], "a int, b string")
    index = S.rank_index(df, [S.Sampled(0, "a", df.schema[0].dataType), S.Sampled(1, "b", df.schema[1].dataType)])
    assert index.total(0) == 0 and S.sample(spark.range(3), index, {0: F.lit(0), 1: F.lit(0)}, lambda p: f"c{p}").select("c0", "c1").collect() == [(None, None)] * 3
    assert S.rank_index(df, []).columns == []
