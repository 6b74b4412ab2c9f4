"""Cases found by review: nulls, names, kinds, exchange reuse, sinks."""

import random

import pytest
from pyspark.sql import functions as F

from facsimile.operators import compare as C
from facsimile.operators import copula as CP
from facsimile.operators import mask as M
from facsimile.operators import profile as P
from facsimile.operators import synth as S
from facsimile.sources import io


@pytest.mark.parametrize("reuse,adaptive", [("false", "true"), ("true", "false"), ("false", "false")])
def test_quartiles_do_not_depend_on_exchange_reuse(spark, reuse, adaptive):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled",)}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(0, 200_000, numPartitions=7).select(((F.xxhash64("id") % 10_000_000) / 7.0).alias("x"))
        got = P.column_stats(df).first()
        want = df.agg(*[F.percentile("x", p).alias(f"q{i}") for i, p in enumerate((0.25, 0.5, 0.75))]).first()
        assert (got.q25, got.median, got.q75) == pytest.approx(tuple(want))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
        for k, v in old.items():
            spark.conf.set(k, v)


def pairs_with_nulls(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        x = rng.gauss(0, 1)
        data.append((i, x, x * 2 if i % 2 else None, None, f"text {i}", "a" if x > 0 else "b"))
    return spark.createDataFrame(data, "id bigint, x double, y double, none double, words string, _pos string")


def test_copula_keeps_all_columns_and_rows_and_nulls(spark):
    df = pairs_with_nulls(spark).withColumn("day", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(x * 30 as int))"))
    out = CP.generate_copula(CP.fit_copula(df, seed=4), 3000)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    row = out.agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("y"), F.count("none").alias("none"), F.corr("x", "y").alias("r"), F.count_distinct("words").alias("w"), F.corr("x", F.unix_timestamp("day")).alias("d")).first()
    assert row.n == 3000 and row.none == 0 and row.y == pytest.approx(1500, abs=150) and row.w > 1000
    assert row.r > 0.95 and row.d > 0.9


def test_generation_with_any_method_and_any_names(spark):
    df = pairs_with_nulls(spark).withColumn("day", F.concat(F.lit("2024-03-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")))
    config = {
        "id": {"generation_method": "sample"}, "x": {"generation_method": "kde"}, "y": {"generation_method": "gaussian_copula"}, "none": {"generation_method": "sample"},
        "words": {"generation_method": "gaussian_copula"}, "_pos": {"generation_method": "kde"}, "day": {"generation_method": "datetime_range"},
    }
    one, two = (S.generate(S.fit(df, config, seed=5), 400).collect() for _ in range(2))
    assert sorted(one, key=str) == sorted(two, key=str) and len(one) == 400
    assert {r._pos for r in one} == {"a", "b"} and all(r.words.startswith("text ") for r in one)
    assert all(r.none is None for r in one) and len({r.id for r in one}) > 300
    assert all("2024-03-01 00:00:00" <= r.day <= "2024-03-28 23:59:59" for r in one)
    odd = S.generate(S.fit(df.select("words"), {"words": {"generation_method": "datetime_range"}}), 20).collect()
    assert all(r.words.startswith("text ") for r in odd)


def test_one_sided_columns_and_empty_tables_have_scores(spark):
    a = spark.createDataFrame([(1.0, "a", None), (2.0, "b", None)], "x double, s string, z double")
    b = spark.createDataFrame([(None, None, None), (None, None, None)], "x double, s string, z double")
    shapes = {r.column: r.score for r in C.column_shapes(a, b).collect()}
    assert shapes == {"x": 0.0, "s": 0.0, "z": None}
    empty = a.limit(0)
    assert all(r.score in (0.0, None) for r in C.column_shapes(a, empty).collect())
    assert all(r.score in (0.0, None) for r in C.pair_trends(a, empty).collect())
    same = {(r.column1, r.column2): r.score for r in C.pair_trends(a, a).collect()}
    assert same["x", "s"] == pytest.approx(1.0) and same["x", "z"] is None or ("x", "z") in same


def test_correlations_of_many_nullable_columns_use_one_scan(spark):
    cols = [F.when(F.col("id") % (i + 2) != 0, (F.xxhash64("id", F.lit(i)) % 1000).cast("double")).alias(f"c{i}") for i in range(60)]
    df = spark.range(500).select(*cols)
    got = {(r.column1, r.column2): r.correlation for r in P.correlation_matrix(df).collect()}
    assert len(got) == 3600
    for i, j in ((0, 1), (5, 59), (30, 31)):
        assert got[f"c{i}", f"c{j}"] == pytest.approx(df.agg(F.corr(f"c{i}", f"c{j}")).first()[0])
    assert P.correlation_matrix(df)._jdf.queryExecution().executedPlan().toString().count("Range (") == 1


def test_overview_tells_null_places_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, None)], "p string, q string")
    row = P.overview(df).first()
    assert (row.n_rows, row.duplicate_rows, row.complete_rows, row.total_missing) == (4, 1, 0, 5)


def test_append_counts_its_own_rows(spark, tmp_path):
    name = f"verdict_sink_{random.randrange(10**9)}"
    try:
        df = spark.range(5).withColumn("k", F.col("id") % 2)
        assert io.write_table(df, name, "create", location=str(tmp_path / "t"))["rows_written"] == 5
        info = io.write_table(df.limit(2), name, "append")
        assert info["rows_written"] == 2 and "partition_by" in info
        assert name in {r.tableName for r in io.list_tables(spark, "default").collect()}
        assert "default" in {r.namespace for r in io.list_databases(spark).collect()}
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_nulls_and_hot_values_through_token_joins(spark):
    key = "fixture-key-0001"
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"v{i % 4}") for i in range(60)], "i int, v string")
    rows = {r.i: r.v for r in M.tokenize(df, {"v": "alphanumeric"}, key).collect()}
    masked = M.tokenize(df, {"v": "alphanumeric"}, key, strategy="distinct")
    assert {r.i: r.v for r in masked.collect()} == rows
    back = M.detokenize(masked, {"v": "alphanumeric"}, M.token_vault(df, {"v": "alphanumeric"}, key))
    assert {r.i: r.v for r in back.collect()} == {r.i: r.v for r in df.collect()}
    vault = M.token_vault(df.withColumn("w", F.col("v")), {"v": "name", "w": "email"}, key)
    assert vault._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_two_token_engines_agree_on_long_and_odd_values(spark):
    rng = random.Random(2)
    values = ["", "é", "a", "A1z9" * 5000, "x@y", "@y", "a@b@c.d", "𝔘a1"] + ["".join(rng.choice("aZ09 é@-") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    for kind in M.TOKEN_TYPES:
        both = df.select(M.token_column(F.col("v"), kind, "fixture-key-0001", "arrow").alias("a"), M.token_expr(F.col("v"), kind, "fixture-key-0001").alias("b"))
        assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
