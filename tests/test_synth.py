"""Generators: seeded, partition-independent, right distributions."""

from pyspark.sql import functions as F

from facsimile.operators import synth as S
from tests.conftest import SF


def test_partition_count_does_not_change_output(spark):
    # Draws depend on (seed, column, row id) only. Fitted means and standard
    # deviations are distributed sums whose last bit depends on the
    # partitioning, so doubles are compared at 6 decimals.
    from facsimile.plans.common import rounded

    orders = spark.read.parquet(f"{SF}/orders.parquet")
    model = S.fit(orders, seed=5)
    a = rounded(S.generate(model, 3000))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = rounded(S.generate(S.fit(orders.repartition(5), seed=5), 3000))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_gaussian_moments_and_categorical_frequencies(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice", "l_returnflag")
    cfg = {"l_extendedprice": {"generation_method": "gaussian_copula"}, "l_returnflag": {"generation_method": "frequency_sampling"}}
    g = S.generate(S.fit(li, cfg, seed=9), 60000)
    src = li.agg(F.avg("l_extendedprice"), F.stddev("l_extendedprice")).first()
    syn = g.agg(F.avg("l_extendedprice"), F.stddev("l_extendedprice")).first()
    assert abs(syn[0] - src[0]) / src[0] < 0.02 and abs(syn[1] - src[1]) / src[1] < 0.05
    fs = {r[0]: r[1] / 60000 for r in li.groupBy("l_returnflag").count().collect()}
    fg = {r[0]: r[1] / 60000 for r in g.groupBy("l_returnflag").count().collect()}
    for k, p in fs.items():
        assert abs(fg.get(k, 0) - p) < 4 * (p * (1 - p) / 60000) ** 0.5 + 1e-3


def test_sequential_id_never_truncates(spark):
    df = spark.createDataFrame([("CUST_00001",)], "code string")
    g = S.generate(S.fit(df, {"code": {"generation_method": "sequential_id"}}, seed=1), 100001)
    assert g.filter(F.col("code") == "CUST_100001").count() == 1
    assert g.filter(F.col("code") == "CUST_00001").count() == 1


def test_copula_keeps_correlation(spark):
    from facsimile.operators import copula as CP
    from facsimile.operators.profile import correlation_matrix

    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_retailprice")
    g = CP.generate_copula(CP.fit_copula(part, seed=2), 2000)
    src = correlation_matrix(part).filter("column1 = 'p_partkey' AND column2 = 'p_retailprice'").first().correlation
    syn = correlation_matrix(g).filter("column1 = 'p_partkey' AND column2 = 'p_retailprice'").first().correlation
    assert abs(src - syn) < 0.1


def test_datetime_generation_ignores_session_time_zone(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderdate")
    cfg = {"o_orderdate": {"generation_method": "datetime_range"}}
    a = S.generate(S.fit(orders, cfg, seed=4), 5000).collect()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        b = S.generate(S.fit(orders, cfg, seed=4), 5000).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(r[0] for r in a) == sorted(r[0] for r in b)


def test_draws_of_a_wide_row_are_not_one_method(spark):
    """All draws in one generated method are too long for the JVM to compile."""
    df = spark.range(200).select(*[(F.col("id") * (i + 3) / 7).alias(f"c{i}") for i in range(12)])
    model = S.fit(df, {f"c{i}": {"generation_method": "gaussian_copula"} for i in range(12)})
    out = S.generate(model, 50)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("*(" in line and line.count("md5(") > 6 for line in lines)
    model.columns = model.columns[:1] + model.columns[6:7]
    again = {tuple(r) for r in S.generate(model, 50).collect()}
    assert {(r.c0, r.c6) for r in out.collect()} == again
