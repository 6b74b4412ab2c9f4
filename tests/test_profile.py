"""Edge tables (FIXTURES section 4) through the profile operators."""

import math

from pyspark.sql import functions as F

from facsimile.operators import detect as D
from facsimile.operators import profile as P


def _stats(df):
    return {r["column"]: r for r in P.column_stats(df).collect()}


def test_type_edge_cases(spark):
    rows = [(None, i % 2, str(i % 2), 3.5, "w x y") for i in range(30)]
    df = spark.createDataFrame(rows, "all_null string, zero_one int, zero_one_text string, constant double, nbsp_text string")
    st = _stats(df)
    assert st["all_null"]["detected_type"] == "boolean"
    assert st["zero_one"]["detected_type"] == "boolean"
    assert st["zero_one_text"]["detected_type"] == "categorical"
    assert st["constant"]["detected_type"] == "categorical"
    assert st["nbsp_text"]["avg_words"] == 3.0
    corr = {(r.column1, r.column2): r.correlation for r in P.correlation_matrix(df).collect()}
    assert corr[("zero_one", "constant")] is None


def test_single_row_and_nan(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert _stats(df)["x"]["std"] is None
    nan = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x double")
    s = _stats(nan)["x"]
    assert s["null_count"] == 2 and s["non_null"] == 1
    ov = P.overview(nan).first()
    assert ov.total_missing == 2 and ov.complete_rows == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    st = _stats(df)
    assert st["a"]["null_percentage"] == 0.0 and st["a"]["unique_percentage"] == 0.0
    assert P.overview(df).first().n_rows == 0


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (3, "b")], "a int, b string")
    assert P.overview(df).first().duplicate_rows == 2


def test_nested_column(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    s = _stats(df)["v"]
    assert s["detected_type"] == "nested" and s["null_count"] == 1


def test_file_name_not_sensitive(spark):
    df = spark.createDataFrame([("report.txt",), ("a.csv",)], "file_name string")
    assert D.sensitive_columns(df).count() == 0


def test_skew_kurtosis_bias_adjusted(spark):
    xs = [1.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    s = _stats(df)["x"]
    n = len(xs)
    m = sum(xs) / n
    m2 = sum((x - m) ** 2 for x in xs) / n
    m3 = sum((x - m) ** 3 for x in xs) / n
    m4 = sum((x - m) ** 4 for x in xs) / n
    g1 = m3 / m2 ** 1.5
    g2 = m4 / m2 ** 2 - 3
    G1 = g1 * math.sqrt(n * (n - 1)) / (n - 2)
    G2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    assert abs(s["skewness"] - G1) < 1e-9 and abs(s["kurtosis"] - G2) < 1e-9


def test_percentiles_match_linear_interpolation(spark):
    import numpy as np

    vals = [float(v) for v in np.random.default_rng(1).integers(0, 50, 501)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.p: r.value for r in P.percentiles(df).collect()}
    for p, v in got.items():
        assert abs(v - float(np.quantile(vals, p))) < 1e-9


def test_top_values_tie_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "s string")
    top = [(r.value, r["count"]) for r in P.most_common(df, 2).orderBy("rank").collect()]
    assert top == [("c", 2), ("a", 1)]


def test_config_override(spark):
    df = spark.createDataFrame([(1, "x")], "user_id int, note string")
    over = spark.createDataFrame([("note", "sample")], "column string, generation_method string")
    cfg = {r.column: r for r in P.column_config(P.column_stats(df), over).collect()}
    assert cfg["user_id"].generation_method == "uuid"
    assert cfg["note"].generation_method == "sample"
    assert F is not None
