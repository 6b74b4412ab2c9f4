from pyspark.sql import functions as F

from facsimile.operators import mask as M

KEY = "fixture-key-0001"

# Golden vectors (type, value, token) for the key above.
VECTORS = [
    ("credit_card", "4111-1111-1111-1111", "6479-4622-5573-3809"),
    ("ssn", "123-45-6789", "549-65-8087"),
    ("phone", "(555) 123-4567", "(631) 570-3759"),
    ("email", "john.doe@example.com", "lmet.zqt@example.com"),
    ("name", "Mary-Jane O'Neil", "Cyib-Eras I'Vmjg"),
    ("name", "José Núñez", "Fpxé Húñyc"),
    ("name", "", ""),
    ("date", "2024-01-15", "3968-49-78"),
    ("alphanumeric", "Customer#000000042", "Tigerygl#967112483"),
    ("alphanumeric", "a" * 40, "hsnkaxgahqudimvsptgejriyoywcdcgchsnkaxga"),
]


def test_golden_vectors(spark):
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(VECTORS)], "i int, t string, v string")
    for i, (t, v, want) in enumerate(VECTORS):
        got = df.filter(F.col("i") == i).select(M.token_expr(F.col("v"), t, KEY).alias("x")).first().x
        assert got == want, (t, v, got, want)


def test_null_and_no_at(spark):
    df = spark.createDataFrame([(None,), ("no-at-sign",), ("@domain.com",)], "v string")
    out = [r.x for r in df.select(M.token_expr(F.col("v"), "email", KEY).alias("x")).collect()]
    assert out == [None, "no-at-sign", "@domain.com"]


def test_short_key_rejected():
    import pytest

    with pytest.raises(ValueError):
        M.check_key("short")


def test_roundtrip_and_shape(spark):
    from tests.conftest import SF

    cust = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_name")
    types = {"c_name": "name"}
    masked = M.tokenize(cust, types, KEY)
    vault = M.token_vault(cust, types, KEY)
    back = M.detokenize(masked, types, vault)
    rows = back.join(cust.withColumnRenamed("c_name", "orig"), "c_custkey").filter(~F.col("c_name_ambiguous"))
    assert rows.filter(F.col("c_name") != F.col("orig")).count() == 0
    same_len = masked.join(cust.withColumnRenamed("c_name", "orig"), "c_custkey").filter(F.length("c_name") != F.length("orig"))
    assert same_len.count() == 0
    by_distinct = M.tokenize(cust, types, KEY, strategy="distinct")
    assert by_distinct.exceptAll(masked).count() == 0


def test_engines_agree(spark):
    from tests.conftest import SF
    from facsimile.plans.tables import pii_customers
    from facsimile.plans.mask_queries import PII_TYPES

    pii = pii_customers(spark, SF)
    for c, t in PII_TYPES.items():
        d = pii.select(M.token_column(F.col(c), t, KEY, "arrow").alias("a"), M.token_column(F.col(c), t, KEY, "sql").alias("b"))
        assert d.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0, c


def test_python_function_vectors():
    for t, v, want in VECTORS:
        assert M.token_batch(t, KEY)([v, None, "", v]) == [want, None, "", want]


def test_rows_of_one_small_file_are_dealt_over_all_cores(spark, tmp_path):
    from facsimile.plans.tables import pii_customers

    rows = spark.range(1000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), F.col("id")).alias("c_name"), F.lit(3).alias("c_nationkey"), F.lit("A").alias("c_mktsegment"))
    rows.union(rows).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    read = pii_customers(spark, str(tmp_path))
    sizes = read.select(F.spark_partition_id().alias("p"), "c_custkey").groupBy("p").count().collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(r["count"] for r in sizes) == 2000
