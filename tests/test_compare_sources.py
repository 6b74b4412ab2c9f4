"""Comparison identities, sinks and demo tables."""

from pyspark.sql import functions as F

from facsimile.operators import compare as C
from facsimile.session import checkpoint_dir
from facsimile.sources import demo, io
from tests.conftest import SF


def test_compare_table_with_itself(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    m = C.correlation_metrics(C.correlation_pairs(o, o)).first()
    assert m.mae == 0 and m.max_difference == 0
    q = {r.property: r.score for r in C.quality_report(o, o, ["o_orderstatus"]).collect()}
    assert abs(q["Overall"] - 1.0) < 1e-9


def test_csv_and_parquet_roundtrip(spark):
    import uuid

    c = spark.read.parquet(f"{SF}/customer.parquet")
    base = f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}"
    back = io.read_csv(spark, io.write_csv(c, f"{base}/csv"), schema=c.schema)
    assert back.exceptAll(c).count() == 0 and back.count() == c.count()
    pq = spark.read.parquet(io.write_parquet(c, f"{base}/pq", partition_by=["c_mktsegment"])).select(*c.columns)
    assert pq.exceptAll(c).count() == 0


def test_demo_tables_are_seeded(spark):
    a = demo.transactions(spark, 200, seed=3)
    b = demo.transactions(spark, 200, seed=3)
    assert a.exceptAll(b).count() == 0
    assert set(r.status for r in a.select("status").distinct().collect()) <= {"completed", "pending", "cancelled"}
    assert demo.customers(spark, 50).count() == 50 and demo.mixed(spark, 20).count() == 20
    assert demo.default(spark, 30).filter(F.col("category").isin("A", "B", "C")).count() == 30


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) > 100
