"""The test tables and derived views the registered queries read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.session import spread

# Column kinds of the driver's tables (for SQL generation).
TABLE_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "numeric"), ("r_name", "string")],
    "nation": [("n_nationkey", "numeric"), ("n_name", "string"), ("n_regionkey", "numeric")],
    "customer": [("c_custkey", "numeric"), ("c_name", "string"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "numeric"), ("s_name", "string"), ("s_nationkey", "numeric"), ("s_acctbal", "numeric")],
    "part": [("p_partkey", "numeric"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "numeric"), ("p_retailprice", "numeric")],
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"), ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"), ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "datetime")],
    "events": [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "string"), ("value", "numeric"), ("props", "string")],
    "documents": [("doc_id", "numeric"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "numeric")],
    "labels": [("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric")],
    "conversations": [("conv_id", "numeric"), ("turn", "numeric"), ("role", "string"), ("text", "string")],
    "benchmark": [("item_id", "numeric"), ("text", "string")],
    "pages": [("page_id", "numeric"), ("url", "string"), ("html", "string")],
    "embeddings": [("vec_id", "numeric"), ("embedding", "nested"), ("label", "numeric")],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A customer projection with personal-data columns derived from the table
# itself (the driver's tables carry no such columns): every value depends on
# c_custkey / c_name, so the view grows with the table.
PII_SQL = {
    "contact_email": "lower(replace(c_name, '#', '.')) || '@mail.example.com'",
    "phone": "'(' || lpad(CAST(200 + c_custkey % 800 AS VARCHAR), 3, '0') || ') ' || lpad(CAST((c_custkey * 7919) % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST((c_custkey * 104729) % 10000 AS VARCHAR), 4, '0')",
    "ssn_text": "lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST((c_custkey * 31) % 10000 AS VARCHAR), 4, '0')",
    "alt_contact": "'u' || CAST(c_custkey AS VARCHAR) || '@corp' || CAST(c_nationkey AS VARCHAR) || '.example.org'",
    "ref_code": "lpad(CAST((c_custkey * 37) % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST((c_custkey * 11) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST((c_custkey * 53) % 10000 AS VARCHAR), 4, '0')",
    "dial": "'+1 ' || lpad(CAST(200 + (c_custkey * 3) % 800 AS VARCHAR), 3, '0') || ' ' || lpad(CAST((c_custkey * 61) % 10000000 AS VARCHAR), 7, '0')",
    "dob": "CAST(1950 + c_custkey % 50 AS VARCHAR) || '-' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0')",
    "card": "'4' || lpad(CAST((c_custkey * 7) % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST((c_custkey * 13) % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST((c_custkey * 17) % 10000 AS VARCHAR), 4, '0')",
}
PII_COLUMNS = ["c_custkey", "c_name", "c_mktsegment", *PII_SQL]


def pii_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "customer"))
    exprs: list[Column] = [F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")]
    exprs += [F.expr(sql.replace("CAST(", "CAST(").replace(" AS VARCHAR)", " AS STRING)")).alias(name) for name, sql in PII_SQL.items()]
    return c.select(*exprs)


def pii_sql() -> str:
    cols = ", ".join(["c_custkey", "c_name", "c_mktsegment"] + [f"{sql} AS {name}" for name, sql in PII_SQL.items()])
    return f"(SELECT {cols} FROM customer)"

# Integer-typed columns of the driver's tables.
INTEGRAL_COLUMNS = {
    "r_regionkey", "n_nationkey", "n_regionkey", "c_custkey", "c_nationkey", "s_suppkey", "s_nationkey",
    "p_partkey", "p_size", "o_orderkey", "o_custkey", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "event_id", "user_id", "doc_id", "n_chars", "quality", "toxic", "conv_id", "turn", "item_id", "page_id",
    "vec_id", "label",
}
