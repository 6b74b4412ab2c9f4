"""Registered source / sink / helper queries (A3-A16, F1-F3) and twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facsimile.functions import format as FM
from facsimile.functions import rand as R
from facsimile.plans.common import r_sql, rounded
from facsimile.plans.registry import add
from facsimile.plans.tables import TABLE_COLUMNS, table
from facsimile.session import checkpoint_dir
from facsimile.sources import io

TABLES = list(TABLE_COLUMNS)


def _views(spark, sf_dir, names):
    for n in names:
        io.register_view(table(spark, sf_dir, n), n)


# A4: projection + predicate, pushed into the scan.
add(
    "source_read_projection_lineitem",
    lambda spark, sf_dir: io.read_table(
        spark, table(spark, sf_dir, "lineitem"), columns=["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"],
        where="l_discount >= 0.05 AND l_quantity < 10",
    ),
    "SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 10",
)

# A5: SQL text over registered views.
SQL_TEXT = """SELECT o.o_orderpriority, count(*) AS n_lines, sum(l.l_extendedprice * (1 - l.l_discount)) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority"""


def q_sql(spark, sf_dir):
    _views(spark, sf_dir, ["lineitem", "orders"])
    return rounded(io.read_sql(spark, SQL_TEXT))


add("source_sql_orders_lineitem", q_sql, f"SELECT o_orderpriority, n_lines, {r_sql('revenue')} AS revenue FROM ({SQL_TEXT})")

# Table info.
for _t in ["orders", "lineitem", "documents"]:
    add(
        f"source_table_info_{_t}",
        (lambda t: lambda spark, sf_dir: io.table_info(table(spark, sf_dir, t), f"testdata.{t}").select(
            "full_name", "row_count", "column_count", F.array_join("columns", ",").alias("columns")
        ))(_t),
        f"SELECT 'testdata.{_t}' AS full_name, count(*) AS row_count, CAST({len(TABLE_COLUMNS[_t])} AS BIGINT) AS column_count, "
        f"'{','.join(c for c, _ in TABLE_COLUMNS[_t])}' AS columns FROM {_t}",
    )

# A3: describe (types are Spark's names: no SQL twin).
add("source_describe_lineitem", lambda spark, sf_dir: io.describe(table(spark, sf_dir, "lineitem")))

# Head sample ordered by key (the limit is the feature).
add(
    "source_head_orders",
    lambda spark, sf_dir: io.head(table(spark, sf_dir, "orders"), 200, ["o_orderkey"]),
    "SELECT * FROM orders ORDER BY o_orderkey LIMIT 200",
)

# Keyed Bernoulli sample, 10 percent.
_KEY = "CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)"
add(
    "source_sample_lineitem",
    lambda spark, sf_dir: io.sample(table(spark, sf_dir, "lineitem"), 10.0, seed=7, key_cols=["l_orderkey", "l_linenumber"]),
    f"SELECT * FROM lineitem WHERE {R.sql_uniform(7, 'sample', _KEY)} < 0.1",
)

# Preview sample, 5 rows by keyed uniform.
add(
    "source_preview_orders",
    lambda spark, sf_dir: io.preview_sample(table(spark, sf_dir, "orders"), ["o_orderkey"], 5, seed=42),
    f"SELECT * FROM orders ORDER BY {R.sql_uniform(42, 'preview', 'CAST(o_orderkey AS VARCHAR)')}, o_orderkey LIMIT 5",
)


# Sinks, read back from the shared checkpoint folder.
def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/sinks/{uuid.uuid4().hex}"


def q_csv(spark, sf_dir):
    src = table(spark, sf_dir, "customer")
    path = io.write_csv(src, _scratch(spark))
    return io.read_csv(spark, path, schema=src.schema)


def q_parquet(spark, sf_dir):
    src = table(spark, sf_dir, "orders")
    path = io.write_parquet(src, _scratch(spark), partition_by=["o_orderstatus"])
    return spark.read.parquet(path).select(*src.columns)


def q_table(spark, sf_dir):
    src = table(spark, sf_dir, "supplier")
    name = f"facsimile_sink_{uuid.uuid4().hex[:12]}"
    info = io.write_table(src, name, mode="create", location=_scratch(spark))
    return spark.table(name).withColumn("rows_written", F.lit(info["rows_written"]).cast("long"))


def _sink(spark) -> tuple[str, str]:
    return f"facsimile_sink_{uuid.uuid4().hex[:12]}", _scratch(spark)


def q_append(spark, sf_dir):
    """Orders in two writes of half the rows each."""
    src, (name, where) = table(spark, sf_dir, "orders"), _sink(spark)
    for rest, mode in ((0, "create"), (1, "append")):
        io.write_table(src.filter(F.col("o_orderkey") % 2 == rest), name, mode=mode, location=where)
    return spark.table(name)


def q_overwrite(spark, sf_dir):
    """A table of other rows and columns, replaced by customer."""
    src, (name, where) = table(spark, sf_dir, "customer"), _sink(spark)
    io.write_table(src.select("c_name", F.lit(1).alias("other")), name, mode="create", location=where)
    io.write_table(src, name, mode="overwrite", location=where)
    return spark.table(name)


def q_overwrite_partitions(spark, sf_dir):
    """Orders by status with all totals at zero; the partitions of two statuses are then replaced."""
    src, (name, where) = table(spark, sf_dir, "orders"), _sink(spark)
    io.write_table(src.withColumn("o_totalprice", F.lit(0.0)), name, mode="create", location=where, partition_by=["o_orderstatus"])
    io.write_table(src.filter(F.col("o_orderstatus").isin("F", "O")), name, mode="overwrite_partitions")
    return spark.table(name).select(*src.columns)


add("source_sink_append_orders", q_append, "SELECT * FROM orders")
add("source_sink_overwrite_customer", q_overwrite, "SELECT * FROM customer")
add("source_sink_overwrite_partitions_orders", q_overwrite_partitions, "SELECT * REPLACE (CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice ELSE 0 END AS o_totalprice) FROM orders")
add("source_csv_roundtrip_customer", q_csv, "SELECT * FROM customer")
add("source_parquet_roundtrip_orders", q_parquet, "SELECT * FROM orders")
add("source_table_sink_supplier", q_table, "SELECT *, (SELECT count(*) FROM supplier) AS rows_written FROM supplier")


# Types inferred from a CSV written from the table; A10: preview of a result; A3: a catalog table's columns.
def q_csv_inferred(spark, sf_dir):
    src = table(spark, sf_dir, "customer")
    read = io.read_csv(spark, io.write_csv(src, _scratch(spark)))
    types = ",".join(f"{c}:{t}" for c, t in read.dtypes)
    return read.withColumn("types", F.lit(types))


add("source_csv_inferred_customer", q_csv_inferred, "SELECT *, 'c_custkey:int,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string' AS types FROM customer")


def q_preview(spark, sf_dir):
    _views(spark, sf_dir, ["lineitem"])
    return io.head(io.read_sql(spark, "SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY l_shipdate"), 20, ["l_shipdate"])


add("source_preview_result_lineitem", q_preview, "SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY l_shipdate ORDER BY l_shipdate LIMIT 20")


def q_describe_table(spark, sf_dir):
    name = f"facsimile_described_{uuid.uuid4().hex[:12]}"
    io.write_table(table(spark, sf_dir, "orders"), name, mode="create", location=_scratch(spark), partition_by=["o_orderstatus"])
    return io.describe_table(spark, name)


add(
    "source_describe_table_orders",
    q_describe_table,
    """SELECT * FROM (VALUES ('o_orderkey', 'bigint', NULL::VARCHAR), ('o_custkey', 'bigint', NULL), ('o_totalprice', 'double', NULL), ('o_orderdate', 'timestamp_ntz', NULL),
  ('o_orderpriority', 'string', NULL), ('o_orderstatus', 'string', NULL), ('o_orderstatus', 'string', NULL)) t(name, type, comment)""",
)


# compact numbers and truncated text over a whole table.
def q_format(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        FM.compact_number(F.col("o_totalprice")).alias("total_text"),
        FM.compact_number(F.col("o_custkey")).alias("customer_text"),
        FM.truncate(F.col("o_orderpriority"), 8).alias("priority_short"),
    )


def _compact_sql(x: str) -> str:
    def fixed(e: str) -> str:
        return f"printf('%.2f', {e})"

    v = f"CAST({x} AS DOUBLE)"
    return f"""CASE WHEN {v} IS NULL OR isnan({v}) THEN 'N/A'
  WHEN abs({v}) >= 1e9 THEN {fixed(f'{v} / 1e9')} || 'B'
  WHEN abs({v}) >= 1e6 THEN {fixed(f'{v} / 1e6')} || 'M'
  WHEN abs({v}) >= 1e3 THEN {fixed(f'{v} / 1e3')} || 'K'
  ELSE printf('%.2f', {v}) END"""


add(
    "format_orders",
    q_format,
    f"""SELECT o_orderkey, {_compact_sql('o_totalprice')} AS total_text, {_compact_sql('o_custkey')} AS customer_text,
  CASE WHEN length(o_orderpriority) > 8 THEN substr(o_orderpriority, 1, 5) || '...' ELSE o_orderpriority END AS priority_short FROM orders""",
)

# JSON-safe rows (text formats differ between engines: rows only).
add("json_rows_events", lambda spark, sf_dir: FM.json_safe(table(spark, sf_dir, "events")))
