"""Catalog listing, readers, samplers and sinks.

Readers stay lazy: projection, predicate and limit are handed to Catalyst,
which pushes them into the scan (``PushedFilters`` / ``ReadSchema``).
Samples are seeded by the keyed uniform of a row key, so a sample is the
same at any partition count; ``fast=True`` uses Spark's per-partition
Bernoulli sampler instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from facsimile.functions import rand as R


def _listed(df: DataFrame, by: str, limit: int | None) -> DataFrame:
    df = df.orderBy(by)
    return df if limit is None else df.limit(limit)


def list_databases(spark: SparkSession, limit: int | None = None) -> DataFrame:
    """A1: all database names in order (``limit``: the first so many)."""
    return _listed(spark.sql("SHOW DATABASES"), "namespace", limit)


def list_tables(spark: SparkSession, database: str, limit: int | None = None) -> DataFrame:
    """A2: all tables of a database in order (``limit``: the first so many)."""
    return _listed(spark.sql(f"SHOW TABLES IN {database}"), "tableName", limit)


def describe(df: DataFrame) -> DataFrame:
    """A3: (name, type, comment) per column, from the schema."""
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("comment")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string, comment string")


def describe_table(spark: SparkSession, table: str) -> DataFrame:
    """A3 for a catalog table: DESCRIBE without '#' and blank partition rows."""
    d = spark.sql(f"DESCRIBE TABLE {table}")
    return d.filter(~F.col("col_name").startswith("#") & (F.trim("col_name") != "")).select(
        F.col("col_name").alias("name"), F.col("data_type").alias("type"), "comment"
    )


def read_table(
    spark: SparkSession,
    table: str | DataFrame,
    database: str | None = None,
    columns: list[str] | None = None,
    limit: int | None = None,
    where: str | Column | None = None,
) -> DataFrame:
    """A4: table with optional predicate, projection and limit."""
    if isinstance(table, DataFrame):
        df = table
    else:
        df = spark.table(f"{database}.{table}" if database else table)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    if limit is not None:
        df = df.limit(limit)
    return df


def read_sql(spark: SparkSession, query: str) -> DataFrame:
    """A5: run SQL text."""
    return spark.sql(query)


def table_info(df: DataFrame, full_name: str) -> DataFrame:
    """Full name, row count, column count, column names (one row)."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(full_name).alias("full_name"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
    )


def head(df: DataFrame, n: int = 200, order_by: list[str] | None = None) -> DataFrame:
    """First n rows; ordered by key when repeatability matters
    (a distributed top-n, never a full sort in one task)."""
    if order_by:
        return df.orderBy(*order_by).limit(n)
    return df.limit(n)


def sample(
    df: DataFrame,
    percent: float,
    seed: int = 42,
    key_cols: list[str] | None = None,
    limit: int | None = None,
    method: str = "bernoulli",
    fast: bool = False,
) -> DataFrame:
    """Row sample of ``percent`` %, then an optional limit.

    ``method="system"`` (block sampling) maps to row sampling: Spark
    samples rows. Keyed by ``key_cols`` (hash threshold) unless ``fast``.
    """
    frac = percent / 100.0
    if fast or not key_cols:
        out = df.sample(withReplacement=False, fraction=frac, seed=seed)
    else:
        out = df.filter(R.row_uniform(key_cols, seed) < F.lit(frac))
    return out.limit(limit) if limit is not None else out


def preview_sample(df: DataFrame, key_cols: list[str], n: int = 5, seed: int = 42) -> DataFrame:
    """N rows with the smallest keyed uniforms (whole table if smaller).

    ``orderBy(...).limit(n)`` plans as a distributed top-n (TakeOrdered):
    each task keeps n rows, the driver merges n x tasks rows.
    """
    u = R.row_uniform(key_cols, seed, "preview")
    return df.withColumn("_u", u).orderBy("_u", *key_cols).limit(n).drop("_u")


def read_csv(spark: SparkSession, path: str, header: bool = True, schema=None, infer: bool = True) -> DataFrame:
    """CSV with a header and inferred (or given) types."""
    r = spark.read.option("header", header)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", infer).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV with a header, no index column."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> str:
    """A13."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


MODES = {"overwrite": "overwrite", "append": "append", "create": "errorifexists"}


def write_table(
    df: DataFrame,
    table_path: str,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
    fmt: str = "parquet",
    location: str | None = None,
) -> dict:
    """Save as a catalog table; ``create`` fails if it exists.

    ``overwrite_partitions`` replaces the partitions that ``df`` has rows of and
    leaves the others; the table keeps its format and partition columns.
    ``fmt`` is the table format (``iceberg`` needs its jar on the cluster).
    Returns status, table, rows, columns, mode and partition columns; the rows
    are those of ``df``, counted by the write itself.
    """
    if mode not in MODES and mode != "overwrite_partitions":
        raise ValueError(f"Invalid mode: {mode}. Use 'overwrite', 'append', 'create' or 'overwrite_partitions'")
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if mode == "overwrite_partitions":
        conf, key = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
        into = df.sparkSession.table(table_path).columns  # insertInto goes by place
        before = conf.get(key)
        conf.set(key, "dynamic")  # insertInto takes no such option
        try:
            counted.select(*[F.col(f"`{c}`") for c in into]).write.insertInto(table_path, overwrite=True)
        finally:
            conf.set(key, before)
    else:
        w = counted.write.format(fmt).mode(MODES[mode])
        if partition_by:
            w = w.partitionBy(*partition_by)
        if location:
            w = w.option("path", location)
        w.saveAsTable(table_path)
    return {"status": "success", "table_path": table_path, "rows_written": seen.get["rows"], "columns": df.columns, "mode": mode, "partition_by": partition_by}


def register_view(df: DataFrame, name: str) -> DataFrame:
    """A named temporary view that shadows same-named tables in SQL."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
