"""Demo tables (A17-A20), generated from ``spark.range`` and keyed uniforms.

Their shapes follow the reference's demo data (customers, transactions,
mixed, default); values are seeded, so every table is reproducible at any
partition count. Used by tests and examples, not by the registered queries
(which read the driver's tables).
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.functions import pools
from facsimile.functions import rand as R

# Categories and weights of the demo data.
SEGMENTS = ["Basic", "Silver", "Gold", "Platinum"]
CATEGORIES = ["Electronics", "Clothing", "Food", "Home", "Sports"]
STATUSES = [("completed", 0.85), ("pending", 0.10), ("cancelled", 0.05)]
DEPARTMENTS = ["Engineering", "Sales", "Marketing", "HR"]


def _sentence(seed: int, name: str, k: int):
    arr = F.array(*[F.lit(w) for w in pools.WORDS])
    words = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.element_at(arr, (F.floor(R.uniform(seed, name, F.col("id"), j) * len(pools.WORDS)) + 1).cast("int")))
    s = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20), F.lit("."))


def customers(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """A17."""
    i = F.col("id")
    income = F.greatest(F.lit(20000.0), F.lit(60000.0) + F.lit(25000.0) * R.normal(seed, "income", i))
    return spark.range(n).select(
        F.format_string("CUST_%05d", i + 1).alias("customer_id"),
        R.pick(pools.FIRST_NAMES, seed, "first", i).alias("first_name"),
        R.pick(pools.LAST_NAMES, seed, "last", i).alias("last_name"),
        F.concat(F.lower(R.pick(pools.FIRST_NAMES, seed, "first", i)), F.lit("."), F.lower(R.pick(pools.LAST_NAMES, seed, "last", i)), F.lit("@"), R.pick(pools.EMAIL_DOMAINS, seed, "dom", i)).alias("email"),
        F.format_string("(%03d) %03d-%04d", R.uniform_index(seed, "p1", i, 1000), R.uniform_index(seed, "p2", i, 1000), R.uniform_index(seed, "p3", i, 10000)).alias("phone"),
        (R.uniform_index(seed, "age", i, 62) + 18).cast("int").alias("age"),
        F.bround(income, 2).alias("income"),
        R.pick(SEGMENTS, seed, "segment", i).alias("segment"),
        F.date_add(F.lit("2020-01-01").cast("date"), i.cast("int")).alias("signup_date"),
        F.concat(_sentence(seed, "notes1", 6), F.lit(" "), _sentence(seed, "notes2", 5)).alias("notes"),
    )


def transactions(spark: SparkSession, n: int = 1000, seed: int = 42, customers_n: int = 499) -> DataFrame:
    """Exponential amounts, weighted status."""
    i = F.col("id")
    u = R.uniform(seed, "status", i)
    status = F.when(u < STATUSES[0][1], STATUSES[0][0]).when(u < STATUSES[0][1] + STATUSES[1][1], STATUSES[1][0]).otherwise(STATUSES[2][0])
    h = F.md5(F.concat(F.lit(f"{seed}:txn:"), i.cast("string")))
    return spark.range(n).select(
        F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)).alias("transaction_id"),
        F.format_string("CUST_%05d", R.uniform_index(seed, "cust", i, customers_n) + 1).alias("customer_id"),
        F.bround(-F.ln(F.lit(1.0) - R.uniform(seed, "amount", i)) * 100.0, 2).alias("amount"),
        R.pick(CATEGORIES, seed, "category", i).alias("category"),
        (F.lit("2023-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=i.cast("int"))).alias("transaction_date"),
        _sentence(seed, "description", 6).alias("description"),
        status.alias("status"),
    )


def mixed(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """A19."""
    i = F.col("id")
    return spark.range(n).select(
        (i + 1).alias("id"),
        F.concat(R.pick(pools.FIRST_NAMES, seed, "first", i), F.lit(" "), R.pick(pools.LAST_NAMES, seed, "last", i)).alias("name"),
        F.concat(F.lit("user"), i.cast("string"), F.lit("@example.com")).alias("email"),
        (R.uniform_index(seed, "age", i, 62) + 18).cast("int").alias("age"),
        (F.lit(50000.0) + F.lit(15000.0) * R.normal(seed, "salary", i)).alias("salary"),
        R.pick(DEPARTMENTS, seed, "dept", i).alias("department"),
        (R.uniform(seed, "active", i) < 0.9).alias("is_active"),
    )


def default(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Id, standard normal value, A/B/C category, sentence."""
    i = F.col("id")
    return spark.range(n).select(
        (i + 1).alias("id"),
        R.normal(seed, "value", i).alias("value"),
        R.pick(["A", "B", "C"], seed, "category", i).alias("category"),
        _sentence(seed, "text", 6).alias("text"),
    )


