"""Semantic column types (by name, then by values) and sensitive columns.

Name rules are plain substring tests evaluated on the driver over the column
names; value rules are ``when`` chains over per-column statistics computed by
one distributed aggregate, so type detection costs one pass over the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from facsimile.functions.text import (
    CARD_PATTERN,
    LOOSE_EMAIL_PATTERN,
    PHONE_PATTERN,
    SSN_PATTERN,
    rlike_u,
)

# Semantic types and the name fragments that select them, in
# the order the rules are tried (first match wins).
SEMANTIC_TYPES = [
    "continuous", "categorical", "text", "free_text", "datetime", "boolean",
    "id", "email", "phone", "address", "name",
]
TYPE_NAME_RULES = [
    ("id", ["_id", "id_", "uuid", "guid"]),
    ("email", ["email"]),
    ("phone", ["phone", "mobile", "tel"]),
    ("name", ["name", "first_name", "last_name", "full_name"]),
    ("address", ["address", "street", "city", "zip", "postal"]),
]

# Sensitive-data name rules, in order.
SENSITIVE_NAME_RULES = [
    ("ssn", ["ssn", "social_security", "sin"]),
    ("credit_card", ["credit_card", "card_number", "cc_num", "cardnum"]),
    ("phone", ["phone", "mobile", "tel", "fax"]),
    ("email", ["email", "e_mail", "e-mail"]),
    ("name", ["first_name", "last_name", "full_name", "name"]),
    ("date", ["dob", "birth_date", "birthdate", "date_of_birth"]),
    ("alphanumeric", ["address", "street", "addr"]),
]
NAME_RULE_EXCLUSIONS = {"name": ["file", "table"]}
# Value rules, tried in order, each needing a match rate > 0.5.
SENSITIVE_VALUE_RULES = [
    ("ssn", SSN_PATTERN),
    ("credit_card", CARD_PATTERN),
    ("email", LOOSE_EMAIL_PATTERN),
    ("phone", PHONE_PATTERN),
]
SENSITIVE_MATCH_RATE = 0.5


def type_by_name(column_name: str) -> str | None:
    low = column_name.lower()
    for typ, fragments in TYPE_NAME_RULES:
        if any(f in low for f in fragments):
            return typ
    return None


def sensitive_by_name(column_name: str) -> tuple[bool, str | None]:
    """(a name rule fired, resulting type). A fired rule may yield no type."""
    low = column_name.lower()
    for typ, fragments in SENSITIVE_NAME_RULES:
        if any(f in low for f in fragments):
            if any(x in low for x in NAME_RULE_EXCLUSIONS.get(typ, [])):
                return True, None
            return True, typ
    return False, None


def detected_type_expr() -> Column:
    """Semantic type from the per-column statistics table (column_stats).

    Expects columns: name_type, kind, count, non_null, unique_count,
    all_zero_one, email_rate, avg_words.
    """
    n = F.col("count")
    nu = F.col("unique_count")
    ratio = F.when(n > 0, nu / n).otherwise(F.lit(0.0))
    kind = F.col("kind")
    boolean_like = (kind == "boolean") | (
        ((F.col("non_null") == 0) | ((kind == "numeric") & F.coalesce(F.col("all_zero_one"), F.lit(False))))
        & (nu <= 2)
    )
    numeric = F.when((nu <= 20) | ((ratio < 0.05) & (nu < 50)), "categorical").otherwise("continuous")
    string = (
        F.when(F.col("email_rate") > 0.8, "email")
        .when(F.col("avg_words") > 10, "free_text")
        .when((nu <= 50) | (ratio < 0.1), "categorical")
        .when(F.col("avg_words") <= 5, "text")
        .otherwise("free_text")
    )
    return (
        F.when(F.col("name_type").isNotNull(), F.col("name_type"))
        .when(kind == "nested", "nested")
        .when(boolean_like, "boolean")
        .when(kind == "datetime", "datetime")
        .when(kind == "numeric", numeric)
        .when(kind == "string", string)
        .otherwise("text")
    )


def sensitive_columns(df: DataFrame) -> DataFrame:
    """(column, sensitive_type) for the columns a rule flags.

    Name rules first; value rules only for columns no name rule fired on,
    as match rates over all non-null values (one aggregate for every column
    and pattern). Value rules read string columns only: a date column never
    turns into a phone number through its text form. Columns with no
    non-null value are skipped.
    """
    aggs = []
    plan = []
    for i, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        aggs.append(F.count(c).alias(f"n{i}"))
        fired, typ = sensitive_by_name(field.name)
        plan.append((i, field.name, fired, typ))
        if not fired and isinstance(field.dataType, StringType):
            s = c
            for j, (_, pat) in enumerate(SENSITIVE_VALUE_RULES):
                aggs.append(F.avg(F.when(c.isNotNull(), rlike_u(s, pat).cast("int"))).alias(f"r{i}_{j}"))
    stats = df.agg(*aggs)
    rows = []
    for i, name, fired, typ in plan:
        if fired:
            t = F.lit(typ).cast("string")
        elif not isinstance(df.schema.fields[i].dataType, StringType):
            t = F.lit(None).cast("string")
        else:
            t = F.lit(None).cast("string")
            for j, (vt, _) in reversed(list(enumerate(SENSITIVE_VALUE_RULES))):
                t = F.when(F.col(f"r{i}_{j}") > SENSITIVE_MATCH_RATE, F.lit(vt)).otherwise(t)
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(i).alias("position"),
                F.when(F.col(f"n{i}") > 0, t).alias("sensitive_type"),
            )
        )
    out = stats.select(F.inline(F.array(*rows)))
    return out.filter(F.col("sensitive_type").isNotNull())
