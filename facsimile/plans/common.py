"""Output conventions shared by the registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DIGITS = 6


GUARD = 3


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column to ``digits`` decimals, in two steps.

    Step one snaps to ``digits + 3`` decimals, which removes the last-bit
    noise two engines leave on the same sum (a mean that is exactly
    0.0499185 may come out a hair above or below); step two rounds half
    away from zero. Each step is multiply, round to integer, divide -- exact
    and identical in Spark and in the SQL twin.
    """
    fine = float(10 ** (digits + GUARD))
    coarse = float(10**GUARD)
    scale = float(10**digits)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            snapped = F.round(c.cast("double") * F.lit(fine), 0) / F.lit(coarse)
            c = (F.round(snapped, 0) / F.lit(scale)).alias(f.name)
        out.append(c)
    return df.select(*out)


def r_sql(expr: str, digits: int = DIGITS) -> str:
    fine = f"{float(10 ** (digits + GUARD)):.1f}"
    coarse = f"{float(10**GUARD):.1f}"
    scale = f"{float(10**digits):.1f}"
    return f"(round(round(CAST({expr} AS DOUBLE) * {fine}) / {coarse}) / {scale})"
