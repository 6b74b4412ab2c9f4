"""Scalar helpers re-aimed as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType, TimestampNTZType, TimestampType


def fixed(x: Column, decimals: int) -> Column:
    """A double with so many decimals; its exact binary value is rounded (half to even), so 1.115 gives 1.11."""
    return F.replace(F.format_number(x.cast("double"), decimals), F.lit(","), F.lit(""))


def compact_number(x: Column, decimals: int = 2) -> Column:
    """N/A for missing; B / M / K suffix by absolute size; else
    thousands separators."""
    v = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    a = F.abs(v)
    return (
        F.when(v.isNull(), F.lit("N/A"))
        .when(a >= 1e9, F.concat(fixed(v / 1e9, decimals), F.lit("B")))
        .when(a >= 1e6, F.concat(fixed(v / 1e6, decimals), F.lit("M")))
        .when(a >= 1e3, F.concat(fixed(v / 1e3, decimals), F.lit("K")))
        .otherwise(F.format_number(v, decimals))
    )


def truncate(s: Column, max_length: int = 50) -> Column:
    """cut to max_length characters ending in '...'."""
    return F.when(F.length(s) > max_length, F.concat(F.substring(s, 1, max_length - 3), F.lit("..."))).otherwise(s)


def _json_value(c: Column, kind: DataType) -> Column:
    """The value with NaN/inf as null and timestamps as text, at any depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast(kind)).otherwise(c)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, ArrayType) and _has_leaf(kind):
        return F.transform(c, lambda x: _json_value(x, kind.elementType))
    if isinstance(kind, MapType) and _has_leaf(kind.valueType):
        return F.transform_values(c, lambda _, x: _json_value(x, kind.valueType))
    if isinstance(kind, StructType) and _has_leaf(kind):
        return F.when(c.isNotNull(), F.struct(*[_json_value(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return c


def _has_leaf(kind: DataType) -> bool:
    """The type holds a value that ``_json_value`` changes."""
    if isinstance(kind, ArrayType):
        return _has_leaf(kind.elementType)
    if isinstance(kind, MapType):
        return _has_leaf(kind.valueType)
    if isinstance(kind, StructType):
        return any(_has_leaf(f.dataType) for f in kind.fields)
    return isinstance(kind, (DoubleType, FloatType, TimestampType, TimestampNTZType))


def json_safe(df: DataFrame) -> DataFrame:
    """one JSON text per row; NaN/inf become null and timestamps text, also
    inside arrays, maps and structs; null fields written."""
    cols = [_json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
