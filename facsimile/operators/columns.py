"""The columns of a table by kind, and missing values made one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    ByteType,
    CharType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    ShortType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
    VarcharType,
)

NUMERIC = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType)


def kind_of(dt: DataType) -> str:
    if isinstance(dt, BooleanType):
        return "boolean"
    if isinstance(dt, NUMERIC):
        return "numeric"
    if isinstance(dt, (StringType, VarcharType, CharType)):
        return "string"
    if isinstance(dt, (TimestampType, TimestampNTZType, DateType)):
        return "datetime"
    if isinstance(dt, (ArrayType, MapType, StructType)):
        return "nested"
    return "other"


@dataclass(frozen=True)
class Col:
    position: int
    name: str
    kind: str
    data_type: str

    @property
    def ref(self) -> Column:
        return F.col(f"`{self.name}`")


def columns_of(df: DataFrame) -> list[Col]:
    return [Col(i, f.name, kind_of(f.dataType), f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]


def normalized(df: DataFrame) -> DataFrame:
    """Floats: NaN becomes null and -0.0 becomes 0.0 (missing = null or NaN)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (FloatType, DoubleType)):
            c = (F.nanvl(c, F.lit(None).cast(f.dataType)) + F.lit(0.0).cast(f.dataType)).alias(f.name)
        out.append(c.alias(f.name))
    return df.select(*out)
