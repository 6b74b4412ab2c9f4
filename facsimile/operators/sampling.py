"""Sampling the values of many columns by one index.

The index holds, for all sampled columns together, the cumulative counts of
their distinct values: (position, key, rank_start, rank_end). It takes one scan
that unpivots the columns, one aggregation and one distributed running total,
whatever the number of columns. The draws of all columns are unpivoted in the
same way and meet the index in one equi-join on (column, block): a block is a
stretch of ranks of the column's mean interval length, so a value that holds a
third of all rows covers many blocks and a block holds few values. One grouping
by row id brings the values of a row together.

Columns of at most ``FEW`` distinct values (their number is read from the index)
need no join: their values are found by a compiled binary search.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, CharType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType, VarcharType

from facsimile.functions.text import micros_to_ntz, ntz_micros
from facsimile.operators.ranking import lookup_by_rank, running_totals
from facsimile.session import cut_lineage

FEW = 128  # distinct values searched without a join
KEYS = ("a", "num", "text")  # whole number, number and text form of a value, in this order


@dataclass(frozen=True)
class Sampled:
    """A column to sample: its nulls are values like others, or left out."""

    position: int
    name: str
    data_type: DataType
    nulls: bool = True


def supported(t: DataType) -> bool:
    return isinstance(t, (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType, StringType, VarcharType, CharType, DateType, TimestampType, TimestampNTZType))


def _key(c: Sampled, value: Column) -> Column:
    """A value as (a, num, text), which order as the values do."""
    a, num, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    t = c.data_type
    if isinstance(t, (BooleanType, ByteType, ShortType, IntegerType, LongType)):
        a = value.cast("long")
    elif isinstance(t, (FloatType, DoubleType)):
        num = value.cast("double")
    elif isinstance(t, DecimalType):
        num, text = value.cast("double"), value.cast("string")
    elif isinstance(t, DateType):
        a = F.unix_date(value).cast("long")
    elif isinstance(t, TimestampType):
        a = F.unix_micros(value)
    elif isinstance(t, TimestampNTZType):
        a = ntz_micros(value)
    else:
        text = value.cast("string")
    return F.struct(F.lit(c.position).alias("position"), value.isNull().alias("none"), a.alias("a"), num.alias("num"), text.alias("text"))


def _value(t: DataType, key: Callable[[str], Column]) -> Column:
    """The value of a key, in the column's type."""
    if isinstance(t, (FloatType, DoubleType)):
        return key("num").cast(t)
    if isinstance(t, (DecimalType, StringType, VarcharType, CharType)):
        return key("text").cast(t)
    if isinstance(t, DateType):
        return F.date_from_unix_date(key("a").cast("int"))
    if isinstance(t, TimestampType):
        return F.timestamp_micros(key("a"))
    if isinstance(t, TimestampNTZType):
        return micros_to_ntz(key("a"))
    return key("a").cast(t)


@dataclass
class RankIndex:
    columns: list[Sampled]
    intervals: DataFrame  # (position, a, num, text, rank_start, rank_end), written
    totals: dict[int, int]  # rows that take part, per column
    distinct: dict[int, int]
    few: dict[int, list]  # (rank_end, key) of columns of few values, in order

    def total(self, position: int) -> int:
        return self.totals.get(position, 0)


def rank_index(src: DataFrame, columns: list[Sampled]) -> RankIndex:
    """Index the values of ``columns`` in their own order, nulls first."""
    if not columns:
        return RankIndex([], None, {}, {}, {})
    keep = F.array(*[F.lit(c.position) for c in columns if c.nulls]).cast("array<int>")
    long = src.select(F.inline(F.array(*[_key(c, F.col(f"`{c.name}`")) for c in columns])))
    counted = long.filter(~F.col("none") | F.array_contains(keep, F.col("position"))).groupBy("position", *KEYS).agg(F.count(F.lit(1)).alias("n"))
    intervals = cut_lineage(running_totals(counted, list(KEYS), weight=F.col("n"), group_cols=["position"]).select("position", *KEYS, "rank_start", "rank_end"))
    sizes = intervals.groupBy("position").agg(F.count(F.lit(1)).alias("k"), F.max("rank_end").alias("total")).collect()  # one row per column
    small = [r.position for r in sizes if r.k <= FEW]
    few: dict[int, list] = {p: [] for p in small}
    for r in intervals.filter(F.col("position").isin(small)).orderBy("position", "rank_start").collect() if small else []:  # at most FEW per column
        few[r.position].append((r.rank_end, {k: r[k] for k in KEYS}))
    return RankIndex(columns, intervals, {r.position: r.total for r in sizes}, {r.position: r.k for r in sizes}, few)


def _search(x: Column, ends: list[int], low: int, high: int) -> Column:
    """Number of the first end above x, as a balanced tree of comparisons."""
    if low >= high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(x < F.lit(ends[mid]), _search(x, ends, low, mid)).otherwise(_search(x, ends, mid + 1, high))


def _found(c: Sampled, few: list, at: Column) -> Column:
    """The value at a rank of a column of few values."""
    arrays = {k: F.array(*[F.lit(key[k]) for _, key in few]).cast({"a": "array<bigint>", "num": "array<double>", "text": "array<string>"}[k]) for k in KEYS}
    number = _search(at, [end for end, _ in few], 0, len(few) - 1) + 1
    return _value(c.data_type, lambda k: F.element_at(arrays[k], number))


def sample(rows: DataFrame, index: RankIndex, ranks: dict[int, Column], out: Callable[[int], str], id_col: str = "id") -> DataFrame:
    """(id, a column ``out(position)`` per sampled column) for each row of ``rows``.

    ``ranks`` gives the rank drawn for a row, per column, from 0 to the column's
    total. A column without values gives null. Ids must be distinct.
    """
    columns = {c.position: c for c in index.columns}
    joined = [p for p in ranks if index.total(p) and p not in index.few]
    inlined = [p for p in ranks if index.total(p) and p in index.few]
    drawn = rows.select(id_col, *[r.cast("long").alias(f"_r{p}") for p, r in ranks.items() if index.total(p)])
    if joined:
        width = {p: max(1, index.totals[p] // index.distinct[p]) for p in joined}
        widths = F.create_map(*[F.lit(x).cast(t) for p, w in width.items() for x, t in ((p, "int"), (w, "long"))])
        block = lambda df: df.withColumn("_width", widths[F.col("position")])
        # Draws of columns without a join go along with those of the first joined column.
        draws = drawn.select(
            id_col,
            F.inline(F.array(*[F.struct(F.lit(p).alias("position"), F.col(f"_r{p}").alias("_r"), *[(F.col(f"_r{q}") if p == joined[0] else F.lit(None).cast("long")).alias(f"_r{q}") for q in inlined]) for p in joined])),
        )
        hits = lookup_by_rank(block(index.intervals.filter(F.col("position").isin(joined))), block(draws), "_r", group_cols=["position"], bucket_width="_width")
        pick = [F.max(F.when(F.col("position") == p, F.struct(*KEYS))).alias(f"_k{p}") for p in joined]
        carried = [F.max(f"_r{q}").alias(f"_r{q}") for q in inlined]
        drawn = hits.groupBy(id_col).agg(*pick, *carried)
    made = []
    for p in ranks:
        c = columns[p]
        if p in joined:
            value = _value(c.data_type, lambda k, p=p: F.col(f"_k{p}")[k])
        elif p in inlined:
            value = _found(c, index.few[p], F.col(f"_r{p}"))
        else:
            value = F.lit(None).cast(c.data_type)
        made.append(value.alias(out(p)))
    return drawn.select(id_col, *made)
