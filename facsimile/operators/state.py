"""A column profile as a state that is saved per part and merges to that of the union.

A part's state is one row per column (rows, values, moments about the mean,
extremes, lengths, a sketch of the distinct values) and, where exact distinct
counts and quartiles are wanted, its table of value counts with texts as digests.
States merge by one small aggregation of the first and one sum by value of the
second; no row of a part is read again. So a table that grows by parts is
profiled at the cost of the new part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facsimile.functions.text import word_count
from facsimile.operators import heavy, radix
from facsimile.operators.columns import Col, columns_of, normalized
from facsimile.session import cut_lineage

SKETCH_BITS = 14
CHUNK = 2  # columns aggregated together: more make generated methods that the JVM only interprets
QUARTILES = [0.25, 0.5, 0.75]


@dataclass
class ProfileState:
    columns: DataFrame  # one row per column
    counts: DataFrame | None  # value counts, or None for sketched distinct counts
    plain: DataFrame | None = None  # ``columns`` with null sketches: exact statistics hash no value for them

    def save(self, path: str) -> None:
        self.columns.write.mode("errorifexists").parquet(f"{path}/columns")
        if self.counts is not None:
            self.counts.write.mode("errorifexists").parquet(f"{path}/counts")


def load(spark: SparkSession, path: str, exact: bool = True) -> ProfileState:
    return ProfileState(spark.read.parquet(f"{path}/columns"), spark.read.parquet(f"{path}/counts") if exact else None)


def _row(c: Col, sketched: bool = True) -> tuple[list[Column], Column]:
    """(aggregates, struct over them) of a column."""
    p = f"s{c.position}_"
    none = lambda t: F.lit(None).cast(t)
    aggs = {"n": F.count(c.ref)}
    if c.kind == "numeric":
        x = c.ref.cast("double")
        aggs |= {"mean": F.avg(x), "var": F.var_pop(x), "g1": F.skewness(x), "g2": F.kurtosis(x), "low": F.min(x), "high": F.max(x)}
    if c.kind == "string":
        aggs |= {"chars": F.sum(F.length(c.ref)), "words": F.sum(word_count(c.ref)), "short": F.min(F.length(c.ref)), "long": F.max(F.length(c.ref))}
    if c.kind != "nested" and sketched:
        aggs["sketch"] = F.hll_sketch_agg(F.xxhash64(c.ref.cast("string")), F.lit(SKETCH_BITS))
    at = lambda k, t: F.col(p + k).cast(t) if k in aggs else none(t)
    n, m2 = at("n", "double"), at("n", "double") * at("var", "double")
    m3 = F.when(m2 > 0, at("g1", "double") * F.pow(m2, 1.5) / F.sqrt(n)).otherwise(F.when(m2.isNotNull(), 0.0))
    m4 = F.when(m2 > 0, (at("g2", "double") + 3) * m2 * m2 / n).otherwise(F.when(m2.isNotNull(), 0.0))
    out = F.struct(
        F.lit(c.position).alias("position"), F.lit(c.name).alias("column"), F.lit(c.kind).alias("kind"), F.col("_rows").alias("rows"), at("n", "long").alias("n"),
        at("mean", "double").alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"), at("low", "double").alias("low"), at("high", "double").alias("high"),
        at("chars", "long").alias("chars"), at("words", "long").alias("words"), at("short", "long").alias("short"), at("long", "long").alias("long"),
        (F.col(p + "sketch") if "sketch" in aggs else none("binary")).alias("sketch"),
    )
    return [v.alias(p + k) for k, v in aggs.items()], out


def state_of(df: DataFrame, exact: bool = True) -> ProfileState:
    """The state of a table or of a part of it."""
    cols, rows = columns_of(df), normalized(df)

    def table(sketched: bool) -> DataFrame:
        out = None
        for at in range(0, max(1, len(cols)), CHUNK):
            made = [_row(c, sketched) for c in cols[at : at + CHUNK]]
            whole = rows.agg(F.count(F.lit(1)).alias("_rows"), *[a for aggs, _ in made for a in aggs])
            some = whole.select(F.inline(F.array(*[s for _, s in made])))
            out = some if out is None else out.unionByName(some)
        return out

    return ProfileState(table(True), heavy.value_counts(df) if exact else None, table(False) if exact else None)


def _joined(rows: DataFrame) -> DataFrame:
    """One row per column from those of the parts."""
    per = Window.partitionBy("position")  # one row per part
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(per), F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))).over(per))
    moved = rows.withColumn("_mean", mean).withColumn("_d", F.col("mean") - F.col("_mean"))
    n, d, m2, m3, m4 = (F.col(c) for c in ("n", "_d", "m2", "m3", "m4"))
    return moved.groupBy("position", "column", "kind").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max("_mean").alias("mean"),
        F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"), F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.min("short").alias("short"), F.max("long").alias("long"),
        F.hll_union_agg("sketch").alias("sketch"),
    )


def merged(states: list[ProfileState]) -> ProfileState:
    """The state of the union of the parts, whose columns are the same."""
    rows, counts, plain = states[0].columns, states[0].counts, states[0].plain
    for s in states[1:]:
        rows = rows.unionByName(s.columns)
        plain = None if plain is None or s.plain is None else plain.unionByName(s.plain)
        counts = None if counts is None or s.counts is None else counts.unionByName(s.counts)
    if counts is not None:
        counts = counts.groupBy("position", "column", "a", "b", "num").agg(F.min("start").alias("start"), F.sum("n").alias("n"))
    return ProfileState(_joined(rows), counts, None if plain is None else _joined(plain))


def statistics(state: ProfileState) -> DataFrame:
    """Counts, distinct values, moments, lengths and (if exact) quartiles of each column."""
    n = F.when(F.col("n") > 0, F.col("n").cast("double"))
    var = F.when(F.col("n") > 1, F.col("m2") / (n - 1))
    # A constant column may keep a variance of rounding errors: it has no shape.
    flat = F.col("m2") <= n * F.col("mean") * F.col("mean") * F.lit(1e-24)
    g1 = F.when(~flat, F.sqrt(n) * F.col("m3") / F.pow("m2", F.lit(1.5)))
    g2 = F.when(~flat, n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3)
    out = (state.columns if state.counts is None or state.plain is None else state.plain).select(
        "position", "column", F.col("rows").alias("count"), F.col("n").alias("non_null"), (F.col("rows") - F.col("n")).alias("null_count"), "mean", F.sqrt(var).alias("std"), F.col("low").alias("min"), F.col("high").alias("max"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        (F.col("chars") / n).alias("avg_length"), F.col("short").alias("min_length"), F.col("long").alias("max_length"), (F.col("words") / n).alias("avg_words"), F.hll_sketch_estimate("sketch").alias("_near"),
    )
    if state.counts is None:
        return out.withColumn("unique_count", F.coalesce("_near", F.lit(0))).drop("_near")
    counts = cut_lineage(state.counts)
    distinct = counts.groupBy("position").agg(F.count(F.lit(1)).alias("unique_count"))
    found = radix.quantiles(counts.filter("num is not null").select("position", "num", "n"), radix.read_long, QUARTILES)
    quartiles = out.sparkSession.createDataFrame([(p, *v) for p, v in found.items()], "position int, q25 double, median double, q75 double")
    # Both sides have one row per column.
    return out.drop("_near").join(distinct, "position", "left").join(quartiles, "position", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
