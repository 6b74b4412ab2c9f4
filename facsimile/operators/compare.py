"""Source vs synthetic comparison.

Each side is reduced by one aggregate (moments, distinct counts, all pair
correlations); only per-column rows are joined. Distribution distances work
on per-value counts of both sides (one union + one aggregation), and the KS
statistic takes one distributed running total of a signed weight:

    D(v) = sum over values <= v of (a / N1 - b / N2),   KS = max |D(v)|

so no column is ever sorted in a single task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from facsimile.functions.rand import row_uniform
from facsimile.functions.text import ntz_micros
from facsimile.operators.profile import columns_of, correlation_matrix, normalized
from facsimile.operators.ranking import running_totals
from facsimile.operators.reservoir import reservoir
from facsimile.session import cut_lineage

ORIGINAL, SYNTHETIC = "original", "synthetic"


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    other = set(b.columns)
    return [c for c in a.columns if c in other]


def _numeric_for_compare(df: DataFrame) -> set[str]:
    """Numbers and booleans count as numeric in the stats comparison."""
    return {c.name for c in columns_of(df) if c.kind in ("numeric", "boolean")}


def digest(value: Column) -> list[Column]:
    """128 bits of a value (two 64-bit hashes); nulls have nulls."""
    return [F.when(value.isNotNull(), F.xxhash64(F.lit(seed), value)) for seed in (1, 2)]


def digests(df: DataFrame, columns: list[tuple[int, Column]]) -> DataFrame:
    """(position, d1, d2) of every value that is there, for all columns in one scan."""
    entries = [F.struct(F.lit(p).alias("position"), *[d.alias(f"d{k}") for k, d in enumerate(digest(v), 1)]) for p, v in columns]
    return df.select(F.inline(F.array(*entries))).filter("d1 is not null")


def compare_stats(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Per common column, mean/std of each side, or distinct counts."""
    cols = common_columns(original, synthetic)
    num = _numeric_for_compare(original) & _numeric_for_compare(synthetic)

    def side(df: DataFrame, tag: str) -> DataFrame:
        df = normalized(df)
        aggs, entries = [F.count(F.lit(1)).alias("_rows")], []
        none = F.lit(None).cast("double")
        for i, c in enumerate(cols):
            mean, std = none, none
            if c in num:
                ref = F.col(f"`{c}`")
                x = ref.cast("int").cast("double") if isinstance(df.schema[c].dataType, BooleanType) else ref.cast("double")
                aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
                mean, std = F.col(f"m{i}"), F.col(f"s{i}")
            entries.append(F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), mean.alias("mean"), std.alias("std")))
        out = df.agg(*aggs).select(F.inline(F.array(*entries)))
        # Distinct values of the other columns: one aggregation of digests for all of them.
        others = [(i, c) for i, c in enumerate(cols) if c not in num]
        if others:
            found = digests(df, [(i, F.col(f"`{c}`")) for i, c in others]).distinct().groupBy("position").agg(F.count(F.lit(1)).alias("unique"))
            out = out.join(found, "position", "left").withColumn("unique", F.when(F.col("position").isin([i for i, _ in others]), F.coalesce("unique", F.lit(0))))
        else:
            out = out.withColumn("unique", F.lit(None).cast("long"))
        return out.select("column", "position", *[F.col(k).alias(f"{tag}_{k}") for k in ("mean", "std", "unique")])

    a = side(original, "orig")
    b = side(synthetic, "synth")
    out = a.join(b, ["column", "position"])
    return out.select(
        "column", "position", "orig_mean", "synth_mean", "orig_std", "synth_std", "orig_unique", "synth_unique"
    )


def histogram(original: DataFrame, synthetic: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts of both sides on shared equal-width bins over both ranges.

    Every bin is there, also without rows; a constant column fills bin 0.
    """
    x = F.col(f"`{column}`").cast("double")
    both = normalized(original).select(x.alias("x"), F.lit(ORIGINAL).alias("side")).unionByName(
        normalized(synthetic).select(x.alias("x"), F.lit(SYNTHETIC).alias("side"))
    ).filter(F.col("x").isNotNull())
    lo, hi = both.agg(F.min("x"), F.max("x")).first()  # two numbers to the driver
    if lo is None:
        return both.sparkSession.createDataFrame([], "column string, bin int, bin_start double, bin_end double, orig_count long, synth_count long")
    width = (hi - lo) / bins
    b = (F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)).cast("int")
    counts = both.groupBy(b.alias("bin")).agg(
        F.count_if(F.col("side") == ORIGINAL).alias("orig_count"), F.count_if(F.col("side") == SYNTHETIC).alias("synth_count")
    )
    every = both.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counts = every.join(counts, "bin", "left").na.fill(0, ["orig_count", "synth_count"])
    return counts.select(
        F.lit(column).alias("column"), "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
        F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
        "orig_count", "synth_count",
    )


def raw_values(original: DataFrame, synthetic: DataFrame, column: str, key_cols: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Up to ``n`` values of each side (side, rank, value), drawn by a keyed uniform of ``key_cols``.

    Without key columns the draws depend on all columns of a row.
    """
    parts = []
    for df, side in ((original, ORIGINAL), (synthetic, SYNTHETIC)):
        draw = row_uniform(key_cols or df.columns, seed, side)
        parts.append(reservoir(normalized(df), F.col(f"`{column}`"), draw, n).select(F.lit(side).alias("side"), "rank", "value"))
    return parts[0].unionByName(parts[1])


def category_counts(original: DataFrame, synthetic: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Top-k value counts of each side (ties: smaller value first)."""
    from pyspark.sql import Window

    c = F.col(f"`{column}`").cast("string")
    both = original.select(c.alias("value"), F.lit(ORIGINAL).alias("side")).unionByName(
        synthetic.select(c.alias("value"), F.lit(SYNTHETIC).alias("side"))
    ).filter(F.col("value").isNotNull())
    counts = both.groupBy("side", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("side").orderBy(F.col("count").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        F.lit(column).alias("column"), "side", "rank", "value", "count"
    )


def _common_numeric(original: DataFrame, synthetic: DataFrame) -> list[str]:
    a = {c.name for c in columns_of(original) if c.kind == "numeric"}
    b = {c.name for c in columns_of(synthetic) if c.kind == "numeric"}
    return sorted(a & b)


def correlation_pairs(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """E4 + E5: upper-triangle pairs of common numeric columns (by name).

    original, synthetic, difference and abs difference, rounded half-even to
    3 decimals, sorted by abs difference. Fewer than 2 columns is an error.
    """
    cols = _common_numeric(original, synthetic)
    if len(cols) < 2:
        raise ValueError("Not enough numeric columns for correlation analysis (need at least 2)")
    a = correlation_matrix(original, cols).withColumnRenamed("correlation", "o")
    b = correlation_matrix(synthetic, cols).withColumnRenamed("correlation", "s")
    rank = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    j = a.join(b, ["column1", "column2"]).filter(rank[F.col("column1")] < rank[F.col("column2")])
    d = F.col("o") - F.col("s")
    out = j.select(
        "column1", "column2", F.bround("o", 3).alias("original"), F.bround("s", 3).alias("synthetic"),
        F.bround(d, 3).alias("difference"), F.bround(F.abs(d), 3).alias("abs_difference"),
        F.col("o").alias("_o"), F.col("s").alias("_s"),
    )
    return out.orderBy(F.desc_nulls_last("abs_difference"), "column1", "column2")


def correlation_matrices(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Original, synthetic and difference matrices in long form, rounded
    half-even to 3 decimals, every ordered pair of common numeric columns."""
    cols = _common_numeric(original, synthetic)
    if len(cols) < 2:
        raise ValueError("Not enough numeric columns for correlation analysis (need at least 2)")
    a = correlation_matrix(original, cols).withColumnRenamed("correlation", "o")
    b = correlation_matrix(synthetic, cols).withColumnRenamed("correlation", "s")
    return a.join(b, ["column1", "column2"]).select(
        "column1", "column2", F.bround("o", 3).alias("original"), F.bround("s", 3).alias("synthetic"), F.bround(F.col("o") - F.col("s"), 3).alias("difference")
    )


def correlation_metrics(pairs: DataFrame) -> DataFrame:
    """MAE, RMSE, max abs difference, correlation of correlations."""
    d = F.col("_o") - F.col("_s")
    both = F.col("_o").isNotNull() & F.col("_s").isNotNull()
    o, s = F.when(both, F.col("_o")), F.when(both, F.col("_s"))
    return pairs.agg(
        F.bround(F.avg(F.abs(d)), 3).alias("mae"),
        F.bround(F.sqrt(F.avg(d * d)), 3).alias("rmse"),
        F.bround(F.max(F.abs(d)), 3).alias("max_difference"),
        F.bround(F.try_divide(F.covar_pop(o, s), F.sqrt(F.var_pop(o) * F.var_pop(s))), 3).alias("correlation_of_correlations"),
        F.count(F.lit(1)).alias("pairs"),
    )


# ----------------------------------------------------------------- quality

def _shape_value(c, df: DataFrame) -> Column:
    ref = F.col(f"`{c.name}`")
    if c.kind == "datetime":
        return (F.unix_micros(ref) if c.data_type == "timestamp" else ntz_micros(ref)).cast("double")
    return ref.cast("double")


def column_shapes(original: DataFrame, synthetic: DataFrame, categorical: list[str] | None = None) -> DataFrame:
    """E7 shapes: 1 - KS for numeric/datetime columns, 1 - TV for the rest.

    A column with values on one side only scores 0, without any null.
    """
    cols = [c for c in columns_of(original) if c.name in set(synthetic.columns) and c.kind != "nested"]
    cat = set(categorical or [])
    cont = [c for c in cols if c.kind in ("numeric", "datetime") and c.name not in cat]
    disc = [c for c in cols if c not in cont]
    parts = []
    if cont:
        def long(df: DataFrame, sign: int) -> DataFrame:
            entries = [F.struct(F.lit(c.position).alias("position"), _shape_value(c, df).alias("v")) for c in cont]
            return normalized(df).select(F.inline(F.array(*entries))).filter(F.col("v").isNotNull()).withColumn("side", F.lit(sign))

        both = long(original, 1).unionByName(long(synthetic, -1))
        sizes = both.groupBy("position").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == -1).alias("n2"))
        freq = both.groupBy("position", "v").agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == -1).alias("b"))
        freq = freq.join(F.broadcast(sizes), "position")  # one row per column
        share = lambda k, n: F.coalesce(F.try_divide(F.col(k), F.col(n)), F.lit(0.0))
        w = share("a", "n1") - share("b", "n2")
        ranked = running_totals(freq, ["v"], weight=w, group_cols=["position"], weight_type="double")
        ks = ranked.groupBy("position").agg(F.max(F.abs(F.col("rank_end"))).alias("_d"))
        parts.append(ks.select("position", F.lit("KSComplement").alias("metric"), (1 - F.col("_d")).alias("score")))
    if disc:
        def long_s(df: DataFrame, side: int) -> DataFrame:
            return digests(df, [(c.position, F.col(f"`{c.name}`").cast("string")) for c in disc]).withColumn("side", F.lit(side))

        both = long_s(original, 1).unionByName(long_s(synthetic, -1))
        freq = both.groupBy("position", "d1", "d2").agg(F.count_if(F.col("side") == 1).alias("a"), F.count_if(F.col("side") == -1).alias("b"))
        tot = freq.groupBy("position").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
        tv = freq.join(F.broadcast(tot), "position").groupBy("position").agg(
            F.coalesce(0.5 * F.sum(F.abs(F.try_divide(F.col("a"), F.col("n1")) - F.try_divide(F.col("b"), F.col("n2")))), F.lit(1.0)).alias("_tv")
        )
        parts.append(tv.select("position", F.lit("TVComplement").alias("metric"), (1 - F.col("_tv")).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    every = [(c.name, c.position, "KSComplement" if c in cont else "TVComplement") for c in cols]
    listed = original.sparkSession.createDataFrame(every, "column string, position int, metric string")
    return listed.join(out.drop("metric"), "position", "left").select("column", "position", "metric", "score")


BINS = 10  # a number is cut into so many bins over the original's range beside a category


def _as_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """The named numeric and datetime columns as doubles."""
    cols = {c.name: c for c in columns_of(df)}
    return normalized(df).select(*[_shape_value(cols[n], df).alias(n) for n in names])


def _bin(x: Column, lo: float | None, hi: float | None) -> Column:
    """0 below the range, 1..BINS inside it, BINS + 1 from its end on."""
    if lo is None or hi == lo:
        return F.when(x.isNotNull(), 1)
    inside = F.floor((x - F.lit(lo)) / F.lit((hi - lo) / BINS)) + 1
    return F.when(x < F.lit(lo), 0).when(x >= F.lit(hi), BINS + 1).otherwise(F.least(inside, F.lit(BINS)))


SMALL = 4096  # distinct values of a column whose values get dense numbers
CELLS = 1 << 16  # cells of a pair that a task counts in an array


def _dense(sides: list[DataFrame], positions: list[int]) -> dict[int, np.ndarray]:
    """position -> sorted first digests of the values of a column, where there are at most SMALL.

    A value's place in them is its number. One aggregation of digests over both
    tables; the columns of more values, or with equal first digests, are left out.
    """
    values = None
    for df in sides:
        part = df.select(F.inline(F.array(*[F.struct(F.lit(p).alias("position"), F.col(f"d{p}").alias("d1"), F.col(f"e{p}").alias("d2")) for p in positions])))
        values = part if values is None else values.union(part)
    known = cut_lineage(values.filter("d1 is not null").distinct())
    sizes = known.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("d1").alias("k")).collect()  # one row per column
    small = [r.position for r in sizes if r.n == r.k <= SMALL]
    out = {p: [] for p in positions if p in small or p not in {r.position for r in sizes}}
    for r in known.filter(F.col("position").isin(small)).collect() if small else []:  # at most SMALL per column
        out[r.position].append(r.d1)
    return {p: np.sort(np.array(v, np.int64)) for p, v in out.items()}


def _count_cells(pairs: list[tuple[int, int, int]], numbers: dict[int, np.ndarray]):
    """Arrow function: the cells of pairs (number, x, y) in arrays over dense numbers; a null is the last number."""

    def run(batches):
        import pyarrow as pa

        columns = sorted({p for _, x, y in pairs for p in (x, y)})
        counts = {k: np.zeros((len(numbers[x]) + 1) * (len(numbers[y]) + 1), np.int64) for k, x, y in pairs}
        for batch in batches:
            code = {}
            for p in columns:
                digest = batch.column(batch.schema.get_field_index(f"d{p}"))
                place = np.searchsorted(numbers[p], digest.fill_null(0).to_numpy(zero_copy_only=False))
                code[p] = np.where(digest.is_null().to_numpy(zero_copy_only=False), len(numbers[p]), place)
            for k, x, y in pairs:
                counts[k] += np.bincount(code[x] * (len(numbers[y]) + 1) + code[y], minlength=len(counts[k]))
        for k, n in counts.items():
            cells = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), k, np.int32)), pa.array(cells), pa.array(n[cells])], ["pair", "cell", "n"])

    return run


def pair_trends(original: DataFrame, synthetic: DataFrame, categorical: list[str] | None = None) -> DataFrame:
    """E7 pair trends over all pairs of common columns (nested ones excepted).

    Numbers and datetimes: correlation similarity, 1 - |difference| / 2. Text,
    booleans and the columns in ``categorical``: contingency similarity, 1 -
    half the sum of differences of the cells' shares; a number beside such a
    column is binned first. Nulls are a value of their own in a cell. A table
    without rows scores 0, an undefined correlation null.

    Values are digested once per column. Columns of few values then have dense
    numbers, and each task counts the cells of their pairs in arrays; the cells
    of the other pairs are counted by the digest of the two digests. No value
    is shuffled.
    """
    spark = original.sparkSession
    there = {c.name for c in columns_of(synthetic)}
    cols = [c for c in columns_of(original) if c.name in there and c.kind not in ("nested", "other")]
    marked = set(categorical or [])
    num = sorted(c.name for c in cols if c.kind in ("numeric", "datetime") and c.name not in marked)
    parts = []
    if len(num) >= 2:
        a = correlation_matrix(_as_numbers(original, num), num).withColumnRenamed("correlation", "o")
        b = correlation_matrix(_as_numbers(synthetic, num), num).withColumnRenamed("correlation", "s")
        j = a.join(b, ["column1", "column2"]).filter(F.col("column1") < F.col("column2"))
        parts.append(j.select("column1", "column2", F.lit("CorrelationSimilarity").alias("metric"), (1 - F.abs(F.col("o") - F.col("s")) / 2).alias("score")))
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i + 1 :] if x.name not in num or y.name not in num]
    if pairs:
        binned = [n for n in num if any(n in (x.name, y.name) for x, y in pairs)]
        row = _as_numbers(original, binned).agg(*[f(F.col(f"`{n}`")).alias(f"{f.__name__}{i}") for i, n in enumerate(binned) for f in (F.min, F.max)]).first() if binned else None
        ranges = {n: (row[f"min{i}"], row[f"max{i}"]) for i, n in enumerate(binned)}
        used = [c for c in cols if any(c in p for p in pairs)]
        whole = [c.position for c in used if c.name not in ranges]

        def flat(df: DataFrame) -> DataFrame:
            """d<position>, e<position>: digests of a column's values; of a binned number its bin (and no e)."""
            mine = {c.name: c for c in columns_of(df)}
            out = []
            for c in used:
                if c.name in ranges:
                    out.append(_bin(_shape_value(mine[c.name], df), *ranges[c.name]).cast("long").alias(f"d{c.position}"))
                else:
                    out += [d.alias(f"{k}{c.position}") for k, d in zip("de", digest(F.col(f"`{c.name}`").cast("string")))]
            return normalized(df).select(*out)

        sides = [flat(original), flat(synthetic)]
        numbers = _dense(sides, whole) | {c.position: np.arange(BINS + 2) for c in used if c.name in ranges}
        size = lambda c: len(numbers[c.position]) + 1
        dense = [i for i, (x, y) in enumerate(pairs) if x.position in numbers and y.position in numbers and size(x) * size(y) <= CELLS]
        rest = [i for i in range(len(pairs)) if i not in dense]
        counted = []
        for df, mark in zip(sides, (F.lit(1), F.lit(-1))):
            if dense:
                wanted = [(i, pairs[i][0].position, pairs[i][1].position) for i in dense]
                columns = sorted({p for _, x, y in wanted for p in (x, y)})
                found = df.select(*[f"d{p}" for p in columns]).mapInArrow(_count_cells(wanted, {p: numbers[p] for p in columns}), "pair int, cell bigint, n bigint")
                counted.append(found.select("pair", F.col("cell").alias("x"), F.lit(0).cast("long").alias("y"), "n", mark.alias("side")))
            if rest:
                key = lambda c, k: F.coalesce(F.col(f"{k if c.position in whole else 'd'}{c.position}"), F.lit(0).cast("long"))
                entries = [F.struct(F.lit(i).alias("pair"), *[F.xxhash64(F.lit(n), key(pairs[i][0], k), key(pairs[i][1], k)).alias(o) for n, k, o in ((1, "d", "x"), (2, "e", "y"))]) for i in rest]
                found = df.select(F.inline(F.array(*entries))).groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n"))
                counted.append(found.select("pair", "x", "y", "n", mark.alias("side")))
        both = counted[0]
        for c in counted[1:]:
            both = both.union(c)
        on = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))
        freq = cut_lineage(both.groupBy("pair", "x", "y").agg(on(1).alias("a"), on(-1).alias("b")))
        sizes = freq.groupBy("pair").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
        apart = F.abs(F.try_divide(F.col("a"), F.col("n1")) - F.try_divide(F.col("b"), F.col("n2")))
        # sizes: one row per pair of columns.
        scores = freq.join(sizes, "pair").groupBy("pair").agg(F.coalesce(1 - 0.5 * F.sum(apart), F.lit(0.0)).alias("score"))
        listed = spark.createDataFrame([(i, x.name, y.name) for i, (x, y) in enumerate(pairs)], "pair int, column1 string, column2 string")
        parts.append(listed.join(scores, "pair", "left").select("column1", "column2", F.lit("ContingencySimilarity").alias("metric"), F.coalesce("score", F.lit(0.0)).alias("score")))
    if not parts:
        return spark.createDataFrame([], "column1 string, column2 string, metric string, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_report(original: DataFrame, synthetic: DataFrame, categorical: list[str] | None = None) -> DataFrame:
    """(property, score) rows for Column Shapes, Column Pair Trends and
    the overall score (mean of the property scores that exist)."""
    shapes = column_shapes(original, synthetic, categorical).agg(F.avg("score").alias("score")).select(F.lit("Column Shapes").alias("property"), "score")
    trends = pair_trends(original, synthetic, categorical).agg(F.avg("score").alias("score")).select(F.lit("Column Pair Trends").alias("property"), "score")
    props = shapes.unionByName(trends)
    overall = props.agg(F.avg("score").alias("score")).select(F.lit("Overall").alias("property"), "score")
    return props.unionByName(overall)
