"""Table profile as a handful of flat DataFrames.

Passes over the source table:

* one global aggregate with every per-column scalar statistic (partial
  aggregation per task, one small merge);
* one frequency table ``(position, column, value, n)`` over all scalar
  columns -- one shuffle -- that yields distinct counts, top-k values, rare
  categories and sample values;
* exact percentiles by counting passes over order-preserving keys (no sort),
  or ``percentile_approx`` when ``exact=False``;
* one scan with all pairwise correlations (k x k sums per task).

Nothing is collected to the driver except when a caller asks for the
column configuration (one row per column).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.functions.format import fixed
from facsimile.functions.text import DIGIT_PATTERN, EMAIL_VALUE_PATTERN, SPECIAL_PATTERN, micros_to_ntz, rlike_u, word_count
from facsimile.operators import heavy, radix
from facsimile.operators.columns import NUMERIC, Col, columns_of, kind_of, normalized
from facsimile.operators.detect import detected_type_expr, type_by_name
from facsimile.session import cut_lineage

# The percentiles of the distribution profile, and the
# generation method recommended for each semantic type.
DISTRIBUTION_PROBS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
QUARTILE_PROBS = [0.25, 0.5, 0.75]
METHOD_BY_TYPE = {
    "continuous": "gaussian_copula",
    "categorical": "frequency_sampling",
    "text": "faker_text",
    "free_text": "markov_chain",
    "datetime": "datetime_range",
    "boolean": "bernoulli",
    "id": "uuid",
    "email": "faker_email",
    "phone": "faker_phone",
    "address": "faker_address",
    "name": "faker_name",
}
DEFAULT_METHOD = "sample"

def _num(c: Col) -> Column:
    return c.ref.cast("double")


def _as_ntz(c: Col) -> Column:
    return c.ref.cast("timestamp_ntz")


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def _scalar_aggs(cols: list[Col]) -> tuple[list[Column], list[Column]]:
    """(aggregate expressions, per-column struct over the aggregate row)."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    structs: list[Column] = []
    for c in cols:
        p = f"s{c.position}_"

        def a(stat: str, expr: Column) -> Column:
            aggs.append(expr.alias(p + stat))
            return F.col(p + stat)

        non_null = a("nn", F.count(c.ref))
        true_count = false_count = _null("long")
        mean = std = mn = mx = skew = kurt = _null("double")
        is_int = has_neg = zero_one = _null("boolean")
        avg_len = avg_words = email_rate = digit_rate = special_rate = _null("double")
        min_len = max_len = _null("long")
        min_t = max_t = _null("timestamp_ntz")
        has_time = _null("boolean")
        if c.kind == "boolean":
            true_count = a("tc", F.count_if(c.ref))
            false_count = a("fc", F.count_if(~c.ref))
        elif c.kind == "numeric":
            x = _num(c)
            mean = a("mean", F.avg(x))
            std = a("std", F.stddev_samp(x))
            mn = a("min", F.min(x))
            mx = a("max", F.max(x))
            g1 = a("g1", F.skewness(x))
            g2 = a("g2", F.kurtosis(x))
            n = non_null.cast("double")
            skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
            kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
            is_int = a("int", F.bool_and(x == F.floor(x)))
            has_neg = a("neg", F.bool_or(x < 0))
            zero_one = a("z1", F.bool_and(x.isin(0.0, 1.0)))
        elif c.kind == "string":
            ln = F.length(c.ref)
            avg_len = a("avgl", F.avg(ln))
            min_len = a("minl", F.min(ln).cast("long"))
            max_len = a("maxl", F.max(ln).cast("long"))
            avg_words = a("words", F.avg(word_count(c.ref)))
            email_rate = a("email", F.avg(rlike_u(c.ref, EMAIL_VALUE_PATTERN).cast("int")))
            digit_rate = a("digit", F.avg(rlike_u(c.ref, DIGIT_PATTERN).cast("int")))
            special_rate = a("special", F.avg(rlike_u(c.ref, SPECIAL_PATTERN).cast("int")))
        elif c.kind == "datetime":
            t = _as_ntz(c)
            min_t = a("mint", F.min(t))
            max_t = a("maxt", F.max(t))
            has_time = a("time", F.bool_or((F.hour(t) != 0) | (F.minute(t) != 0)))
        structs.append(
            F.struct(
                F.lit(c.name).alias("column"),
                F.lit(c.position).alias("position"),
                F.lit(c.data_type).alias("data_type"),
                F.lit(c.kind).alias("kind"),
                F.lit(type_by_name(c.name)).cast("string").alias("name_type"),
                F.col("_rows").alias("count"),
                non_null.alias("non_null"),
                (F.col("_rows") - non_null).alias("null_count"),
                true_count.alias("true_count"),
                false_count.alias("false_count"),
                mean.alias("mean"),
                std.alias("std"),
                mn.alias("min"),
                mx.alias("max"),
                skew.alias("skewness"),
                kurt.alias("kurtosis"),
                is_int.alias("is_integer"),
                has_neg.alias("has_negative"),
                zero_one.alias("all_zero_one"),
                avg_len.alias("avg_length"),
                min_len.alias("min_length"),
                max_len.alias("max_length"),
                avg_words.alias("avg_words"),
                email_rate.alias("email_rate"),
                digit_rate.alias("digit_rate"),
                special_rate.alias("special_rate"),
                min_t.alias("min_time"),
                max_t.alias("max_time"),
                has_time.alias("has_time"),
            )
        )
    return aggs, structs


# Whole-stage codegen is switched off for a plan with more than
# spark.sql.codegen.maxFields (100) fields; a wide aggregate over many
# columns then runs interpreted (measured 14 s instead of 1.5 s on 600k rows).
# Aggregates are therefore built per chunk of columns under this budget.
# Each chunk's scan reads only its own columns, so total I/O stays the same.
FIELD_BUDGET = 90
FIELDS_PER_KIND = {"numeric": 24, "string": 16, "datetime": 5, "boolean": 4, "nested": 2, "other": 2}


def column_chunks(cols: list[Col], budget: int = FIELD_BUDGET) -> list[list[Col]]:
    chunks: list[list[Col]] = [[]]
    used = 0
    for c in cols:
        w = FIELDS_PER_KIND.get(c.kind, 4)
        if chunks[-1] and used + w > budget:
            chunks.append([])
            used = 0
        chunks[-1].append(c)
        used += w
    return [ch for ch in chunks if ch]


def scalar_stats(df: DataFrame) -> DataFrame:
    """One row per column with every statistic one pass can give (per chunk)."""
    norm = normalized(df)
    out = None
    for chunk in column_chunks(columns_of(df)):
        aggs, structs = _scalar_aggs(chunk)
        part = norm.agg(*aggs).select(F.inline(F.array(*structs)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "column string, position int")
    return out


def _value_text(c: Col) -> Column:
    if c.kind == "datetime":
        return _as_ntz(c).cast("string")
    return c.ref.cast("string")


def frequency_table(df: DataFrame, include_nulls: bool = False) -> DataFrame:
    """Long frequency table (position, column, value, num, n) of scalar columns.

    ``value`` is the text form; ``num`` the double form for numeric columns
    (for numeric ordering). One explode and one aggregation: map-side partial
    aggregation collapses repeated values before the shuffle. Numbers are
    grouped in their own type and turned into text only after aggregation
    (once per distinct value, not once per row).
    """
    cols = [c for c in columns_of(df) if c.kind in ("boolean", "numeric", "string", "datetime")]
    if not cols:
        schema = "position int, column string, value string, num double, n long"
        return df.sparkSession.createDataFrame([], schema)

    def entry(c: Col) -> Column:
        integral = c.data_type in ("tinyint", "smallint", "int", "bigint")
        text = _null("string") if c.kind == "numeric" else _value_text(c)
        inum = c.ref.cast("long") if integral else _null("long")
        num = _num(c) if (c.kind == "numeric" and not integral) else _null("double")
        return F.struct(F.lit(c.position).alias("position"), text.alias("value"), num.alias("num"), inum.alias("inum"))

    names = F.create_map(*[x for c in cols for x in (F.lit(c.position), F.lit(c.name))])
    long = normalized(df).select(F.inline(F.array(*[entry(c) for c in cols])))
    if not include_nulls:
        long = long.filter(F.col("value").isNotNull() | F.col("num").isNotNull() | F.col("inum").isNotNull())
    freq = long.groupBy("position", "value", "num", "inum").agg(F.count(F.lit(1)).alias("n"))
    text = F.coalesce(F.col("value"), F.col("inum").cast("string"), F.col("num").cast("string"))
    num = F.coalesce(F.col("num"), F.col("inum").cast("double"))
    return freq.select("position", names[F.col("position")].alias("column"), text.alias("value"), num.alias("num"), "n")


def distinct_counts(freq: DataFrame) -> DataFrame:
    return freq.groupBy("position").agg(F.count(F.lit(1)).alias("unique_count"))


def top_values(freq: DataFrame, k: int, numeric_order: bool = False) -> DataFrame:
    """Top-k values per column by count (ties: smaller value first).

    ``row_number() <= k`` lets Spark insert a partial per-task group limit
    before the shuffle, so one column with billions of distinct values never
    goes to one task whole.
    """
    order = [F.col("n").desc(), F.col("num").asc_nulls_last(), F.col("value").asc()]
    w = Window.partitionBy("position").orderBy(*order)
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def column_stats(df: DataFrame, exact: bool = True, freq: DataFrame | None = None, quartiles: bool = True) -> DataFrame:
    """B3-B9 per column: counts, percentages, base statistics, semantic type.

    ``quartiles=False`` skips the percentile pass (type detection alone).
    """
    stats = scalar_stats(df)
    if exact:
        if freq is None:
            # Read by the distinct counts and by the quartiles: written once to
            # the shared checkpoint folder instead of being computed twice.
            freq = heavy.value_counts(df)
            freq = cut_lineage(freq) if quartiles else freq
        uniq = distinct_counts(freq)
    else:
        cols = columns_of(df)
        scal = [c for c in cols if c.kind != "nested"]
        row = normalized(df).agg(
            *[F.approx_count_distinct(_value_text(c), 0.01).alias(f"u{c.position}") for c in scal]
        )
        uniq = row.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(c.position).alias("position"), F.col(f"u{c.position}").cast("long").alias("unique_count"))
                        for c in scal
                    ]
                )
            )
        )
    quart = percentiles(df, QUARTILE_PROBS, exact=exact if quartiles else False, columns=None if quartiles else [], freq=freq)
    qwide = quart.groupBy("position").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q25"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q75"),
    )
    # Both sides are one row per column: small joins.
    out = stats.join(F.broadcast(uniq), "position", "left").join(F.broadcast(qwide), "position", "left")
    n = F.col("count")
    out = out.withColumn("unique_count", F.coalesce(F.col("unique_count"), F.lit(0)).cast("long"))
    out = out.withColumn("null_percentage", F.when(n > 0, F.col("null_count") * 100.0 / n).otherwise(F.lit(0.0)))
    out = out.withColumn("unique_percentage", F.when(n > 0, F.col("unique_count") * 100.0 / n).otherwise(F.lit(0.0)))
    out = out.withColumn(
        "true_percentage",
        F.when(F.col("kind") == "boolean", F.when(F.col("non_null") > 0, F.col("true_count") * 100.0 / F.col("non_null")).otherwise(F.lit(0.0))),
    )
    out = out.withColumn("detected_type", detected_type_expr())
    return out.orderBy("position")


# --------------------------------------------------------------- percentiles

def percentiles(
    df: DataFrame,
    probs: list[float] = DISTRIBUTION_PROBS,
    exact: bool = True,
    columns: list[str] | None = None,
    accuracy: int = 100000,
    freq: DataFrame | None = None,
) -> DataFrame:
    """(position, column, p, value) with linear interpolation between ranks.

    Exact mode selects the two neighbouring order statistics of each target by
    counting passes over the values, or over ``freq``, a written table of value
    counts (position, num, n); see ``radix``.
    """
    cols = [c for c in columns_of(df) if c.kind == "numeric" and (columns is None or c.name in columns)]
    spark = df.sparkSession
    schema = "position int, column string, p double, value double"
    if not cols:
        return spark.createDataFrame([], schema)
    names = F.create_map(*[x for c in cols for x in (F.lit(c.position), F.lit(c.name))])
    if not exact:
        row = normalized(df).agg(
            *[F.percentile_approx(_num(c), F.array(*[F.lit(p) for p in probs]), accuracy).alias(f"q{c.position}") for c in cols]
        )
        entries = [
            F.struct(F.lit(c.position).alias("position"), F.lit(p).alias("p"), F.col(f"q{c.position}")[i].alias("value"))
            for c in cols
            for i, p in enumerate(probs)
        ]
        out = row.select(F.inline(F.array(*entries)))
        return out.select("position", names[F.col("position")].alias("column"), "p", "value")

    wanted = [c.position for c in cols]
    if freq is not None:
        counted = freq.filter(F.col("num").isNotNull() & F.col("position").isin(wanted)).select("position", "num", "n")
        found = radix.quantiles(counted, radix.read_long, probs)
    else:
        found = radix.quantiles(normalized(df).select(*[_num(c).alias(f"c{c.position}") for c in cols]), radix.read_wide(wanted), probs)
    rows = [(c.position, c.name, p, v) for c in cols if c.position in found for p, v in zip(probs, found[c.position])]
    return spark.createDataFrame(rows, schema)  # one row per column and probability


# ------------------------------------------------------------------ sections

def overview(df: DataFrame) -> DataFrame:
    """B1 + B2: rows, columns, duplicate rows, complete rows, missing cells, size.

    Rows are counted by a 128-bit digest of all their columns (nulls compare
    equal), so no whole row is shuffled; null cells and sizes are summed with
    them in the map tasks. A row repeated a billion times collapses before the
    shuffle.
    """
    norm = normalized(df)
    cols = columns_of(df)
    if not cols:
        return df.sparkSession.createDataFrame([(0, 0, 0.0, 0, 0, 0)], OVERVIEW_SCHEMA)
    nulls = [F.when(c.ref.isNull(), 1).otherwise(0) for c in cols]
    n_null = sum(nulls[1:], nulls[0])
    size = [_size_bytes(c) for c in cols]
    n_bytes = sum(size[1:], size[0])
    # A null does not change xxhash64, so each column's null flag goes in too.
    cells = [x for c in cols for x in (c.ref.isNull(), F.array_sort(F.map_entries(c.ref)) if c.data_type.startswith("map<") else c.ref)]
    digest = [F.xxhash64(F.lit(s), *cells).alias(f"_h{s}") for s in (1, 2)]
    slim = norm.select(*digest, n_null.alias("_nulls"), n_bytes.alias("_bytes"))
    grouped = slim.groupBy("_h1", "_h2").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_nulls") == 0, 1).otherwise(0)).alias("_whole"), F.sum("_nulls").alias("_nulls"), F.sum("_bytes").alias("_bytes")
    )
    out = grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count(F.lit(1)).cast("long").alias("_distinct"),
        F.coalesce(F.sum("_whole"), F.lit(0)).cast("long").alias("complete_rows"),
        F.coalesce(F.sum("_nulls"), F.lit(0)).cast("long").alias("total_missing"),
        F.coalesce(F.sum("_bytes"), F.lit(0)).cast("double").alias("_size"),
    )
    return out.select(
        "n_rows",
        F.lit(len(cols)).cast("long").alias("n_columns"),
        (F.col("_size") / (1024.0 * 1024.0)).alias("approx_size_mb"),
        (F.col("n_rows") - F.col("_distinct")).cast("long").alias("duplicate_rows"),
        "complete_rows",
        "total_missing",
    )


OVERVIEW_SCHEMA = (
    "n_rows long, n_columns long, approx_size_mb double, duplicate_rows long, complete_rows long, total_missing long"
)


def _size_bytes(c: Col) -> Column:
    """Own size estimate: text bytes for strings, fixed width otherwise."""
    widths = {"boolean": 1, "datetime": 8}
    if c.kind == "string":
        return F.coalesce(F.octet_length(c.ref), F.lit(0)).cast("long")
    if c.kind == "numeric":
        w = 4 if c.data_type in ("int", "float") else 2 if c.data_type == "smallint" else 1 if c.data_type == "tinyint" else 8
        return F.lit(w).cast("long")
    if c.kind == "nested":
        return F.coalesce(F.octet_length(F.to_json(c.ref)), F.lit(0)).cast("long")
    return F.lit(widths.get(c.kind, 8)).cast("long")


def most_common(df: DataFrame, k: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """Top-k values of every string column with their counts.

    ``counts`` may be a written ``heavy.value_counts`` table with ``prefix``.
    """
    strings = [c for c in columns_of(df) if c.kind == "string"]
    names = F.create_map(*[x for c in strings for x in (F.lit(c.position), F.lit(c.name))]) if strings else F.create_map().cast("map<int,string>")
    top = heavy.top_texts(df, strings, k, counts)
    return top.select(names[F.col("position")].alias("column"), "position", "rank", "value", F.col("n").cast("long").alias("count"))


def sample_values(df: DataFrame, k: int = 5, freq: DataFrame | None = None) -> DataFrame:
    """The k smallest non-null values of each column (with repeats)."""
    freq = freq if freq is not None else frequency_table(df)
    w = Window.partitionBy("position").orderBy(F.col("num").asc_nulls_last(), F.col("value").asc())
    first = freq.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    rep = first.select("position", "column", "num", "value", "_r", F.explode(F.array_repeat(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))).alias("_one"))
    w2 = Window.partitionBy("position").orderBy("_r")
    out = rep.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)
    return out.select("column", "position", "rank", "value")


def distribution(stats: DataFrame, pcts: DataFrame) -> DataFrame:
    """B11-B13 for continuous columns: shape label, moments, percentiles."""
    cont = stats.filter(F.col("detected_type") == "continuous")
    g1, g2 = F.col("skewness"), F.col("kurtosis")
    label = (
        F.when(F.col("non_null") == 0, "unknown")
        .when((F.abs(g1) < 0.5) & (F.abs(g2) < 1), "normal")
        .when(g1 > 1, "right_skewed")
        .when(g1 < -1, "left_skewed")
        .when((F.col("min") >= 0) & (g1 > 0.5), "exponential")
        .otherwise("other")
    )
    wide = pcts.groupBy("position").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{int(round(p * 100)):02d}") for p in DISTRIBUTION_PROBS]
    )
    out = cont.select(
        "column", "position", label.alias("distribution"), "skewness", "kurtosis", "is_integer", "has_negative"
    ).join(F.broadcast(wide), "position", "left")
    return out


def local(stats: DataFrame) -> DataFrame:
    """A table of one row per column, computed once."""
    return stats.sparkSession.createDataFrame(stats.collect(), stats.schema)


def categories(df: DataFrame, stats: DataFrame, counts: DataFrame, k: int = 20) -> DataFrame:
    """B14-B15 for categorical columns: top-k counts, frequency of all rows.

    ``counts`` is the written ``heavy.value_counts`` table; rare values and the
    ranks of numbers come from it, texts from a heavy-hitter summary.
    """
    cat = local(
        stats.filter(F.col("detected_type") == "categorical").select("position", F.col("column"), F.col("count").alias("_rows"), F.col("unique_count").alias("n_categories"))
    )
    chosen = [r.position for r in cat.select("position").collect()]
    cols = [c for c in columns_of(df) if c.position in chosen]
    f = counts.filter(F.col("position").isin(chosen)).drop("column").join(F.broadcast(cat), "position")
    rare = f.groupBy("position").agg(F.count_if(F.col("n") < F.col("_rows") * 0.01).cast("long").alias("rare_categories"))
    texts = heavy.top_texts(df, [c for c in cols if c.kind == "string"], k)
    others = counts.filter(F.col("position").isin([c.position for c in cols if c.kind != "string"]))
    numbers = top_values(others.withColumn("value", _count_key_text(cols)), k)
    both = texts.unionByName(numbers.select("position", "value", "n", "rank"))
    return both.join(F.broadcast(cat), "position").join(F.broadcast(rare), "position").select(
        "position", "column", "rank", "value", F.col("n").cast("long").alias("count"), (F.col("n") / F.col("_rows")).alias("frequency"), "n_categories", "rare_categories"
    )


def _count_key_text(cols: list[Col]) -> Column:
    """The text of a ``value_counts`` key that is no digest."""
    out = F.coalesce(F.when(F.col("num") == F.col("a"), F.col("a").cast("string")), F.col("num").cast("string"))
    for c in cols:
        if c.kind == "boolean":
            out = F.when(F.col("position") == c.position, F.col("a").cast("boolean").cast("string")).otherwise(out)
        if c.kind == "datetime":
            out = F.when(F.col("position") == c.position, micros_to_ntz(F.col("a")).cast("string")).otherwise(out)
    return out


def text_profile(stats: DataFrame) -> DataFrame:
    """B16 for text and free-text columns."""
    return stats.filter(F.col("detected_type").isin("text", "free_text") & (F.col("kind") == "string") & (F.col("non_null") > 0)).select(
        "column", "position", "avg_length", "min_length", "max_length", "avg_words",
        F.col("digit_rate").alias("contains_digits"), F.col("special_rate").alias("contains_special"),
    )


def temporal_profile(stats: DataFrame) -> DataFrame:
    """B17 for datetime columns: range, whole days, has a time of day."""
    t = stats.filter((F.col("detected_type") == "datetime") & F.col("min_time").isNotNull())
    micros = F.timestamp_diff("MICROSECOND", F.col("min_time"), F.col("max_time"))
    return t.select(
        "column", "position", F.col("min_time").alias("min_date"), F.col("max_time").alias("max_date"),
        F.floor(micros / F.lit(86400 * 1000000)).cast("long").alias("date_range_days"), "has_time",
    )


def numeric_columns(df: DataFrame) -> list[Col]:
    """Columns taking part in correlations: numbers, not booleans."""
    return [c for c in columns_of(df) if c.kind == "numeric"]


def _gram(d: int):
    """Arrow function: pair sums of centred columns c0..c{d-1}, one row per pair and task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, a, ab, aa = (np.zeros((d, d)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)]) if batch.num_rows else np.zeros((0, d))
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            n += m.T @ m
            a += x.T @ m  # sum of the first column where both are present
            ab += x.T @ x
            aa += (x * x).T @ m
        i, j = (v.ravel() for v in np.indices((d, d)))
        cells = [i.astype("int32"), j.astype("int32"), n.ravel(), a.ravel(), a.T.ravel(), ab.ravel(), aa.ravel(), aa.T.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["i", "j", "n", "a", "b", "ab", "aa", "bb"])

    return run


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson on pairwise-complete rows, all pairs in one scan.

    Pass one gives each column's mean (k numbers to the driver). Pass two reads
    the centred columns once; every task keeps the k x k sums its rows add up
    to (null masks count the rows that are complete for a pair) and returns one
    row per pair, which one aggregation adds up. Both passes are one scan each
    at any number of columns. Output (column1, column2, correlation) for every
    ordered pair including the diagonal; a constant column gives null, never a
    division error.
    """
    num = [c for c in numeric_columns(df) if cols is None or c.name in cols]
    if cols is not None:
        num.sort(key=lambda c: cols.index(c.name))
    spark = df.sparkSession
    if len(num) < 2:
        return spark.createDataFrame([], "column1 string, column2 string, correlation double")
    norm = normalized(df)
    means = norm.agg(*[F.avg(_num(c)).alias(f"m{i}") for i, c in enumerate(num)]).first()
    centred = norm.select(*[(_num(c) - F.lit(means[i] or 0.0)).alias(f"c{i}") for i, c in enumerate(num)])
    sums = ["n", "a", "b", "ab", "aa", "bb"]
    partial = centred.mapInArrow(_gram(len(num)), "i int, j int, " + ", ".join(f"{x} double" for x in sums))
    t = partial.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in sums])
    n = F.when(F.col("n") > 0, F.col("n"))
    cov = F.col("ab") - F.col("a") * F.col("b") / n
    # A constant column leaves a variance of rounding errors: nothing.
    spread = lambda x, xx: F.when(F.col(xx) - F.col(x) * F.col(x) / n > 1e-10 * F.col(xx), F.col(xx) - F.col(x) * F.col(x) / n)
    vi, vj = spread("a", "aa"), spread("b", "bb")
    names = F.array(*[F.lit(c.name) for c in num])
    name = lambda k: F.element_at(names, F.col(k) + 1)
    return t.select(name("i").alias("column1"), name("j").alias("column2"), _guarded(cov, vi, vj).alias("correlation"))


def _guarded(cov: Column, vi: Column, vj: Column) -> Column:
    """cov / sqrt(vi * vj), null when a variance is zero (no ANSI error);
    clamped to [-1, 1] against rounding."""
    r = cov / F.sqrt(vi * vj)
    # greatest/least skip nulls, so the clamp must not see an undefined r.
    return F.when((vi > 0) & (vj > 0), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))


def high_correlations(matrix: DataFrame, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Upper-triangle pairs with |r| > threshold, rounded half-even to 3."""
    order = {c.name: c.position for c in numeric_columns(df)}
    pos = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    upper = matrix.filter(pos[F.col("column1")] < pos[F.col("column2")])
    out = upper.filter(F.abs("correlation") > threshold).select(
        "column1", "column2", F.bround("correlation", 3).alias("correlation")
    )
    return out.orderBy(F.abs("correlation").desc(), pos[F.col("column1")], pos[F.col("column2")])


def recommendations(stats: DataFrame) -> DataFrame:
    """Warnings for many nulls, notes for id / email / free-text columns."""
    warn = stats.filter(F.col("null_percentage") > 20).select(
        "column", "position", F.lit(0).alias("_o"), F.lit("warning").alias("type"),
        F.format_string("High null percentage (%s%%). Consider handling missing values.", fixed(F.col("null_percentage"), 1)).alias("message"),
    )
    # The informational messages per type.
    msgs = {
        "id": "Detected as ID column. Will generate unique sequential or UUID values.",
        "email": "Detected as email. Will generate realistic fake email addresses.",
        "free_text": "Detected as free text. Will use text generation to create similar content.",
    }
    m = F.create_map(*[x for k, v in msgs.items() for x in (F.lit(k), F.lit(v))])
    info = stats.filter(F.col("detected_type").isin(*msgs)).select(
        "column", "position", F.lit(1).alias("_o"), F.lit("info").alias("type"), m[F.col("detected_type")].alias("message")
    )
    return warn.unionByName(info)


def column_config(stats: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """B21 + B22: (column, detected_type, generation_method, preserve_statistics, include).

    ``overrides`` may carry any of detected_type, generation_method, include
    for some columns; it is left-joined and wins where not null.
    """
    mp = F.create_map(*[x for k, v in METHOD_BY_TYPE.items() for x in (F.lit(k), F.lit(v))])
    cfg = stats.select(
        "column", "position", "detected_type",
        F.coalesce(mp[F.col("detected_type")], F.lit(DEFAULT_METHOD)).alias("generation_method"),
        F.lit(True).alias("preserve_statistics"), F.lit(True).alias("include"),
    )
    if overrides is None:
        return cfg
    o = overrides.select(*[F.col(c).alias(f"o_{c}") if c != "column" else F.col(c) for c in overrides.columns])
    out = cfg.join(o, "column", "left")
    for c in ("detected_type", "generation_method", "include"):
        if f"o_{c}" in o.columns:
            out = out.withColumn(c, F.coalesce(F.col(f"o_{c}"), F.col(c)))
    return out.select("column", "position", "detected_type", "generation_method", "preserve_statistics", "include")


def summary(stats: DataFrame) -> DataFrame:
    """The summary table with text-formatted percentages and moments."""
    numeric = F.col("mean").isNotNull()
    return stats.select(
        F.col("column").alias("Column"),
        F.col("detected_type").alias("Type"),
        F.col("non_null").alias("Non_Null"),
        F.concat(fixed(F.col("null_percentage"), 1), F.lit("%")).alias("Null_Pct"),
        F.col("unique_count").alias("Unique"),
        F.when(numeric, fixed(F.col("mean"), 2)).alias("Mean"),
        F.when(numeric, fixed(F.col("std"), 2)).alias("Std"),
        "position",
    )


def column_digest(df: DataFrame, k: int = 10, freq: DataFrame | None = None) -> DataFrame:
    """Name, type, up to k sample values, null count, total."""
    stats = scalar_stats(df)
    samples = sample_values(df, k, freq).groupBy("position").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("_s")
    )
    out = stats.join(F.broadcast(samples), "position", "left")
    return out.select(
        "column", "position", F.col("data_type").alias("dtype"),
        F.coalesce(F.transform("_s", lambda s: s["value"]), F.array().cast("array<string>")).alias("sample_values"),
        "null_count", F.col("count").alias("total_count"),
    )


@dataclass
class Profile:
    overview: DataFrame
    columns: DataFrame
    percentiles: DataFrame
    distribution: DataFrame
    categories: DataFrame
    most_common: DataFrame
    text: DataFrame
    temporal: DataFrame
    sample_values: DataFrame
    correlations: DataFrame
    high_correlations: DataFrame
    recommendations: DataFrame
    config: DataFrame


def profile(df: DataFrame, exact: bool = True, persist: bool = True) -> Profile:
    """Every section. The table of value counts is shared (written once)."""
    counts = heavy.value_counts(df)
    if persist:
        counts = cut_lineage(counts)
    stats = local(column_stats(df, exact=exact, freq=counts))
    pcts = percentiles(df, DISTRIBUTION_PROBS, exact=exact, freq=counts if exact else None)
    corr = correlation_matrix(df)
    return Profile(
        overview=overview(df),
        columns=stats,
        percentiles=pcts,
        distribution=distribution(stats, pcts),
        categories=categories(df, stats, counts),
        most_common=most_common(df),
        text=text_profile(stats),
        temporal=temporal_profile(stats),
        sample_values=sample_values(df),
        correlations=corr,
        high_correlations=high_correlations(corr, df),
        recommendations=recommendations(stats),
        config=column_config(stats),
    )
