"""Per-column synthesis: fit small parameters, generate any number of rows.

Fit = one aggregate over the source (plus, for the sampling methods, a
ranked frequency table that stays a DataFrame). Generate = ``spark.range(n)``
with one column expression per generator, all randomness from the keyed
uniform ``u(seed, column, id, k)``: the output depends on the seed only,
never on partitioning or retries. Sampling methods (frequency sampling,
bootstrap, KDE) map ``floor(u * N)`` onto cumulative ``[start, end)``
intervals: one index and one join for all such columns (``sampling``). Generated
columns carry positional names until the last projection, so no name of the
source can meet a row key or a helper column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType,
    DataType,
    IntegerType,
    LongType,
    ShortType,
    TimestampType,
)

from facsimile.functions import pools
from facsimile.functions import rand as R
from facsimile.functions.text import capitalize, micros_to_ntz, ntz_micros, word_count
from facsimile.operators.profile import METHOD_BY_TYPE, column_config, column_stats, kind_of, normalized
from facsimile.operators.ranking import lookup_by_rank, running_totals
from facsimile.operators.sampling import Sampled, rank_index, sample, supported
from facsimile.session import cut_lineage

INTEGRAL = (ByteType, ShortType, IntegerType, LongType)
LOOKUP_METHODS = {"frequency_sampling", "sample", "kde"}
KNOWN_METHODS = set(METHOD_BY_TYPE.values()) | {"kde", "sequential_id", "sample"}
KDE_MIN_VALUES = 10
CLIP_MARGIN = 0.1
DEFAULT_WORDS = 3
# Days generated for a datetime column without any value: the year up to here.
EMPTY_RANGE_END = datetime(2025, 1, 1)
# Kinds a method can be fitted on; a column of another kind is sampled.
METHOD_KINDS = {
    "gaussian_copula": {"numeric"},
    "kde": {"numeric"},
    "datetime_range": {"datetime", "string"},
    "bernoulli": {"boolean", "numeric", "string"},
}


@dataclass
class ColumnPlan:
    name: str
    position: int
    method: str
    data_type: DataType
    kind: str
    params: dict = field(default_factory=dict)

    @property
    def ref(self) -> Column:
        return F.col(f"`{self.name}`")

    @property
    def out(self) -> str:
        """Name of the generated column until the last projection."""
        return f"c{self.position}"


@dataclass
class SynthModel:
    source: DataFrame
    columns: list[ColumnPlan]
    seed: int
    order: list[str]


def _config_rows(df: DataFrame, config) -> dict[str, dict]:
    if config is None:
        config = column_config(column_stats(df, quartiles=False))
    if isinstance(config, DataFrame):
        # One row per column: a bounded collect.
        return {r["column"]: r.asDict() for r in config.collect()}
    return dict(config)


def fit(df: DataFrame, config=None, seed: int = 42) -> SynthModel:
    """D16 fit: resolve methods, compute parameters in one aggregate.

    ``config`` maps column -> {include, generation_method, detected_type}
    (or is the column_config DataFrame). Without one, the table is profiled
    first so every column gets a method from its detected type.
    """
    cfg = _config_rows(df, config)
    src = normalized(df)
    plans: list[ColumnPlan] = []
    for i, f in enumerate(src.schema.fields):
        c = cfg.get(f.name, {})
        if not c.get("include", True):
            continue
        method = c.get("generation_method") or "auto"
        if method == "auto":
            method = METHOD_BY_TYPE.get(c.get("detected_type") or "text", "sample")
        kind = kind_of(f.dataType)
        if method not in KNOWN_METHODS or kind not in METHOD_KINDS.get(method, {kind}):
            method = "sample"
        plans.append(ColumnPlan(f.name, i, method, f.dataType, kind))
    _fit_params(src, plans)
    return SynthModel(src, plans, seed, [p.name for p in plans])


def _fit_params(src: DataFrame, plans: list[ColumnPlan]) -> None:
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for p in plans:
        c, k = p.ref, f"c{p.position}_"
        aggs.append(F.count(c).alias(k + "nn"))
        if p.kind == "numeric":
            x = c.cast("double")
            aggs += [
                F.avg(x).alias(k + "mean"), F.stddev_samp(x).alias(k + "std"), F.min(x).alias(k + "min"),
                F.max(x).alias(k + "max"), F.bool_and(x == F.floor(x)).alias(k + "int"),
            ]
        if p.method == "bernoulli":
            if p.kind == "string":
                t = F.lower(F.trim(c)).isin("true", "t", "yes", "y", "1")
            elif p.kind == "boolean":
                t = c
            else:
                t = c.cast("double") != 0
            aggs.append(F.avg(t.cast("double")).alias(k + "p"))
        if p.method in ("faker_text", "markov_chain") and p.kind == "string":
            aggs.append(F.avg(word_count(c)).alias(k + "words"))
        if p.method == "datetime_range":
            if p.kind == "string":
                us = ntz_micros(F.try_to_timestamp(c).cast("timestamp_ntz"))
            else:
                us = F.unix_micros(c) if isinstance(p.data_type, TimestampType) else ntz_micros(c)
            aggs += [F.min(us).alias(k + "tmin"), F.max(us).alias(k + "tmax")]
        if p.method == "sequential_id":
            aggs.append(F.min(c.cast("string")).alias(k + "first"))
    row = src.agg(*aggs).first().asDict()  # one row of parameters
    for p in plans:
        k = f"c{p.position}_"
        p.params = {"rows": row["_rows"], **{key[len(k):]: v for key, v in row.items() if key.startswith(k)}}
        if p.method == "datetime_range" and p.kind == "string" and p.params["tmin"] is None:
            p.method = "sample"  # not one text reads as a date


# ----------------------------------------------------------------- generators

def _gaussian(p: ColumnPlan, seed: int, idc: Column) -> Column:
    """Normal with clip, half-even rounding for integer data, null rate."""
    q = p.params
    if not q.get("nn"):
        return F.lit(None).cast(p.data_type)
    mean, std = q.get("mean"), q.get("std")
    if std is None or std == 0 or math.isnan(std):
        return F.lit(float(mean))
    x = F.lit(mean) + F.lit(std) * R.normal(seed, p.name, idc)
    margin = (q["max"] - q["min"]) * CLIP_MARGIN
    x = F.least(F.greatest(x, F.lit(q["min"] - margin)), F.lit(q["max"] + margin))
    if q.get("int"):
        x = F.bround(x, 0)
        if isinstance(p.data_type, INTEGRAL):
            x = x.cast("long")
    null_rate = 1.0 - q["nn"] / q["rows"]
    if null_rate > 0:
        x = F.when(R.uniform(seed, p.name, idc, "null") >= F.lit(null_rate), x)
    return x


def _faker_text(p: ColumnPlan, seed: int, idc: Column) -> Column:
    """One pool word, or a sentence of int(avg words) words."""
    avg = p.params.get("words")
    avg = DEFAULT_WORDS if avg is None else avg
    arr = F.array(*[F.lit(w) for w in pools.WORDS])
    size = len(pools.WORDS)

    def word(j: Column) -> Column:
        return F.element_at(arr, (F.floor(R.uniform(seed, p.name, idc, j) * size) + 1).cast("int"))

    if avg <= 2:
        return word(F.lit(1))
    k = int(avg)
    seq = F.sequence(F.lit(1), F.lit(k))
    return F.concat(capitalize(F.array_join(F.transform(seq, word), " ")), F.lit("."))


def _faker_email(p, seed, idc):
    """D5."""
    first = R.pick(pools.FIRST_NAMES, seed, p.name, idc, "first")
    last = R.pick(pools.LAST_NAMES, seed, p.name, idc, "last")
    num = R.uniform_index(seed, p.name, idc, 100, "num")
    dom = R.pick(pools.EMAIL_DOMAINS, seed, p.name, idc, "domain")
    return F.concat(F.lower(first), F.lit("."), F.lower(last), F.format_string("%02d", num), F.lit("@"), dom)


def _faker_phone(p, seed, idc):
    """(AAA) BBB-CCCC from one 10-digit draw."""
    n = R.uniform_index(seed, p.name, idc, 10**10, "phone")
    return F.format_string("(%03d) %03d-%04d", (n / 10**7).cast("long"), ((n / 10**4).cast("long") % 1000), n % 10000)


def _faker_name(p, seed, idc):
    """D7."""
    return F.concat(R.pick(pools.FIRST_NAMES, seed, p.name, idc, "first"), F.lit(" "), R.pick(pools.LAST_NAMES, seed, p.name, idc, "last"))


def _faker_address(p, seed, idc):
    """One line, comma separated."""
    num = R.uniform_index(seed, p.name, idc, 9999, "num") + 1
    zipc = R.uniform_index(seed, p.name, idc, 100000, "zip")
    return F.format_string(
        "%d %s %s, %s, %s %05d",
        num,
        R.pick(pools.STREET_NAMES, seed, p.name, idc, "street"),
        R.pick(pools.STREET_SUFFIXES, seed, p.name, idc, "suffix"),
        R.pick(pools.CITIES, seed, p.name, idc, "city"),
        R.pick(pools.STATES, seed, p.name, idc, "state"),
        zipc,
    )


def _datetime(p, seed, idc):
    """Uniform whole seconds between min and max; empty -> a fixed year.

    Text dates give text again, as ``yyyy-MM-dd HH:mm:ss``.
    """
    lo, hi = p.params.get("tmin"), p.params.get("tmax")
    if lo is None:
        hi = (EMPTY_RANGE_END - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        lo = hi - timedelta(days=365) // timedelta(microseconds=1)
    span = (hi - lo) // 1_000_000 + 1
    us = F.lit(lo) + R.uniform_index(seed, p.name, idc, span, "ts") * F.lit(1_000_000)
    if isinstance(p.data_type, TimestampType):
        return F.timestamp_micros(us)
    if p.kind == "string":
        return F.date_format(micros_to_ntz(us), "yyyy-MM-dd HH:mm:ss")
    return micros_to_ntz(us)


def _bernoulli(p, seed, idc):
    """True with the observed rate; 0.5 when nothing is observed."""
    rate = p.params.get("p")
    rate = 0.5 if rate is None else rate
    return R.uniform(seed, p.name, idc, "bern") < F.lit(rate)


def _uuid(p, seed, idc):
    """Version-4 layout from a keyed md5."""
    h = F.md5(F.concat(F.lit(f"{seed}:{p.name}:"), idc.cast("string"), F.lit(":uuid")))
    variant = F.substr(F.lit("89ab"), (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)),
        F.concat(F.lit("4"), F.substr(h, F.lit(14), F.lit(3))),
        F.concat(variant, F.substr(h, F.lit(18), F.lit(3))), F.substr(h, F.lit(21), F.lit(12)),
    )


SEQ_PATTERN = r"^([A-Za-z_]*)(\d+)"


def sequential_format(first: str | None) -> tuple[str, int]:
    """Prefix and zero-pad width from the first (smallest) value."""
    import re

    sample = first if first is not None else "ID_00001"
    m = re.match(SEQ_PATTERN, sample)
    if m:
        return m.group(1), len(m.group(2))
    return "ID_", 5


def _sequential(p, seed, idc):
    prefix, width = sequential_format(p.params.get("first"))
    return F.format_string(f"%s%0{width}d", F.lit(prefix), idc + 1)


EXPRESSIONS = {
    "gaussian_copula": _gaussian,
    "faker_text": _faker_text,
    "faker_email": _faker_email,
    "faker_phone": _faker_phone,
    "faker_name": _faker_name,
    "faker_address": _faker_address,
    "datetime_range": _datetime,
    "bernoulli": _bernoulli,
    "uuid": _uuid,
    "sequential_id": _sequential,
}


# ---------------------------------------------------------- sampling lookups

def value_intervals(src: DataFrame, col: str, include_nulls: bool = True) -> DataFrame:
    """Cumulative ``[rank_start, rank_end)`` per distinct value (nulls first)."""
    return value_intervals_counted(src, col, include_nulls)[0]


def value_intervals_counted(src: DataFrame, col: str, include_nulls: bool = True) -> tuple[DataFrame, int]:
    """The intervals, written once, and the number of distinct values.

    One path for any number of values: distributed running totals. Catalyst
    broadcasts the intervals to their readers if they turn out small.
    """
    freq = src.select(F.col(f"`{col}`").alias("_value"))
    if not include_nulls:
        freq = freq.filter(F.col("_value").isNotNull())
    freq = freq.groupBy("_value").agg(F.count(F.lit(1)).alias("_n"))
    out = cut_lineage(running_totals(freq, [F.col("_value").asc_nulls_first()], weight=F.col("_n")))
    return out, out.count()


def sample_by_rank(rows: DataFrame, intervals: DataFrame, pos_col: str, total: int, distinct: int, out: str) -> DataFrame:
    """Attach the value whose interval holds ``pos_col`` (total rows known)."""
    width = max(1, total // max(1, distinct))
    hit = lookup_by_rank(intervals.select("_value", "rank_start", "rank_end"), rows, pos_col, bucket_width=width)
    return hit.drop("rank_start", "rank_end", pos_col).withColumnRenamed("_value", out)


def _sampled(model: SynthModel, plans: list[ColumnPlan], rows: DataFrame) -> DataFrame:
    """(id, generated column) of all columns that sample the source: one index, one join."""
    chosen = [Sampled(p.position, p.name, p.data_type, nulls=p.method != "kde") for p in plans]
    index = rank_index(model.source, chosen)
    idc = F.col("id")
    ranks = {p.position: R.uniform_index(model.seed, p.name, idc, max(1, index.total(p.position)), "pos") for p in plans}
    out = sample(rows, index, ranks, lambda position: f"c{position}")
    for p in plans:
        if p.method == "kde":
            total, q = index.total(p.position), p.params
            bw = (q.get("std") or 0.0) * total ** (-1.0 / 5.0) if total else 0.0
            x = F.col(p.out).cast("double") + F.lit(bw) * R.normal(model.seed, p.name, idc, "kde")
            out = out.withColumn(p.out, F.least(F.greatest(x, F.lit(q["min"])), F.lit(q["max"])) if total else F.lit(None).cast("double"))
    return out


def _sampled_whole(model: SynthModel, p: ColumnPlan, base: DataFrame, idc: Column) -> DataFrame:
    """Add ``p.out`` by sampling whole values of a nested or binary column, grouped as they are."""
    total = p.params["rows"]
    if not total:  # nothing to draw from
        return base.withColumn(p.out, F.lit(None).cast(p.data_type))
    iv, k = value_intervals_counted(model.source, p.name)
    rows = base.withColumn("_pos", R.uniform_index(model.seed, p.name, idc, total, "pos"))
    return sample_by_rank(rows, iv, "_pos", total, k, p.out)


def _split(c: Column) -> Column:
    """``c`` by way of a lambda, which keeps its projection out of whole-stage code.

    There all draws of a row make one method, and the JVM only interprets
    methods of more than 8,000 bytes; outside each few expressions are a method.
    """
    return F.transform(F.array(c), lambda x: x).getItem(0)


def generate(model: SynthModel, n: int, seed: int | None = None) -> DataFrame:
    """D16 generate: n rows, source column order, one expression per column."""
    if seed is not None:
        model = SynthModel(model.source, model.columns, seed, model.order)
    spark = model.source.sparkSession
    idc = F.col("id")
    out = spark.range(n)
    exprs = {}
    lookups = []
    for p in model.columns:
        method = p.method
        if method == "kde" and (p.params.get("nn") or 0) < KDE_MIN_VALUES:
            method = "gaussian_copula"
        if method in EXPRESSIONS:
            exprs[p.out] = EXPRESSIONS[method](p, model.seed, idc if exprs else _split(idc))
        else:
            lookups.append(p)
    indexed = [p for p in lookups if p.method != "markov_chain" and supported(p.data_type)]
    if indexed:  # first of all: the other columns are expressions of the row id
        out = _sampled(model, indexed, out)
    if exprs:
        out = out.withColumns(exprs)
    for p in lookups:
        if p.method == "markov_chain":
            from facsimile.operators.markov import markov_column

            out = markov_column(model, p, out)
        elif p not in indexed:
            out = _sampled_whole(model, p, out, idc)
    return out.select(*[F.col(p.out).alias(p.name) for p in model.columns])


def synthesize(df: DataFrame, n: int | None = None, config=None, seed: int = 42) -> DataFrame:
    """Fit and generate; ``n`` defaults to the source row count."""
    model = fit(df, config, seed)
    rows = n if n is not None else model.columns[0].params["rows"] if model.columns else df.count()
    return generate(model, rows)


def metadata(stats: DataFrame) -> DataFrame:
    """Modelling kind per column from the detected types."""
    kind = (
        F.when(F.col("detected_type") == "continuous", "numerical")
        .when(F.col("detected_type") == "datetime", "datetime")
        .when(F.col("detected_type") == "boolean", "boolean")
        .when(F.col("detected_type") == "id", "id")
        .otherwise("categorical")
    )
    return stats.select("column", "position", "detected_type", kind.alias("sdtype"))

