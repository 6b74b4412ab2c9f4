"""Registered profile queries (B1-B25) over whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.operators import profile as P
from facsimile.operators import state as ST
from facsimile.operators.heavy import value_counts
from facsimile.plans.common import r_sql, rounded
from facsimile.plans.oracle_profile import _lit, column_stats_sql
from facsimile.plans.registry import add
from facsimile.plans.tables import TABLE_COLUMNS, table
from facsimile.session import cut_lineage

STATS_COLS = [
    "column", "position", "count", "non_null", "null_count", "null_percentage", "unique_count",
    "unique_percentage", "mean", "std", "min", "max", "q25", "median", "q75",
    "avg_length", "min_length", "max_length", "avg_words", "detected_type",
]


def _columns_query(name: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(P.column_stats(table(spark, sf_dir, name)).select(*STATS_COLS))

    return q


for _t in ["lineitem", "orders", "customer", "part", "events", "documents", "labels", "conversations", "supplier", "pages"]:
    add(f"profile_columns_{_t}", _columns_query(_t), column_stats_sql(_t))


# ---- B1/B2 overview ---------------------------------------------------------

def _size_sql(name: str, kind: str, table_name: str) -> str:
    if kind == "string":
        return f"coalesce(strlen({name}), 0)"
    return "4" if (table_name, name) in _INT32 else "8"


_INT32 = {("lineitem", "l_linenumber"), ("customer", "c_nationkey"), ("part", "p_size"), ("labels", "quality"), ("labels", "toxic"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("region", "r_regionkey")}


def overview_sql(t: str) -> str:
    cols = TABLE_COLUMNS[t]
    names = ", ".join(c for c, _ in cols)
    nulls = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c, _ in cols)
    size = " + ".join(_size_sql(c, k, t) for c, k in cols)
    return f"""SELECT count(*) AS n_rows, CAST({len(cols)} AS BIGINT) AS n_columns,
  {r_sql(f"sum({size}) / (1024.0 * 1024.0)")} AS approx_size_mb,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {t})) AS duplicate_rows,
  CAST(sum(CASE WHEN ({nulls}) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS complete_rows,
  CAST(coalesce(sum({nulls}), 0) AS BIGINT) AS total_missing
FROM {t}"""


def _overview_query(name: str):
    return lambda spark, sf_dir: rounded(P.overview(table(spark, sf_dir, name)))


for _t in ["lineitem", "orders", "documents", "customer", "events", "labels", "conversations"]:
    add(f"profile_overview_{_t}", _overview_query(_t), overview_sql(_t))


# ---- B4 boolean statistics -------------------------------------------------

def _label_flags(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", (F.col("quality") == 1).alias("is_quality"), (F.col("toxic") == 1).alias("is_toxic"))


def q_bool_stats(spark, sf_dir):
    st = P.column_stats(_label_flags(spark, sf_dir)).filter(F.col("kind") == "boolean")
    return rounded(st.select("column", "true_count", "false_count", "true_percentage", "detected_type"))


add(
    "profile_boolean_labels",
    q_bool_stats,
    f"""SELECT 'is_quality' AS "column", count_if(quality = 1) AS true_count, count_if(quality <> 1) AS false_count,
  {r_sql("count_if(quality = 1) * 100.0 / count(quality)")} AS true_percentage, 'boolean' AS detected_type FROM labels
UNION ALL
SELECT 'is_toxic', count_if(toxic = 1), count_if(toxic <> 1), {r_sql("count_if(toxic = 1) * 100.0 / count(toxic)")}, 'boolean' FROM labels""",
)


# ---- B7 most common ----------------------------------------------------------

def _top_sql(t: str, k: int, kinds=("string",), order_num=False) -> str:
    parts = []
    for pos, (c, kind) in enumerate(TABLE_COLUMNS[t]):
        if kind not in kinds:
            continue
        parts.append(
            f"""SELECT {_lit(c)} AS "column", CAST({pos} AS INTEGER) AS position, value, n FROM
  (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)"""
        )
    inner = "\nUNION ALL\n".join(parts)
    return f"""SELECT "column", position, CAST(rank AS INTEGER) AS rank, value, n AS count FROM (
  SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, value) AS rank FROM ({inner})
) WHERE rank <= {k}"""


def _most_common_query(name: str):
    return lambda spark, sf_dir: P.most_common(table(spark, sf_dir, name), 5)


for _t in ["customer", "orders", "documents", "events", "pages", "conversations"]:
    add(f"profile_most_common_{_t}", _most_common_query(_t), _top_sql(_t, 5))


# ---- B10 sample values -------------------------------------------------------

def sample_values_sql(t: str, k: int = 5) -> str:
    parts = []
    for pos, (c, kind) in enumerate(TABLE_COLUMNS[t]):
        if kind == "nested":
            continue
        num = f"CAST({c} AS DOUBLE)" if kind == "numeric" else "NULL::DOUBLE"
        val = f"CAST({c} AS VARCHAR)"
        parts.append(
            f"""SELECT {_lit(c)} AS "column", CAST({pos} AS INTEGER) AS position, {val} AS value, {num} AS num FROM {t} WHERE {c} IS NOT NULL"""
        )
    inner = "\nUNION ALL\n".join(parts)
    return f"""SELECT "column", position, CAST(rank AS INTEGER) AS rank, value FROM (
  SELECT *, row_number() OVER (PARTITION BY position ORDER BY num NULLS LAST, value) AS rank FROM ({inner})
) WHERE rank <= {k}"""


for _t in ["orders", "part", "lineitem"]:
    add(f"profile_sample_values_{_t}", (lambda t: lambda spark, sf_dir: P.sample_values(table(spark, sf_dir, t), 5))(_t), sample_values_sql(_t))


# ---- B12 percentiles, B11/B13 distribution --------------------------------

PROBS = P.DISTRIBUTION_PROBS


def percentiles_sql(t: str) -> str:
    parts = []
    for pos, (c, kind) in enumerate(TABLE_COLUMNS[t]):
        if kind != "numeric":
            continue
        for p in PROBS:
            parts.append(
                f"SELECT CAST({pos} AS INTEGER) AS position, {_lit(c)} AS \"column\", {p} AS p, {r_sql(f'quantile_cont(CAST({c} AS DOUBLE), {p})')} AS value FROM {t}"
            )
    return "\nUNION ALL\n".join(parts)


def _pct_query(name: str):
    return lambda spark, sf_dir: rounded(P.percentiles(table(spark, sf_dir, name)))


for _t in ["lineitem", "orders", "customer", "events"]:
    add(f"profile_percentiles_{_t}", _pct_query(_t), percentiles_sql(_t))


def distribution_sql(t: str) -> str:
    """B11-B13 over columns the SQL type rule calls continuous."""
    stats = column_stats_sql(t)
    parts = []
    for pos, (c, kind) in enumerate(TABLE_COLUMNS[t]):
        if kind != "numeric":
            continue
        x = f"CAST({c} AS DOUBLE)"
        pcts = ", ".join(f"{r_sql(f'quantile_cont({x}, {p})')} AS p{int(round(p * 100)):02d}" for p in PROBS)
        parts.append(
            f"""SELECT CAST({pos} AS INTEGER) AS position, count({x}) AS n, skewness({x}) AS g1, kurtosis({x}) AS g2, min({x}) AS mn,
  bool_and({x} = floor({x})) AS is_integer, bool_or({x} < 0) AS has_negative, {pcts} FROM {t}"""
        )
    inner = "\nUNION ALL\n".join(parts)
    label = """CASE WHEN n = 0 THEN 'unknown'
  WHEN abs(g1) < 0.5 AND abs(g2) < 1 THEN 'normal'
  WHEN g1 > 1 THEN 'right_skewed'
  WHEN g1 < -1 THEN 'left_skewed'
  WHEN mn >= 0 AND g1 > 0.5 THEN 'exponential'
  ELSE 'other' END"""
    pcols = ", ".join(f"d.p{int(round(p * 100)):02d}" for p in PROBS)
    return f"""SELECT s."column", d.position, {label} AS distribution, {r_sql("g1")} AS skewness, {r_sql("g2")} AS kurtosis,
  d.is_integer, d.has_negative, {pcols}
FROM ({inner}) d JOIN ({stats}) s ON s.position = d.position
WHERE s.detected_type = 'continuous'"""


def _dist_query(name: str):
    def q(spark, sf_dir):
        df = table(spark, sf_dir, name)
        return rounded(P.distribution(P.column_stats(df), P.percentiles(df)))

    return q


for _t in ["lineitem", "orders", "customer"]:
    add(f"profile_distribution_{_t}", _dist_query(_t), distribution_sql(_t))


# ---- B14/B15 categories ------------------------------------------------------

def categories_sql(t: str, k: int = 20) -> str:
    stats = column_stats_sql(t)
    parts = []
    for pos, (c, kind) in enumerate(TABLE_COLUMNS[t]):
        if kind == "nested":
            continue
        val = f"CAST({c} AS VARCHAR)"
        num = f"CAST({c} AS DOUBLE)" if kind == "numeric" else "NULL::DOUBLE"
        parts.append(
            f"""SELECT CAST({pos} AS INTEGER) AS position, {val} AS value, {num} AS num, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 2, 3"""
        )
    freq = "\nUNION ALL\n".join(parts)
    return f"""WITH s AS ({stats}), f AS ({freq}),
cat AS (SELECT f.*, s."column", s.count AS rows_all, s.unique_count AS n_categories FROM f JOIN s ON s.position = f.position WHERE s.detected_type = 'categorical'),
rare AS (SELECT position, count_if(n < rows_all * 0.01) AS rare_categories FROM cat GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY n DESC, num NULLS LAST, value) AS rank FROM cat)
SELECT r.position, r."column", CAST(r.rank AS INTEGER) AS rank, r.value, r.n AS count, {r_sql("r.n / r.rows_all")} AS frequency,
  r.n_categories, rare.rare_categories
FROM ranked r JOIN rare ON rare.position = r.position WHERE r.rank <= {k}"""


def _cat_query(name: str):
    def q(spark, sf_dir):
        df = table(spark, sf_dir, name)
        counts = cut_lineage(value_counts(df))
        return rounded(P.categories(df, P.column_stats(df, freq=counts, quartiles=False), counts))

    return q


for _t in ["orders", "lineitem", "part", "documents"]:
    add(f"profile_categories_{_t}", _cat_query(_t), categories_sql(_t))


# ---- B16 text ------------------------------------------------------------------

def text_sql(t: str) -> str:
    stats = column_stats_sql(t)
    parts = []
    for pos, (c, kind) in enumerate(TABLE_COLUMNS[t]):
        if kind != "string":
            continue
        parts.append(
            f"""SELECT CAST({pos} AS INTEGER) AS position, avg(length({c})) AS avg_length, CAST(min(length({c})) AS BIGINT) AS min_length,
  CAST(max(length({c})) AS BIGINT) AS max_length, avg(len(regexp_extract_all({c}, '\\S+'))) AS avg_words,
  avg(CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, '\\d') THEN 1 ELSE 0 END) AS contains_digits,
  avg(CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, '[^a-zA-Z0-9\\s]') THEN 1 ELSE 0 END) AS contains_special,
  count({c}) AS nn FROM {t}"""
        )
    inner = "\nUNION ALL\n".join(parts)
    return f"""SELECT s."column", d.position, {r_sql("d.avg_length")} AS avg_length, d.min_length, d.max_length, {r_sql("d.avg_words")} AS avg_words,
  {r_sql("d.contains_digits")} AS contains_digits, {r_sql("d.contains_special")} AS contains_special
FROM ({inner}) d JOIN ({stats}) s ON s.position = d.position
WHERE s.detected_type IN ('text', 'free_text') AND d.nn > 0"""


def _text_query(name: str):
    return lambda spark, sf_dir: rounded(P.text_profile(P.column_stats(table(spark, sf_dir, name))))


for _t in ["documents", "conversations", "benchmark", "part"]:
    add(f"profile_text_{_t}", _text_query(_t), text_sql(_t))


# ---- B17 temporal --------------------------------------------------------------

def temporal_sql(t: str) -> str:
    parts = []
    for pos, (c, kind) in enumerate(TABLE_COLUMNS[t]):
        if kind != "datetime":
            continue
        parts.append(
            f"""SELECT {_lit(c)} AS "column", CAST({pos} AS INTEGER) AS position, min({c}) AS min_date, max({c}) AS max_date,
  CAST(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0) AS BIGINT) AS date_range_days,
  bool_or(hour({c}) <> 0 OR minute({c}) <> 0) AS has_time FROM {t}"""
        )
    return "\nUNION ALL\n".join(parts)


for _t in ["orders", "events", "lineitem"]:
    add(
        f"profile_temporal_{_t}",
        (lambda t: lambda spark, sf_dir: P.temporal_profile(P.column_stats(table(spark, sf_dir, t))))(_t),
        temporal_sql(_t),
    )


# ---- B18/B19 correlations ------------------------------------------------------

def _num_cols(t: str) -> list[str]:
    return [c for c, k in TABLE_COLUMNS[t] if k == "numeric"]


def corr_sql(t: str) -> str:
    cols = _num_cols(t)
    parts = []
    for a in cols:
        for b in cols:
            parts.append(
                f"SELECT {_lit(a)} AS column1, {_lit(b)} AS column2, {r_sql(f'CASE WHEN var_pop(x) * var_pop(y) > 0 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END')} AS correlation "
                f"FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            )
    return "\nUNION ALL\n".join(parts)


def high_corr_sql(t: str) -> str:
    cols = _num_cols(t)
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(
                f"SELECT {_lit(a)} AS column1, {_lit(b)} AS column2, CASE WHEN var_pop(x) * var_pop(y) > 0 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS r "
                f"FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            )
    inner = "\nUNION ALL\n".join(parts)
    return f"SELECT column1, column2, round_even(r, 3) AS correlation FROM ({inner}) WHERE abs(r) > 0.5"


def _corr_query(name: str):
    return lambda spark, sf_dir: rounded(P.correlation_matrix(table(spark, sf_dir, name)))


def _high_query(name: str):
    def q(spark, sf_dir):
        df = table(spark, sf_dir, name)
        return P.high_correlations(P.correlation_matrix(df), df)

    return q


for _t in ["lineitem", "orders", "customer", "part"]:
    add(f"profile_correlations_{_t}", _corr_query(_t), corr_sql(_t))
    add(f"profile_high_correlations_{_t}", _high_query(_t), high_corr_sql(_t))


# ---- B20 recommendations, B21/B22 configuration, B23 summary -------------------

# The messages and methods per type, as the twins expect them.
METHODS = {
    "continuous": "gaussian_copula", "categorical": "frequency_sampling", "text": "faker_text", "free_text": "markov_chain", "datetime": "datetime_range", "boolean": "bernoulli",
    "id": "uuid", "email": "faker_email", "phone": "faker_phone", "address": "faker_address", "name": "faker_name",
}
INFO = {
    "id": "Detected as ID column. Will generate unique sequential or UUID values.",
    "email": "Detected as email. Will generate realistic fake email addresses.",
    "free_text": "Detected as free text. Will use text generation to create similar content.",
}


def recommendations_sql(t: str) -> str:
    stats = column_stats_sql(t)
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INFO.items())
    return f"""WITH s AS ({stats})
SELECT "column", position, 'warning' AS type,
  'High null percentage (' || printf('%.1f', null_percentage) || '%). Consider handling missing values.' AS message
FROM s WHERE null_percentage > 20
UNION ALL
SELECT "column", position, 'info', CASE detected_type {cases} END FROM s WHERE detected_type IN ({", ".join(f"'{k}'" for k in INFO)})"""


for _t in ["documents", "events", "labels", "customer"]:
    add(
        f"profile_recommendations_{_t}",
        (lambda t: lambda spark, sf_dir: P.recommendations(P.column_stats(table(spark, sf_dir, t))).drop("_o"))(_t),
        recommendations_sql(_t),
    )


def config_sql(t: str) -> str:
    stats = column_stats_sql(t)
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METHODS.items())
    return f"""SELECT "column", position, detected_type, coalesce(CASE detected_type {cases} END, 'sample') AS generation_method,
  true AS preserve_statistics, true AS include FROM ({stats})"""


for _t in ["customer", "orders", "events", "documents", "lineitem"]:
    add(
        f"profile_config_{_t}",
        (lambda t: lambda spark, sf_dir: P.column_config(P.column_stats(table(spark, sf_dir, t))))(_t),
        config_sql(_t),
    )


def summary_sql(t: str) -> str:
    stats = column_stats_sql(t)
    return f"""SELECT "column" AS "Column", detected_type AS "Type", non_null AS "Non_Null",
  printf('%.1f', null_percentage) || '%' AS "Null_Pct", unique_count AS "Unique",
  CASE WHEN mean IS NOT NULL THEN printf('%.2f', mean) END AS "Mean",
  CASE WHEN mean IS NOT NULL THEN printf('%.2f', std) END AS "Std", position
FROM ({stats})"""


for _t in ["customer", "lineitem", "orders"]:
    add(f"profile_summary_{_t}", (lambda t: lambda spark, sf_dir: P.summary(P.column_stats(table(spark, sf_dir, t))))(_t), summary_sql(_t))


# ---- B25 column digest ---------------------------------------------------------

def digest_sql(t: str, k: int = 10) -> str:
    samples = sample_values_sql(t, k)
    parts = []
    for pos, (c, kind) in enumerate(TABLE_COLUMNS[t]):
        parts.append(f"SELECT CAST({pos} AS INTEGER) AS position, {_lit(c)} AS \"column\", count(*) - count({c}) AS null_count, count(*) AS total_count FROM {t}")
    inner = "\nUNION ALL\n".join(parts)
    return f"""SELECT d."column", d.position, coalesce(string_agg(s.value, ' | ' ORDER BY s.rank), '') AS sample_values, d.null_count, d.total_count
FROM ({inner}) d LEFT JOIN ({samples}) s ON s.position = d.position GROUP BY ALL"""


def _digest_query(name: str):
    def q(spark, sf_dir):
        d = P.column_digest(table(spark, sf_dir, name), 10)
        return d.select("column", "position", F.array_join("sample_values", " | ").alias("sample_values"), "null_count", "total_count")

    return q


for _t in ["part", "customer"]:
    add(f"profile_digest_{_t}", _digest_query(_t), digest_sql(_t))



# ---- B19 with hits: amounts derived from lineitem --------------------------------

AMOUNTS = {
    "l_extendedprice": "l_extendedprice", "net": "l_extendedprice * (1 - l_discount)", "tax_amount": "l_extendedprice * l_tax", "l_tax": "l_tax",
    "rest": "100 - l_quantity", "l_quantity": "l_quantity", "l_linenumber": "l_linenumber",
}


def q_high_amounts(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(c) for c, e in AMOUNTS.items()])
    return P.high_correlations(P.correlation_matrix(df), df)


def high_amounts_sql() -> str:
    names = list(AMOUNTS)
    parts = [f"SELECT {_lit(a)} AS column1, {_lit(b)} AS column2, corr({a}, {b}) AS r FROM t" for i, a in enumerate(names) for b in names[i + 1 :]]
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in AMOUNTS.items())
    return f"WITH t AS (SELECT {cols} FROM lineitem) SELECT column1, column2, round_even(r, 3) AS correlation FROM ({' UNION ALL '.join(parts)}) WHERE abs(r) > 0.5"


add("profile_high_correlations_amounts", q_high_amounts, high_amounts_sql())


# ---- B22 override -------------------------------------------------------------------

OVERRIDES = [("l_quantity", "categorical", "kde", None), ("l_shipdate", None, None, False), ("l_tax", None, "sample", True)]


def q_override(spark, sf_dir):
    stats = P.column_stats(table(spark, sf_dir, "lineitem"), quartiles=False)
    return P.column_config(stats, spark.createDataFrame(OVERRIDES, "column string, detected_type string, generation_method string, include boolean"))


def override_sql() -> str:
    rows = ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else _lit(v) for v in r) + ")" for r in OVERRIDES)
    return f"""SELECT c."column", c.position, coalesce(o.detected_type, c.detected_type) AS detected_type, coalesce(o.generation_method, c.generation_method) AS generation_method,
  c.preserve_statistics, coalesce(o.include, c.include) AS include
FROM ({config_sql("lineitem")}) c LEFT JOIN (VALUES {rows}) o("column", detected_type, generation_method, include) ON o."column" = c."column\""""


add("profile_config_override_lineitem", q_override, override_sql())


# ---- B24 the full profile, its sections as rows of text --------------------------------

def q_full(name: str):
    def q(spark, sf_dir):
        p = P.profile(table(spark, sf_dir, name))
        none = F.lit("")
        row = lambda section, column, item, value: [F.lit(section).alias("section"), column.alias("column"), item.cast("string").alias("item"), value.cast("string").alias("value")]
        c = F.col
        parts = [
            *[p.overview.select(*row("overview", none, F.lit(m), c(m))) for m in ("n_rows", "n_columns", "duplicate_rows", "complete_rows", "total_missing")],
            *[p.columns.select(*row("columns", c("column"), F.lit(m), c(m))) for m in ("non_null", "null_count", "unique_count", "detected_type")],
            p.percentiles.select(*row("percentiles", c("column"), F.format_string("%.2f", "p"), F.round(c("value")).cast("long"))),
            p.distribution.select(*row("distribution", c("column"), none, c("distribution"))),
            p.categories.select(*row("categories", c("column"), c("rank"), F.concat("value", F.lit(" x "), c("count")))),
            p.most_common.select(*row("most_common", c("column"), c("rank"), F.concat("value", F.lit(" x "), c("count")))),
            *[p.text.select(*row("text", c("column"), F.lit(m), c(m))) for m in ("min_length", "max_length")],
            p.temporal.select(*row("temporal", c("column"), none, c("date_range_days"))),
            p.sample_values.select(*row("sample_values", c("column"), c("rank"), c("value"))),
            p.high_correlations.select(*row("high_correlations", c("column1"), c("column2"), c("correlation"))),
            p.recommendations.select(*row("recommendations", c("column"), c("type"), c("message"))),
            p.config.select(*row("config", c("column"), none, c("generation_method"))),
        ]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    return q


def full_sql(t: str) -> str:
    stats = column_stats_sql(t)
    text = lambda e: f"CAST({e} AS VARCHAR)"
    kinds = [k for _, k in TABLE_COLUMNS[t]]
    parts = [
        *[f"SELECT 'overview' AS section, '' AS \"column\", '{m}' AS item, {text(m)} AS value FROM ({overview_sql(t)})" for m in ("n_rows", "n_columns", "duplicate_rows", "complete_rows", "total_missing")],
        *[f"SELECT 'columns', \"column\", '{m}', {text(m)} FROM ({stats})" for m in ("non_null", "null_count", "unique_count", "detected_type")],
        f"SELECT 'percentiles', \"column\", printf('%.2f', p), {text('CAST(round(value) AS BIGINT)')} FROM ({percentiles_sql(t)})",
        f"SELECT 'distribution', \"column\", '', distribution FROM ({distribution_sql(t)})",
        f"SELECT 'categories', \"column\", {text('rank')}, value || ' x ' || count FROM ({categories_sql(t)})",
        f"SELECT 'most_common', \"column\", {text('rank')}, value || ' x ' || count FROM ({_top_sql(t, 5)})",
        f"SELECT 'sample_values', \"column\", {text('rank')}, value FROM ({sample_values_sql(t)})",
        f"SELECT 'high_correlations', column1, column2, {text('correlation')} FROM ({high_corr_sql(t)})",
        f"SELECT 'recommendations', \"column\", type, message FROM ({recommendations_sql(t)})",
        f"SELECT 'config', \"column\", '', generation_method FROM ({config_sql(t)})",
    ]
    if "string" in kinds:
        parts += [f"SELECT 'text', \"column\", '{m}', {text(m)} FROM ({text_sql(t)})" for m in ("min_length", "max_length")]
    if "datetime" in kinds:
        parts.append(f"SELECT 'temporal', \"column\", '', {text('date_range_days')} FROM ({temporal_sql(t)})")
    return "\nUNION ALL\n".join(parts)


for _t in ["orders", "documents", "part"]:
    add(f"profile_full_{_t}", q_full(_t), full_sql(_t))


# ---- B3 by parts: the merged states of the two line statuses ------------------------------

STATE_COLS = ["column", "position", "count", "non_null", "null_count", "unique_count", "mean", "std", "min", "max", "q25", "median", "q75", "avg_length", "min_length", "max_length", "avg_words"]


def q_merged_state(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    parts = [ST.state_of(df.filter(F.col("l_linestatus") == x)) for x in ("F", "O")]
    return rounded(ST.statistics(ST.merged(parts)).select(*STATE_COLS))


add("profile_state_merged_lineitem", q_merged_state, f"SELECT {', '.join(f'\"{c}\"' for c in STATE_COLS)} FROM ({column_stats_sql('lineitem')})")
