"""Registered comparison queries (E1-E7) and their DuckDB twins.

Two pairings: ``lineitem`` split by ``l_linestatus`` (F against O), and
``orders`` against its synthetic twin (generated by the same fit/generate
as ``synth_table_orders``, recomputed in SQL from the same keyed uniforms).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.functions import rand as R
from facsimile.operators import compare as C
from facsimile.operators import synth as S
from facsimile.plans.common import r_sql, rounded
from facsimile.plans.oracle_profile import _lit
from facsimile.plans.registry import add
from facsimile.plans.synth_queries import AUTO_ORDERS, SEED, table_sql
from facsimile.plans.tables import TABLE_COLUMNS, table

LI = TABLE_COLUMNS["lineitem"]
LI_A = "(SELECT * FROM lineitem WHERE l_linestatus = 'F')"
LI_B = "(SELECT * FROM lineitem WHERE l_linestatus = 'O')"
ORD_SYN = f"({table_sql('orders', AUTO_ORDERS)})"


def _halves(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_linestatus") == "F"), li.filter(F.col("l_linestatus") == "O")


def _orders_pair(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    model = S.fit(o, seed=SEED)
    return o, S.generate(model, model.columns[0].params["rows"])


# ---- E1 -------------------------------------------------------------------------

def stats_sql(a: str, b: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(cols):
        if kind == "numeric":
            x = f"CAST({c} AS DOUBLE)"
            parts.append(
                f"SELECT {_lit(c)} AS \"column\", CAST({i} AS INTEGER) AS position, {r_sql(f'(SELECT avg({x}) FROM {a})')} AS orig_mean, {r_sql(f'(SELECT avg({x}) FROM {b})')} AS synth_mean, "
                f"{r_sql(f'(SELECT stddev_samp({x}) FROM {a})')} AS orig_std, {r_sql(f'(SELECT stddev_samp({x}) FROM {b})')} AS synth_std, NULL::BIGINT AS orig_unique, NULL::BIGINT AS synth_unique"
            )
        else:
            parts.append(
                f"SELECT {_lit(c)}, CAST({i} AS INTEGER), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, (SELECT count(DISTINCT {c}) FROM {a}), (SELECT count(DISTINCT {c}) FROM {b})"
            )
    return "\nUNION ALL\n".join(parts)


add("compare_stats_lineitem_halves", lambda spark, sf_dir: rounded(C.compare_stats(*_halves(spark, sf_dir))), stats_sql(LI_A, LI_B, LI))
add(
    "compare_stats_orders_synthetic",
    lambda spark, sf_dir: rounded(C.compare_stats(*_orders_pair(spark, sf_dir))),
    stats_sql("orders", ORD_SYN, TABLE_COLUMNS["orders"]),
)


# ---- E2 -------------------------------------------------------------------------

def hist_sql(a: str, b: str, c: str, bins: int = 20) -> str:
    both = f"(SELECT CAST({c} AS DOUBLE) AS x, 'original' AS side FROM {a} UNION ALL SELECT CAST({c} AS DOUBLE), 'synthetic' FROM {b})"
    return f"""WITH both_ AS (SELECT * FROM {both} WHERE x IS NOT NULL), r AS (SELECT min(x) AS lo, max(x) AS hi FROM both_),
h AS (SELECT CAST(CASE WHEN (r.hi - r.lo) / {bins} > 0 THEN least(floor((x - r.lo) / ((r.hi - r.lo) / {bins})), {bins - 1}) ELSE 0 END AS INTEGER) AS bin,
        count_if(side = 'original') AS orig_count, count_if(side = 'synthetic') AS synth_count
      FROM both_, r GROUP BY 1),
e AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})),
f AS (SELECT e.bin, coalesce(orig_count, 0) AS orig_count, coalesce(synth_count, 0) AS synth_count FROM e LEFT JOIN h USING (bin))
SELECT {_lit(c)} AS "column", bin, {r_sql(f"r.lo + bin * ((r.hi - r.lo) / {bins})")} AS bin_start,
  {r_sql(f"CASE WHEN bin = {bins - 1} THEN r.hi ELSE r.lo + (bin + 1) * ((r.hi - r.lo) / {bins}) END")} AS bin_end, orig_count, synth_count FROM f, r"""


add(
    "compare_histogram_lineitem_halves",
    lambda spark, sf_dir: rounded(C.histogram(*_halves(spark, sf_dir), "l_extendedprice")),
    hist_sql(LI_A, LI_B, "l_extendedprice"),
)
add(
    "compare_histogram_lineitem_halves_quantity",
    lambda spark, sf_dir: rounded(C.histogram(*_halves(spark, sf_dir), "l_quantity")),
    hist_sql(LI_A, LI_B, "l_quantity"),
)
add(
    "compare_histogram_orders_synthetic",
    lambda spark, sf_dir: rounded(C.histogram(*_orders_pair(spark, sf_dir), "o_totalprice")),
    hist_sql("orders", ORD_SYN, "o_totalprice"),
)


# E2 raw values: up to 1000 of each side by keyed draws (the limit is the feature).
def raw_sql(a: str, b: str, c: str, keys: list[str], n: int = 1000, seed: int = 42) -> str:
    key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    side = lambda src, name: f"SELECT '{name}' AS side, CAST(rank AS INTEGER) AS rank, value FROM (SELECT CAST({c} AS VARCHAR) AS value, row_number() OVER (ORDER BY {R.sql_uniform(seed, name, key)}, CAST({c} AS VARCHAR)) AS rank FROM {src} WHERE {c} IS NOT NULL) WHERE rank <= {n}"
    return side(a, "original") + " UNION ALL " + side(b, "synthetic")


_LINE = ["l_orderkey", "l_linenumber"]
add("compare_raw_values_lineitem_halves", lambda spark, sf_dir: C.raw_values(*_halves(spark, sf_dir), "l_quantity", _LINE), raw_sql(LI_A, LI_B, "l_quantity", _LINE))
add("compare_raw_values_lineitem_halves_flag", lambda spark, sf_dir: C.raw_values(*_halves(spark, sf_dir), "l_returnflag", _LINE), raw_sql(LI_A, LI_B, "l_returnflag", _LINE))


# ---- E3 -------------------------------------------------------------------------

def cat_sql(a: str, b: str, c: str, k: int = 20) -> str:
    both = f"(SELECT CAST({c} AS VARCHAR) AS value, 'original' AS side FROM {a} UNION ALL SELECT CAST({c} AS VARCHAR), 'synthetic' FROM {b})"
    return f"""SELECT {_lit(c)} AS "column", side, CAST(rank AS INTEGER) AS rank, value, count FROM (
  SELECT side, value, count(*) AS count, row_number() OVER (PARTITION BY side ORDER BY count(*) DESC, value) AS rank
  FROM {both} WHERE value IS NOT NULL GROUP BY side, value) WHERE rank <= {k}"""


add("compare_categories_lineitem_halves", lambda spark, sf_dir: C.category_counts(*_halves(spark, sf_dir), "l_quantity"), cat_sql(LI_A, LI_B, "l_quantity"))
add(
    "compare_categories_orders_synthetic",
    lambda spark, sf_dir: C.category_counts(*_orders_pair(spark, sf_dir), "o_orderpriority"),
    cat_sql("orders", ORD_SYN, "o_orderpriority"),
)


# ---- E4/E5/E6 ---------------------------------------------------------------------

def _corr(src: str, x: str, y: str) -> str:
    return f"(SELECT CASE WHEN var_pop(a) * var_pop(b) > 0 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END FROM (SELECT CAST({x} AS DOUBLE) AS a, CAST({y} AS DOUBLE) AS b FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"


def pairs_core_sql(a: str, b: str, cols: list[str]) -> str:
    cols = sorted(cols)
    parts = []
    for i, x in enumerate(cols):
        for y in cols[i + 1:]:
            parts.append(f"SELECT {_lit(x)} AS column1, {_lit(y)} AS column2, {_corr(a, x, y)} AS o, {_corr(b, x, y)} AS s")
    return "\nUNION ALL\n".join(parts)


def pairs_sql(a: str, b: str, cols: list[str]) -> str:
    return f"""SELECT column1, column2, round_even(o, 3) AS original, round_even(s, 3) AS synthetic, round_even(o - s, 3) AS difference,
  round_even(abs(o - s), 3) AS abs_difference FROM ({pairs_core_sql(a, b, cols)})"""


def matrices_sql(a: str, b: str, cols: list[str]) -> str:
    parts = [f"SELECT {_lit(x)} AS column1, {_lit(y)} AS column2, {_corr(a, x, y)} AS o, {_corr(b, x, y)} AS s" for x in cols for y in cols]
    return f"SELECT column1, column2, round_even(o, 3) AS original, round_even(s, 3) AS synthetic, round_even(o - s, 3) AS difference FROM ({' UNION ALL '.join(parts)})"


def metrics_sql(a: str, b: str, cols: list[str]) -> str:
    return f"""SELECT round_even(avg(abs(o - s)), 3) AS mae, round_even(sqrt(avg((o - s) * (o - s))), 3) AS rmse, round_even(max(abs(o - s)), 3) AS max_difference,
  round_even(CASE WHEN var_pop(CASE WHEN o IS NOT NULL AND s IS NOT NULL THEN o END) * var_pop(CASE WHEN o IS NOT NULL AND s IS NOT NULL THEN s END) > 0
    THEN covar_pop(o, s) / sqrt(var_pop(CASE WHEN o IS NOT NULL AND s IS NOT NULL THEN o END) * var_pop(CASE WHEN o IS NOT NULL AND s IS NOT NULL THEN s END)) END, 3) AS correlation_of_correlations,
  count(*) AS pairs FROM ({pairs_core_sql(a, b, cols)})"""


LI_NUM = [c for c, k in LI if k == "numeric"]
ORD_NUM = [c for c, k in TABLE_COLUMNS["orders"] if k == "numeric"]
add("compare_correlations_lineitem_halves", lambda spark, sf_dir: C.correlation_pairs(*_halves(spark, sf_dir)).drop("_o", "_s"), pairs_sql(LI_A, LI_B, LI_NUM))
add("compare_correlation_metrics_lineitem_halves", lambda spark, sf_dir: C.correlation_metrics(C.correlation_pairs(*_halves(spark, sf_dir))), metrics_sql(LI_A, LI_B, LI_NUM))
add("compare_correlation_matrices_lineitem_halves", lambda spark, sf_dir: C.correlation_matrices(*_halves(spark, sf_dir)), matrices_sql(LI_A, LI_B, LI_NUM))
add("compare_correlations_orders_synthetic", lambda spark, sf_dir: C.correlation_pairs(*_orders_pair(spark, sf_dir)).drop("_o", "_s"), pairs_sql("orders", ORD_SYN, ORD_NUM))
add("compare_correlation_metrics_orders_synthetic", lambda spark, sf_dir: C.correlation_metrics(C.correlation_pairs(*_orders_pair(spark, sf_dir))), metrics_sql("orders", ORD_SYN, ORD_NUM))


# ---- E7 -------------------------------------------------------------------------

def shapes_sql(a: str, b: str, cols: list[tuple[str, str]], categorical: list[str]) -> str:
    parts = []
    for i, (c, kind) in enumerate(cols):
        if kind in ("numeric", "datetime") and c not in categorical:
            x = f"CAST(epoch_us({c}) AS DOUBLE)" if kind == "datetime" else f"CAST({c} AS DOUBLE)"
            parts.append(
                f"""SELECT {_lit(c)} AS "column", CAST({i} AS INTEGER) AS position, 'KSComplement' AS metric, 1 - max(abs(d)) AS score FROM (
  SELECT sum(a / n1 - b / n2) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS d FROM (
    SELECT v, count_if(side = 1) AS a, count_if(side = -1) AS b FROM
      (SELECT {x} AS v, 1 AS side FROM {a} UNION ALL SELECT {x}, -1 FROM {b}) WHERE v IS NOT NULL GROUP BY v),
    (SELECT count({c}) AS n1 FROM {a}), (SELECT count({c}) AS n2 FROM {b}))"""
            )
        else:
            parts.append(
                f"""SELECT {_lit(c)}, CAST({i} AS INTEGER), 'TVComplement', 1 - 0.5 * sum(abs(a / n1 - b / n2)) FROM (
  SELECT v, count_if(side = 1) AS a, count_if(side = -1) AS b FROM
    (SELECT CAST({c} AS VARCHAR) AS v, 1 AS side FROM {a} UNION ALL SELECT CAST({c} AS VARCHAR), -1 FROM {b}) WHERE v IS NOT NULL GROUP BY v),
  (SELECT count({c}) AS n1 FROM {a}), (SELECT count({c}) AS n2 FROM {b})"""
            )
    return "\nUNION ALL\n".join(parts)


LI_CAT = ["l_linenumber", "l_discount", "l_tax"]


def _shapes_query(spark, sf_dir):
    return rounded(C.column_shapes(*_halves(spark, sf_dir), LI_CAT))


add("compare_shapes_lineitem_halves", _shapes_query, f"SELECT \"column\", position, metric, {r_sql('score')} AS score FROM ({shapes_sql(LI_A, LI_B, LI, LI_CAT)})")


def trends_sql(a: str, b: str, cols: list[tuple[str, str]], categorical: list[str]) -> str:
    """All pairs of columns: correlation of numbers and datetimes, shares of cells for the rest."""
    num = {c for c, k in cols if k in ("numeric", "datetime") and c not in categorical}
    value = {c: f"CAST(epoch_us({c}) AS DOUBLE)" if k == "datetime" else f"CAST({c} AS DOUBLE)" for c, k in cols}

    def side(src):
        return "(SELECT " + ", ".join(f"{value[c]} AS {c}" for c in sorted(num)) + f" FROM {src})"

    def cell(c):
        if c not in num:
            return f"CAST({c} AS VARCHAR)"
        lo, hi, v = f"(SELECT min({value[c]}) FROM {a})", f"(SELECT max({value[c]}) FROM {a})", value[c]
        return f"CAST(CAST(CASE WHEN {v} < {lo} THEN 0 WHEN {v} >= {hi} THEN 11 ELSE least(floor(({v} - {lo}) / (({hi} - {lo}) / 10)) + 1, 10) END AS BIGINT) AS VARCHAR)"

    parts = [f"SELECT column1, column2, 'CorrelationSimilarity' AS metric, 1 - abs(o - s) / 2 AS score FROM ({pairs_core_sql(side(a), side(b), sorted(num))})"]
    for i, (x, _) in enumerate(cols):
        for y, _ in cols[i + 1:]:
            if x in num and y in num:
                continue
            parts.append(
                f"""SELECT {_lit(x)}, {_lit(y)}, 'ContingencySimilarity', 1 - 0.5 * sum(abs(ca / (SELECT count(*) FROM {a}) - cb / (SELECT count(*) FROM {b}))) FROM (
  SELECT x, y, count_if(side = 1) AS ca, count_if(side = -1) AS cb FROM
    (SELECT {cell(x)} AS x, {cell(y)} AS y, 1 AS side FROM {a} UNION ALL SELECT {cell(x)}, {cell(y)}, -1 FROM {b}) GROUP BY x, y)"""
            )
    return "\nUNION ALL\n".join(parts)


def _quality_query(spark, sf_dir):
    return rounded(C.quality_report(*_halves(spark, sf_dir), LI_CAT))


add(
    "compare_quality_lineitem_halves",
    _quality_query,
    f"""WITH sh AS ({shapes_sql(LI_A, LI_B, LI, LI_CAT)}), tr AS ({trends_sql(LI_A, LI_B, LI, LI_CAT)}),
props AS (SELECT 'Column Shapes' AS property, avg(score) AS score FROM sh UNION ALL SELECT 'Column Pair Trends', avg(score) FROM tr)
SELECT property, {r_sql('score')} AS score FROM props UNION ALL SELECT 'Overall', {r_sql('avg(score)')} FROM props""",
)
add(
    "compare_pair_trends_lineitem_halves",
    lambda spark, sf_dir: rounded(C.pair_trends(*_halves(spark, sf_dir), LI_CAT)),
    f"SELECT column1, column2, metric, {r_sql('score')} AS score FROM ({trends_sql(LI_A, LI_B, LI, LI_CAT)})",
)
