"""Profile, comparison and masking over views with nulls, and their twins.

The driver's tables hold no null. These views set cells to null by a rule on
the table's key, in the same words on both sides: column ``i`` is null where
``(key + i) % every = 0``; ``every`` is 2 for the last column, 5 for others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.operators import compare as C
from facsimile.operators import mask as M
from facsimile.operators import profile as P
from facsimile.plans import compare_queries as CQ
from facsimile.plans import profile_queries as PQ
from facsimile.plans.common import r_sql, rounded
from facsimile.plans.oracle_profile import column_stats_sql
from facsimile.plans.registry import add
from facsimile.plans.tables import TABLE_COLUMNS, table

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "lineitem": "l_orderkey"}


def _rules(name: str) -> list[tuple[str, str]]:
    cols = [c for c, _ in TABLE_COLUMNS[name] if c != KEYS[name]]
    return [(c, f"({KEYS[name]} + {i}) % {2 if c == cols[-1] else 5} = 0") for i, c in enumerate(cols)]


def with_nulls(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    return df.withColumns({c: F.expr(f"CASE WHEN {rule} THEN NULL ELSE {c} END") for c, rule in _rules(name)})


def over_nulls(name: str, twin: str) -> str:
    """A twin over ``name``, read with the nulls set."""
    cols = ", ".join([KEYS[name]] + [f"CASE WHEN {rule} THEN NULL ELSE {c} END AS {c}" for c, rule in _rules(name)])
    order = ", ".join(c for c, _ in TABLE_COLUMNS[name])
    return f"WITH {name}_with_nulls AS (SELECT {order} FROM (SELECT {cols} FROM {name})) SELECT * FROM ({twin.replace(f'FROM {name}', f'FROM {name}_with_nulls')})"


def _profile(name: str):
    def of(fn):
        return lambda spark, sf_dir: rounded(fn(with_nulls(spark, sf_dir, name)))

    add(f"nulls_profile_overview_{name}", of(P.overview), over_nulls(name, PQ.overview_sql(name)))
    add(f"nulls_profile_columns_{name}", of(lambda df: P.column_stats(df).select(*PQ.STATS_COLS)), over_nulls(name, column_stats_sql(name)))
    add(f"nulls_profile_correlations_{name}", of(P.correlation_matrix), over_nulls(name, PQ.corr_sql(name)))
    add(f"nulls_recommendations_{name}", lambda spark, sf_dir: P.recommendations(P.column_stats(with_nulls(spark, sf_dir, name))).drop("_o"), over_nulls(name, PQ.recommendations_sql(name)))


for _t in KEYS:
    _profile(_t)


# Comparison of a table with its null-carrying view: shapes, all pairs, statistics.
_A, _B = "orders", "orders_with_nulls"
_COLS = TABLE_COLUMNS["orders"]


def _pair(spark, sf_dir):
    return table(spark, sf_dir, "orders"), with_nulls(spark, sf_dir, "orders")


def _beside(twin: str) -> str:
    head = over_nulls("orders", "@").split("SELECT * FROM (@")[0]
    return f"{head}SELECT * FROM ({twin})"


add("nulls_compare_shapes_orders", lambda spark, sf_dir: rounded(C.column_shapes(*_pair(spark, sf_dir))), _beside(f"SELECT \"column\", position, metric, {r_sql('score')} AS score FROM ({CQ.shapes_sql(_A, _B, _COLS, [])})"))
add("nulls_compare_trends_orders", lambda spark, sf_dir: rounded(C.pair_trends(*_pair(spark, sf_dir))), _beside(f"SELECT column1, column2, metric, {r_sql('score')} AS score FROM ({CQ.trends_sql(_A, _B, _COLS, [])})"))
add("nulls_compare_stats_orders", lambda spark, sf_dir: rounded(C.compare_stats(*_pair(spark, sf_dir))), _beside(CQ.stats_sql(_A, _B, _COLS)))


def _round_trip(spark, sf_dir):
    """Tokens of a null-carrying column by distinct values and back: the column itself."""
    src = with_nulls(spark, sf_dir, "customer").select("c_custkey", "c_name")
    kinds = {"c_name": "alphanumeric"}
    masked = M.tokenize(src, kinds, "fixture-key-0001", strategy="distinct")
    return M.detokenize(masked, kinds, M.token_vault(src, kinds, "fixture-key-0001"))


add("nulls_mask_round_trip_customer", _round_trip, over_nulls("customer", "SELECT c_custkey, c_name, false AS c_name_ambiguous FROM customer"))
