"""Registered synthesis queries (D1-D18) and their DuckDB twins.

Every twin recomputes the same keyed md5 uniforms, so random output is
compared value for value. Generated tables have as many rows as their
source (a same-size synthetic twin).
"""

from __future__ import annotations


from pyspark.sql import functions as F

from facsimile.functions import pools
from facsimile.functions import rand as R
from facsimile.operators import markov as MK
from facsimile.operators import profile as P
from facsimile.operators import synth as S
from facsimile.plans.common import r_sql, rounded
from facsimile.plans.oracle_profile import column_stats_sql
from facsimile.plans.registry import add
from facsimile.plans.tables import INTEGRAL_COLUMNS, pii_customers, pii_sql, table

SEED = 42


def _synth(name: str, config: dict[str, str] | None, src_fn=None, cols: list[str] | None = None):
    """Query: fit on a table (or view) with fixed methods, generate count rows."""

    def q(spark, sf_dir):
        df = src_fn(spark, sf_dir) if src_fn else table(spark, sf_dir, name)
        if cols:
            df = df.select(*cols)
        cfg = None if config is None else {c: {"generation_method": m} for c, m in config.items()}
        if cfg is not None:
            for c in df.columns:
                cfg.setdefault(c, {"include": False})
        model = S.fit(df, cfg, seed=SEED)
        n = model.columns[0].params["rows"]
        return rounded(S.generate(model, n))

    return q


# ------------------------------------------------------------ SQL builders

def _u(col: str, k: str | None = None, k_sql: str | None = None) -> str:
    return R.sql_uniform(SEED, col, "g.id", k, k_sql)


def _idx(col: str, n_sql: str, k: str) -> str:
    return f"CAST(floor({_u(col, k)} * ({n_sql})) AS BIGINT)"


def _pick(pool: list[str], col: str, k: str) -> str:
    arr = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in pool) + "]"
    return f"({arr})[{_idx(col, str(len(pool)), k)} + 1]"


def gaussian_sql(t: str, c: str) -> tuple[str, str]:
    """(params CTE body, value expression over g and p_<c>)."""
    x = f"CAST({c} AS DOUBLE)"
    params = f"SELECT count(*) AS rows, count({x}) AS nn, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS mn, max({x}) AS mx, bool_and({x} = floor({x})) AS isint FROM {t}"
    p = f"p_{c}"
    z = R.sql_normal(SEED, c, "g.id")
    val = f"least(greatest({p}.mean + {p}.std * {z}, {p}.mn - ({p}.mx - {p}.mn) * 0.1), {p}.mx + ({p}.mx - {p}.mn) * 0.1)"
    rnd = f"round_even({val}, 0)"
    if c in INTEGRAL_COLUMNS:
        rnd = f"CAST({rnd} AS BIGINT)"
    body = f"CASE WHEN {p}.isint THEN {rnd} ELSE {val} END" if c not in INTEGRAL_COLUMNS else rnd
    expr = f"CASE WHEN {_u(c, 'null')} >= 1.0 - {p}.nn / {p}.rows THEN {body} END"
    return params, expr


def intervals_sql(t: str, c: str, nulls: bool = True) -> str:
    where = "" if nulls else f" WHERE {c} IS NOT NULL"
    return f"""SELECT v, sum(n) OVER (ORDER BY v NULLS FIRST ROWS UNBOUNDED PRECEDING) - n AS rs,
  sum(n) OVER (ORDER BY v NULLS FIRST ROWS UNBOUNDED PRECEDING) AS re
FROM (SELECT {c} AS v, count(*) AS n FROM {t}{where} GROUP BY 1)"""


def table_sql(t: str, methods: dict[str, str], src: str | None = None) -> str:
    """SQL twin of fit + generate for the listed columns (source order)."""
    src = src or t
    ctes = [f"g AS (SELECT (row_number() OVER () - 1) AS id FROM {src})"]
    joins: list[str] = []
    cols: list[str] = []
    for c, m in methods.items():
        p = f"p_{c}"
        if m == "gaussian_copula":
            params, expr = gaussian_sql(src, c)
            ctes.append(f"{p} AS ({params})")
            joins.append(f"CROSS JOIN {p}")
            cols.append(f"{expr} AS {c}")
        elif m in ("frequency_sampling", "sample"):
            ctes.append(f"iv_{c} AS ({intervals_sql(src, c)})")
            ctes.append(f"{p} AS (SELECT count(*) AS rows FROM {src})")
            joins.append(f"CROSS JOIN {p}")
            pos = f"floor({_u(c, 'pos')} * {p}.rows)"
            joins.append(f"JOIN iv_{c} ON {pos} >= iv_{c}.rs AND {pos} < iv_{c}.re")
            cols.append(f"iv_{c}.v AS {c}")
        elif m == "kde":
            x = f"CAST({c} AS DOUBLE)"
            ctes.append(f"iv_{c} AS ({intervals_sql(src, c, nulls=False)})")
            ctes.append(f"{p} AS (SELECT count({x}) AS nn, stddev_samp({x}) AS std, min({x}) AS mn, max({x}) AS mx FROM {src})")
            joins.append(f"CROSS JOIN {p}")
            pos = f"floor({_u(c, 'pos')} * {p}.nn)"
            joins.append(f"JOIN iv_{c} ON {pos} >= iv_{c}.rs AND {pos} < iv_{c}.re")
            z = R.sql_normal(SEED, c, "g.id", "kde")
            cols.append(f"least(greatest(CAST(iv_{c}.v AS DOUBLE) + {p}.std * pow({p}.nn, -0.2) * {z}, {p}.mn), {p}.mx) AS {c}")
        elif m == "datetime_range":
            us = f"epoch_us({c})"
            ctes.append(f"{p} AS (SELECT min({us}) AS lo, max({us}) AS hi FROM {src})")
            joins.append(f"CROSS JOIN {p}")
            cols.append(f"make_timestamp({p}.lo + {_idx(c, f'({p}.hi - {p}.lo) // 1000000 + 1', 'ts')} * 1000000) AS {c}")
        elif m == "bernoulli":
            ctes.append(f"{p} AS (SELECT coalesce(avg(CAST(CAST({c} AS DOUBLE) <> 0 AS DOUBLE)), 0.5) AS pr FROM {src})")
            joins.append(f"CROSS JOIN {p}")
            cols.append(f"{_u(c, 'bern')} < {p}.pr AS {c}")
        elif m == "sequential_id":
            first = f"(SELECT min(CAST({c} AS VARCHAR)) FROM {src})"
            ctes.append(
                f"{p} AS (SELECT CASE WHEN regexp_matches(f, '^[A-Za-z_]*[0-9]+') THEN regexp_extract(f, '^([A-Za-z_]*)([0-9]+)', 1) ELSE 'ID_' END AS pre, "
                f"CASE WHEN regexp_matches(f, '^[A-Za-z_]*[0-9]+') THEN length(regexp_extract(f, '^([A-Za-z_]*)([0-9]+)', 2)) ELSE 5 END AS w FROM (SELECT coalesce({first}, 'ID_00001') AS f))"
            )
            joins.append(f"CROSS JOIN {p}")
            s = "CAST(g.id + 1 AS VARCHAR)"
            cols.append(f"{p}.pre || CASE WHEN length({s}) >= {p}.w THEN {s} ELSE lpad({s}, CAST({p}.w AS INTEGER), '0') END AS {c}")
        elif m == "faker_email":
            cols.append(
                f"lower({_pick(pools.FIRST_NAMES, c, 'first')}) || '.' || lower({_pick(pools.LAST_NAMES, c, 'last')}) || printf('%02d', {_idx(c, '100', 'num')}) || '@' || {_pick(pools.EMAIL_DOMAINS, c, 'domain')} AS {c}"
            )
        elif m == "faker_phone":
            n = _idx(c, "10000000000", "phone")
            cols.append(f"printf('(%03d) %03d-%04d', {n} // 10000000, ({n} // 10000) % 1000, {n} % 10000) AS {c}")
        elif m == "faker_name":
            cols.append(f"{_pick(pools.FIRST_NAMES, c, 'first')} || ' ' || {_pick(pools.LAST_NAMES, c, 'last')} AS {c}")
        elif m == "faker_address":
            cols.append(
                f"printf('%d %s %s, %s, %s %05d', {_idx(c, '9999', 'num')} + 1, {_pick(pools.STREET_NAMES, c, 'street')}, {_pick(pools.STREET_SUFFIXES, c, 'suffix')}, "
                f"{_pick(pools.CITIES, c, 'city')}, {_pick(pools.STATES, c, 'state')}, {_idx(c, '100000', 'zip')}) AS {c}"
            )
        elif m == "uuid":
            h = f"md5('{SEED}:{c}:' || CAST(g.id AS VARCHAR) || ':uuid')"
            cols.append(
                f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || "
                f"substr('89ab', CAST(('0x' || substr({h}, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) AS {c}"
            )
        elif m == "faker_text":
            ctes.append(f"{p} AS (SELECT coalesce(avg(len(regexp_extract_all({c}, '\\S+'))), 3) AS aw FROM {src})")
            joins.append(f"CROSS JOIN {p}")
            arr = "[" + ", ".join(f"'{w}'" for w in pools.WORDS) + "]"
            word = f"{arr}[CAST(floor({R.sql_uniform(SEED, c, 'g.id', None, 'j')} * {len(pools.WORDS)}) AS BIGINT) + 1]"
            sent = f"array_to_string(list_transform(range(1, CAST(trunc({p}.aw) AS BIGINT) + 1), lambda j: {word}), ' ')"
            one = f"{arr}[CAST(floor({R.sql_uniform(SEED, c, 'g.id', 1)} * {len(pools.WORDS)}) AS BIGINT) + 1]"
            cols.append(f"CASE WHEN {p}.aw <= 2 THEN {one} ELSE upper(substr({sent}, 1, 1)) || lower(substr({sent}, 2)) || '.' END AS {c}")
        else:
            raise ValueError(m)
    sel = ", ".join(cols)
    return f"WITH {', '.join(ctes)}\nSELECT {sel} FROM g {' '.join(joins)}"


def _rounded_sql(sql: str, methods: dict[str, str]) -> str:
    outs = []
    for c, m in methods.items():
        if m in ("gaussian_copula", "kde") and c not in INTEGRAL_COLUMNS:
            outs.append(f"{r_sql(c)} AS {c}")
        else:
            outs.append(c)
    return f"SELECT {', '.join(outs)} FROM ({sql})"


def _register(name: str, t: str, methods: dict[str, str], src_fn=None, src_sql: str | None = None):
    add(name, _synth(t, methods, src_fn), _rounded_sql(table_sql(t, methods, src_sql), methods))


_register("synth_gaussian_lineitem", "lineitem", {"l_quantity": "gaussian_copula", "l_extendedprice": "gaussian_copula", "l_discount": "gaussian_copula", "l_suppkey": "gaussian_copula"})
_register("synth_categorical_orders", "orders", {"o_orderstatus": "frequency_sampling", "o_orderpriority": "frequency_sampling"})
_register("synth_categorical_lineitem", "lineitem", {"l_returnflag": "frequency_sampling", "l_linestatus": "frequency_sampling", "l_shipdate": "frequency_sampling"})
_register("synth_bootstrap_customer", "customer", {"c_name": "sample", "c_acctbal": "sample", "c_mktsegment": "sample"})
_register("synth_kde_customer", "customer", {"c_acctbal": "kde"})
_register("synth_kde_lineitem", "lineitem", {"l_extendedprice": "kde"})
_register("synth_datetime_orders", "orders", {"o_orderdate": "datetime_range"})
_register("synth_datetime_events", "events", {"ts": "datetime_range"})
_register("synth_bernoulli_labels", "labels", {"quality": "bernoulli", "toxic": "bernoulli"})
_register("synth_sequential_nation", "nation", {"n_name": "sequential_id"})
_register("synth_sequential_customer", "customer", {"c_name": "sequential_id"})
_register(
    "synth_fake_values_customers",
    "pii_customers",
    {"c_custkey": "uuid", "c_name": "faker_name", "c_mktsegment": "faker_text", "contact_email": "faker_email", "phone": "faker_phone", "alt_contact": "faker_address"},
    src_fn=pii_customers,
    src_sql=pii_sql(),
)
_register("synth_faker_text_part", "part", {"p_name": "faker_text", "p_type": "faker_text"})

# D16 with automatic methods from the profile of the whole table.
AUTO_ORDERS = {
    "o_orderkey": "gaussian_copula", "o_custkey": "gaussian_copula", "o_orderstatus": "frequency_sampling",
    "o_totalprice": "gaussian_copula", "o_orderdate": "datetime_range", "o_orderpriority": "frequency_sampling",
}
add("synth_table_orders", _synth("orders", None), _rounded_sql(table_sql("orders", AUTO_ORDERS), AUTO_ORDERS))
AUTO_LINEITEM = {
    "l_orderkey": "gaussian_copula", "l_partkey": "gaussian_copula", "l_suppkey": "gaussian_copula",
    "l_linenumber": "frequency_sampling", "l_quantity": "gaussian_copula", "l_extendedprice": "gaussian_copula",
    "l_discount": "frequency_sampling", "l_tax": "frequency_sampling", "l_returnflag": "frequency_sampling",
    "l_linestatus": "frequency_sampling", "l_shipdate": "datetime_range",
}
add("synth_table_lineitem", _synth("lineitem", None), _rounded_sql(table_sql("lineitem", AUTO_LINEITEM), AUTO_LINEITEM))


# ---- D9 bigrams ------------------------------------------------------------------

def bigram_sql(t: str, c: str) -> str:
    w = f"string_split_regex(trim({c}, ' \t\n\r'), '\\s+')"
    return f"""SELECT lower(w[i]) AS key, w[i + 1] AS next_word, count(*) AS n
FROM (SELECT {w} AS w FROM {t} WHERE {c} IS NOT NULL AND len(regexp_extract_all({c}, '\\S+')) >= 2) s,
     range(1, len(w)) r(i)
GROUP BY 1, 2"""


for _t in ["documents", "conversations", "benchmark"]:
    add(f"markov_bigrams_{_t}", (lambda t: lambda spark, sf_dir: MK.bigrams(table(spark, sf_dir, t), "text"))(_t), bigram_sql(_t, "text"))


# ---- D10 walk ----------------------------------------------------------------------

def q_walk(name: str):
    """As many walks as there are texts, of their mean length."""

    def q(spark, sf_dir):
        model = MK.MarkovModel(table(spark, sf_dir, name), "text")
        return MK.walk(model, spark.range(model.texts), SEED)

    return q


def walk_sql(t: str, c: str) -> str:
    big = bigram_sql(t, c)
    u = lambda k_sql: R.sql_uniform(SEED, c, "w.id", None, k_sql)
    return f"""WITH RECURSIVE big AS ({big}),
tot AS (SELECT key, sum(n) AS total FROM big GROUP BY key),
tr AS (SELECT key, next_word, sum(n) OVER (PARTITION BY key ORDER BY next_word ROWS UNBOUNDED PRECEDING) - n AS rs,
              sum(n) OVER (PARTITION BY key ORDER BY next_word ROWS UNBOUNDED PRECEDING) AS re FROM big),
ks AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM tot),
nk AS (SELECT count(*) AS k FROM ks),
meta AS (SELECT count(*) AS texts, CAST(trunc(avg(len(regexp_extract_all({c}, '\\S+')))) AS BIGINT) AS len FROM {t} WHERE {c} IS NOT NULL),
ids AS (SELECT range AS id FROM range((SELECT texts FROM meta))),
w AS (
  SELECT ids.id, 0 AS step, ks.key AS cur FROM ids, nk, ks
  WHERE ks.idx = CAST(floor({R.sql_uniform(SEED, c, 'ids.id', 'start')} * nk.k) AS BIGINT)
  UNION ALL
  SELECT w.id, w.step + 1,
    CASE WHEN tot.total IS NULL THEN
      (SELECT key FROM ks WHERE idx = CAST(floor({u("'r' || CAST(w.step + 1 AS VARCHAR)")} * (SELECT k FROM nk)) AS BIGINT))
    ELSE
      (SELECT next_word FROM tr WHERE tr.key = lower(w.cur)
         AND CAST(floor({u("'m' || CAST(w.step + 1 AS VARCHAR)")} * tot.total) AS BIGINT) >= tr.rs
         AND CAST(floor({u("'m' || CAST(w.step + 1 AS VARCHAR)")} * tot.total) AS BIGINT) < tr.re)
    END
  FROM w LEFT JOIN tot ON tot.key = lower(w.cur), meta
  WHERE w.step + 1 < meta.len
)
SELECT id, string_agg(CASE WHEN step = 0 THEN replace(upper(substr(cur, 1, 1)), 'ẞ', 'SS') || lower(substr(cur, 2)) ELSE cur END, ' ' ORDER BY step) AS text
FROM w GROUP BY id"""


for _t in ["benchmark", "documents", "conversations"]:
    add(f"markov_walk_{_t}", q_walk(_t), walk_sql(_t, "text"))


# ---- D18 metadata ------------------------------------------------------------------

def metadata_sql(t: str) -> str:
    return f"""SELECT "column", position, detected_type, CASE detected_type WHEN 'continuous' THEN 'numerical' WHEN 'datetime' THEN 'datetime'
  WHEN 'boolean' THEN 'boolean' WHEN 'id' THEN 'id' ELSE 'categorical' END AS sdtype FROM ({column_stats_sql(t)})"""


for _t in ["orders", "events", "labels"]:
    add(f"synth_metadata_{_t}", (lambda t: lambda spark, sf_dir: S.metadata(P.column_stats(table(spark, sf_dir, t), quartiles=False)))(_t), metadata_sql(_t))



# ---- D17 Gaussian copula (approximate quantile grid: rows-only check) ----------

def _copula(view):
    def run(spark, sf_dir):
        from facsimile.operators import copula as CP

        model = CP.fit_copula(view(spark, sf_dir), seed=SEED)
        return CP.generate_copula(model, model.rows)

    return run


def _orders_with_nulls(spark, sf_dir):
    """orders with nulls derived from its key in every other column."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", *[F.when(F.col("o_orderkey") % 5 != i, F.col(c)).alias(c) for i, c in enumerate(o.columns[1:])])


add("synth_copula_part", _copula(lambda spark, sf_dir: table(spark, sf_dir, "part")))
add("synth_copula_orders", _copula(lambda spark, sf_dir: table(spark, sf_dir, "orders")))
add("synth_copula_orders_with_nulls", _copula(_orders_with_nulls))
