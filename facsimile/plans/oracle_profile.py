"""DuckDB SQL twins of the profile queries, generated per table.

Independent restatement of the profile semantics in plain SQL (one SELECT
per column, UNION ALL), used only to check the Spark operators.
"""

from __future__ import annotations

from facsimile.plans.common import r_sql
from facsimile.plans.tables import TABLE_COLUMNS

EMAIL_RE = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


# The types that the names of the test tables' columns say.
NAMED = {
    "id": ["conv_id", "doc_id", "event_id", "item_id", "page_id", "user_id", "vec_id"],
    "name": ["c_name", "n_name", "p_name", "r_name", "s_name"],
    "email": ["contact_email"],
    "phone": ["phone"],
}


def _name_type(name: str) -> str | None:
    return next((kind for kind, names in NAMED.items() if name in names), None)


def _lit(v: str | None) -> str:
    return "NULL::VARCHAR" if v is None else "'" + v.replace("'", "''") + "'"


def _words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def _rate(x: str, pattern: str) -> str:
    return f"avg(CASE WHEN {x} IS NULL THEN NULL WHEN regexp_matches({x}, '{pattern}') THEN 1 ELSE 0 END)"


def column_stats_sql(table: str, src: str | None = None, cols: list[tuple[str, str]] | None = None) -> str:
    """column, position, counts, percentages, moments, quartiles, lengths, type."""
    cols = cols or TABLE_COLUMNS[table]
    src = src or table
    parts = []
    for pos, (name, kind) in enumerate(cols):
        nt = _name_type(name)
        x = "x"
        num = dbl = "NULL::DOUBLE"
        mean = std = mn = mx = q25 = med = q75 = dbl
        avgl = "NULL::DOUBLE"
        minl = maxl = "NULL::BIGINT"
        words = email = "NULL::DOUBLE"
        if kind == "numeric":
            inner = f"SELECT CAST({name} AS DOUBLE) AS x FROM {src}"
            mean, std, mn, mx = f"avg({x})", f"stddev_samp({x})", f"min({x})", f"max({x})"
            q25, med, q75 = (f"quantile_cont({x}, {p})" for p in (0.25, 0.5, 0.75))
        elif kind == "string":
            inner = f"SELECT CAST({name} AS VARCHAR) AS x FROM {src}"
            avgl, minl, maxl = f"avg(length({x}))", f"CAST(min(length({x})) AS BIGINT)", f"CAST(max(length({x})) AS BIGINT)"
            words = f"avg({_words(x)})"
            email = _rate(x, EMAIL_RE)
        else:
            inner = f"SELECT {name} AS x FROM {src}"
        del num
        z1 = f"bool_and({x} IN (0, 1))" if kind == "numeric" else "NULL::BOOLEAN"
        parts.append(
            f"""SELECT {_lit(name)} AS "column", CAST({pos} AS INTEGER) AS position,
  count(*) AS n_all, count({x}) AS non_null, count(DISTINCT {x}) AS unique_count,
  {mean} AS mean, {std} AS std, {mn} AS min, {mx} AS max, {q25} AS q25, {med} AS median, {q75} AS q75,
  {avgl} AS avg_length, {minl} AS min_length, {maxl} AS max_length, {words} AS avg_words, {email} AS email_rate,
  {z1} AS z1, {_lit(kind)} AS kind, {_lit(nt)} AS name_type
FROM ({inner}) t"""
        )
    union = "\nUNION ALL\n".join(parts)
    ratio = "CASE WHEN n_all > 0 THEN unique_count / n_all ELSE 0 END"
    typ = f"""CASE
  WHEN name_type IS NOT NULL THEN name_type
  WHEN kind = 'nested' THEN 'nested'
  WHEN (non_null = 0 OR (kind = 'numeric' AND coalesce(z1, false))) AND unique_count <= 2 THEN 'boolean'
  WHEN kind = 'datetime' THEN 'datetime'
  WHEN kind = 'numeric' THEN CASE WHEN unique_count <= 20 OR ({ratio} < 0.05 AND unique_count < 50) THEN 'categorical' ELSE 'continuous' END
  WHEN kind = 'string' THEN CASE
      WHEN email_rate > 0.8 THEN 'email'
      WHEN avg_words > 10 THEN 'free_text'
      WHEN unique_count <= 50 OR {ratio} < 0.1 THEN 'categorical'
      WHEN avg_words <= 5 THEN 'text'
      ELSE 'free_text' END
  ELSE 'text' END"""
    return f"""SELECT "column", position, n_all AS count, non_null, n_all - non_null AS null_count,
  {r_sql("CASE WHEN n_all > 0 THEN (n_all - non_null) * 100.0 / n_all ELSE 0 END")} AS null_percentage,
  unique_count,
  {r_sql("CASE WHEN n_all > 0 THEN unique_count * 100.0 / n_all ELSE 0 END")} AS unique_percentage,
  {r_sql("mean")} AS mean, {r_sql("std")} AS std, {r_sql("min")} AS min, {r_sql("max")} AS max,
  {r_sql("q25")} AS q25, {r_sql("median")} AS median, {r_sql("q75")} AS q75,
  {r_sql("avg_length")} AS avg_length, min_length, max_length, {r_sql("avg_words")} AS avg_words,
  {typ} AS detected_type
FROM ({union}) s"""
