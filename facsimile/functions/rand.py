"""Seeded randomness as plain column expressions.

``uniform(seed, name, id, k)`` is a function of its arguments only, so a
generated table is the same at any partition count and after task retries,
and the same numbers can be recomputed in any SQL engine that has ``md5``:

    u = int(first 13 hex digits of md5("{seed}:{name}:{id}[:{k}]")) / 2**52

The 52-bit integer fits a double exactly, so ``u`` is in [0, 1) with 2**-52
resolution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2**52)


def _key(seed: int, name: str, id_col: Column, k: int | str | Column | None) -> Column:
    parts = [F.lit(f"{seed}:{name}:"), id_col.cast("string")]
    if isinstance(k, Column):
        parts += [F.lit(":"), k.cast("string")]
    elif k is not None:
        parts.append(F.lit(f":{k}"))
    return F.concat(*parts)


def uniform(seed: int, name: str, id_col: Column, k: int | str | None = None) -> Column:
    """Uniform double in [0, 1) keyed by (seed, name, id[, k])."""
    h = F.md5(_key(seed, name, id_col, k))
    u = F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") / F.lit(TWO_52)
    # conv() is typed nullable although md5 hex always parses. Declaring the
    # result non-null stops the optimizer from inferring isnotnull() filters
    # that would copy the whole draw expression below every join on it.
    return F.coalesce(u, F.lit(0.0))


def row_uniform(key_cols: list[str], seed: int, name: str = "sample") -> Column:
    """Uniform double of a row, keyed by the text of its key columns (nulls are left out of it)."""
    return uniform(seed, name, F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in key_cols]))


def uniform_index(seed: int, name: str, id_col: Column, n: int | Column, k: int | str | None = None) -> Column:
    """Uniform integer in [0, n)."""
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return F.floor(uniform(seed, name, id_col, k) * n_col).cast("long")


def normal(seed: int, name: str, id_col: Column, k: int | str = "n") -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u1 = uniform(seed, name, id_col, f"{k}1")
    u2 = uniform(seed, name, id_col, f"{k}2")
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def pick(pool: list[str], seed: int, name: str, id_col: Column, k: int | str | None = None) -> Column:
    """One element of a fixed word pool, chosen by a keyed uniform."""
    arr = F.array(*[F.lit(w) for w in pool])
    return F.element_at(arr, uniform_index(seed, name, id_col, len(pool), k).cast("int") + 1)


# --- the same draws as DuckDB SQL text (for the oracle) --------------------

def sql_uniform(seed: int, name: str, id_sql: str, k: int | str | None = None, k_sql: str | None = None) -> str:
    tail = f" || ':{k}'" if k is not None else ""
    if k_sql is not None:
        tail = f" || ':' || CAST({k_sql} AS VARCHAR)"
    key = f"'{seed}:{name}:' || CAST({id_sql} AS VARCHAR){tail}"
    return f"(CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0)"


def sql_uniform_index(seed: int, name: str, id_sql: str, n_sql: str, k: int | str | None = None) -> str:
    return f"CAST(floor({sql_uniform(seed, name, id_sql, k)} * ({n_sql})) AS BIGINT)"


def sql_normal(seed: int, name: str, id_sql: str, k: int | str = "n") -> str:
    u1 = sql_uniform(seed, name, id_sql, f"{k}1")
    u2 = sql_uniform(seed, name, id_sql, f"{k}2")
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos({2.0 * math.pi!r} * {u2}))"


def sql_pick(pool: list[str], seed: int, name: str, id_sql: str, k: int | str | None = None) -> str:
    arr = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in pool) + "]"
    return f"({arr})[{sql_uniform_index(seed, name, id_sql, str(len(pool)), k)} + 1]"
