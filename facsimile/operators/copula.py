"""Joint synthesis with a Gaussian copula.

Fit:
* numeric and datetime columns: a grid of approximate quantiles (one ``percentile_approx``
  aggregate, grid x columns numbers to the driver); each value's CDF
  position is found by a balanced ``when`` tree over the grid (compiled
  comparisons, no join);
* all other columns: the midpoint of each value's cumulative interval, joined
  by value (Catalyst broadcasts the intervals only if they are small);
* normal scores ``z = Phi^-1(u)`` as column arithmetic (rational
  approximation), their correlation matrix by the centred-sum aggregate,
  and its Cholesky factor on the driver (columns x columns numbers).

Generate: independent keyed normals per row, correlated by the factor,
mapped through ``Phi`` to uniforms and then to values of the exact empirical
marginals by one index and one join over all columns (``sampling``). Nulls come
back at each column's rate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from facsimile.functions import rand as R
from facsimile.functions.text import ntz_micros
from facsimile.operators.profile import columns_of, correlation_matrix, normalized
from facsimile.operators.sampling import Sampled, rank_index, sample, supported
from facsimile.operators.synth import sample_by_rank, value_intervals, value_intervals_counted
from facsimile.session import cut_lineage

GRID = 200

# Published coefficients of the rational approximations used
# for the normal quantile (P. J. Acklam) and for erf (Abramowitz & Stegun
# 7.1.26).
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
ACKLAM_P_LOW = 0.02425
AS_P = 0.3275911
AS_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def _poly(coeffs: list[float], x: Column) -> Column:
    out = F.lit(coeffs[0])
    for c in coeffs[1:]:
        out = out * x + F.lit(c)
    return out


def norm_ppf(u: Column) -> Column:
    """Inverse standard normal CDF of u in (0, 1)."""
    q = u - 0.5
    r = q * q
    central = q * _poly(ACKLAM_A, r) / (_poly(ACKLAM_B, r) * r + 1.0)
    ql = F.sqrt(-2.0 * F.ln(u))
    low = _poly(ACKLAM_C, ql) / (_poly(ACKLAM_D, ql) * ql + 1.0)
    qh = F.sqrt(-2.0 * F.ln(1.0 - u))
    high = -_poly(ACKLAM_C, qh) / (_poly(ACKLAM_D, qh) * qh + 1.0)
    return F.when(u < ACKLAM_P_LOW, low).when(u > 1 - ACKLAM_P_LOW, high).otherwise(central)


def norm_cdf(z: Column) -> Column:
    """Standard normal CDF via erf (absolute error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + AS_P * x)
    erf = 1.0 - _poly(list(reversed(AS_A)), t) * t * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def _bisect_left(x: Column, grid: list[float], lo: int, hi: int) -> Column:
    """Number of grid points strictly below x, as a balanced when-tree."""
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x <= F.lit(grid[mid]), _bisect_left(x, grid, lo, mid)).otherwise(_bisect_left(x, grid, mid + 1, hi))


@dataclass
class CopulaModel:
    source: DataFrame
    columns: list[str]
    factor: np.ndarray  # over all columns, in source order
    rows: int
    non_null: dict[str, int]
    seed: int


def _number(c, data_type) -> Column:
    """A numeric or datetime column as a double."""
    if c.kind == "datetime":
        return (F.unix_micros(c.ref) if isinstance(data_type, TimestampType) else ntz_micros(c.ref)).cast("double")
    return c.ref.cast("double")


def fit_copula(df: DataFrame, columns: list[str] | None = None, seed: int = 42, grid: int = GRID) -> CopulaModel:
    """Fit on every column (or ``columns``), in source order.

    A null has no score: correlations use the rows where both columns have a
    value. A column without values stays independent.
    """
    src = normalized(df)
    cols = [c for c in columns_of(df) if columns is None or c.name in columns]
    types = {f.name: f.dataType for f in src.schema.fields}
    counts = src.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c.ref).alias(f"n{c.position}") for c in cols]).first()
    num = [c for c in cols if c.kind in ("numeric", "datetime")]
    probs = [i / grid for i in range(1, grid)]
    qrow = src.agg(*[F.percentile_approx(_number(c, types[c.name]), probs, 10000).alias(f"q{c.position}") for c in num]).first() if num else None

    # Positional names: no name of the source can meet a helper column.
    # Numbers become plain columns here: a value is made once, not once per
    # comparison with the grid.
    table = src.select(*[(_number(c, types[c.name]) if c in num else c.ref).alias(f"c{c.position}") for c in cols])
    uniforms = {}
    for c in cols:
        ref = F.col(f"c{c.position}")
        if c in num:
            g = sorted(qrow[f"q{c.position}"] or [])
            k = _bisect_left(ref, g, 0, len(g))
            uniforms[c.name] = F.when(ref.isNotNull(), (k.cast("double") + 0.5) / float(len(g) + 1))
        elif counts[f"n{c.position}"]:
            iv = value_intervals(src, c.name, include_nulls=False)
            mid = (F.col("rank_start") + F.col("rank_end")) / 2.0 / F.lit(float(counts[f"n{c.position}"]))
            iv = iv.select(F.col("_value").alias(f"_v{c.position}"), mid.alias(f"_u{c.position}"))
            table = table.join(iv, ref == F.col(f"_v{c.position}"), "left").drop(f"_v{c.position}")
            uniforms[c.name] = F.col(f"_u{c.position}")
        else:
            uniforms[c.name] = F.lit(None).cast("double")
    # Two projections: the grid search is evaluated once per value, and the
    # quantile function (which reads u several times) sees a plain column,
    # keeping the generated code small enough to compile.
    ut = table.select(*[uniforms[c.name].alias(f"c{c.position}") for c in cols])
    zt = cut_lineage(ut.select(*[F.when(F.col(f"c{c.position}").isNotNull(), norm_ppf(F.col(f"c{c.position}"))).alias(f"c{c.position}") for c in cols]))
    names = [f"c{c.position}" for c in cols]
    corr = {(r["column1"], r["column2"]): r["correlation"] for r in correlation_matrix(zt, names).collect()}  # d x d
    d = len(names)
    m = np.eye(d)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            v = corr.get((a, b))
            m[i, j] = 1.0 if i == j else (0.0 if v is None else v)
    w, v = np.linalg.eigh(m)
    m = (v * np.clip(w, 1e-9, None)) @ v.T  # nearest positive definite
    dg = np.sqrt(np.diag(m))
    m = m / np.outer(dg, dg)
    factor = np.linalg.cholesky(m)
    non_null = {c.name: counts[f"n{c.position}"] for c in cols}
    return CopulaModel(src, [c.name for c in cols], factor, counts["_rows"], non_null, seed)


def generate_copula(model: CopulaModel, n: int) -> DataFrame:
    """``n`` rows of all fitted columns, in source order."""
    spark = model.source.sparkSession
    types = {f.name: f.dataType for f in model.source.schema.fields}
    idc = F.col("id")
    d = len(model.columns)
    # Staged projections (independent normals, correlated scores, positions):
    # each stage reads the previous one's columns, so no expression is
    # copied into every later use.
    # The independent normals are written once (n x d doubles) to the shared
    # checkpoint folder; the optimizer would otherwise inline every draw into
    # every correlated score and the CDF, past the size Java can compile.
    base = cut_lineage(spark.range(n).select("id", *[R.normal(model.seed, f"copula{k}", idc).alias(f"_e{k}") for k in range(d)]))
    zs = []
    for i in range(d):
        z = None
        for k in range(i + 1):
            term = F.lit(float(model.factor[i, k])) * F.col(f"_e{k}")
            z = term if z is None else z + term
        zs.append(z.alias(f"_z{i}"))
    base = base.select("id", *zs)
    pos = []
    for i, c in enumerate(model.columns):
        u = F.least(F.greatest(norm_cdf(F.col(f"_z{i}")), F.lit(0.0)), F.lit(1.0 - 1e-12))
        pos.append(F.floor(u * F.lit(float(model.non_null[c]))).cast("long").alias(f"_p{i}"))
    chosen = [Sampled(i, c, types[c], nulls=False) for i, c in enumerate(model.columns) if supported(types[c])]
    whole = [i for i, c in enumerate(model.columns) if not supported(types[c])]
    base = base.select("id", *pos)
    if whole:
        base = cut_lineage(base)
    # One index and one join for the marginals of all columns.
    out = sample(base, rank_index(model.source, chosen), {c.position: F.col(f"_p{c.position}") for c in chosen}, lambda i: f"_c{i}")
    for i in whole:  # nested and binary values are grouped as they are
        c = model.columns[i]
        if not model.non_null[c]:
            out = out.withColumn(f"_c{i}", F.lit(None).cast(types[c]))
            continue
        iv, k = value_intervals_counted(model.source, c, include_nulls=False)
        hit = sample_by_rank(base.select("id", F.col(f"_p{i}").alias("_pos")), iv, "_pos", model.non_null[c], k, f"_c{i}")
        out = out.join(hit, "id")
    for i, c in enumerate(model.columns):
        rate = 1.0 - model.non_null[c] / model.rows if model.rows else 0.0
        if rate > 0 and model.non_null[c]:
            out = out.withColumn(f"_c{i}", F.when(R.uniform(model.seed, c, idc, "null") >= F.lit(rate), F.col(f"_c{i}")))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(model.columns)])
