"""Value counts without values, and the most frequent values of text columns.

``value_counts`` is the frequency table of all scalar columns with texts as
128-bit digests: no text is shuffled or written, a column of long texts costs
as much as one of numbers.

The most frequent values come in two steps. First the digests that can be among
them are found, then one scan reads the values of these digests alone.

* ``heavy_hitters`` keeps a Misra-Gries summary per column and task: at most
  ``capacity`` digests with lower bounds of their counts, and how much any
  count may have been lowered. Summaries merge (bounds and errors add up, the
  smallest counter is taken off), over a tree of ``ARITY`` summaries a node, so
  a column's summary stays this small whatever the number of tasks. If the k-th
  largest lower bound exceeds the error, every value of the first k ranks, ties
  included, is among the digests whose upper bound reaches it, and their exact
  counts are taken by the second scan.
* Where the bound does not separate rank k (a column of nearly unique values),
  the exact counts per digest decide, with the order of the first bytes of the
  values for ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facsimile.functions.text import ntz_micros
from facsimile.operators.columns import Col, columns_of, normalized
from facsimile.session import cut_lineage

CAPACITY = 1024  # digests in a column's summary
ARITY = 32  # summaries merged by one task
FEW = 100_000  # candidates that are sent to every task; more are joined
PREFIX = 7  # bytes of a text whose order is kept as a number

SCALAR = ("boolean", "numeric", "string", "datetime")
_SUMMARY = "position int, part bigint, keys array<bigint>, counts array<bigint>, error bigint"


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def first_bytes(text: Column) -> Column:
    """The first PREFIX bytes of a text as a number of the same order (shorter texts: zero bytes follow)."""
    start = F.substring(F.encode(text, "UTF-8"), 1, PREFIX)
    return F.conv(F.rpad(F.hex(start), 2 * PREFIX, "0"), 16, 10).cast("long")


def _digests(c: Col) -> list[Column]:
    return [F.when(c.ref.isNotNull(), F.xxhash64(F.lit(s), c.ref)) for s in (1, 2)]


def _is_integral(c: Col) -> bool:
    return c.data_type in ("tinyint", "smallint", "int", "bigint")


def _entry(c: Col, prefix: bool) -> Column:
    """The column's key in the table: (a, b) for digests, a for whole numbers, num for other numbers."""
    a = b = _null("long")
    num = _null("double")
    if c.kind == "string":
        a, b = _digests(c)
    elif c.kind == "boolean" or _is_integral(c):
        a = c.ref.cast("long")
    elif c.kind == "datetime":
        a = ntz_micros(c.ref)
    else:
        num = c.ref.cast("double")
    start = first_bytes(c.ref) if prefix and c.kind == "string" else _null("long")
    return F.struct(F.lit(c.position).alias("position"), a.alias("a"), b.alias("b"), num.alias("num"), start.alias("start"))


def value_counts(df: DataFrame, prefix: bool = False) -> DataFrame:
    """(position, column, a, b, num, start, n) of all scalar columns; nulls are left out.

    ``num`` is the number of numeric columns, ``a`` and ``b`` digests of texts
    (``a`` alone whole numbers, booleans and microseconds). ``start`` is the
    order of a text's first bytes, with ``prefix``. Values that repeat collapse
    in the map tasks.
    """
    cols = [c for c in columns_of(df) if c.kind in SCALAR]
    if not cols:
        return df.sparkSession.createDataFrame([], "position int, column string, a long, b long, num double, start long, n long")
    names = F.create_map(*[x for c in cols for x in (F.lit(c.position), F.lit(c.name))])
    whole = F.array(*[F.lit(c.position) for c in cols if _is_integral(c)]).cast("array<int>")
    long = normalized(df).select(F.inline(F.array(*[_entry(c, prefix) for c in cols]))).filter("a is not null or num is not null")
    counted = long.groupBy("position", "a", "b", "num").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n"))
    num = F.when(F.array_contains(whole, F.col("position")), F.col("a").cast("double")).otherwise(F.col("num"))
    return counted.select("position", names[F.col("position")].alias("column"), "a", "b", num.alias("num"), "start", "n")


# --------------------------------------------------------------- Misra-Gries

def merged(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, lower bounds, error added) of a summary from counters that may repeat keys.

    The counters beyond ``capacity`` go, and the largest of them is taken off the others.
    """
    keys, back = np.unique(keys, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, back, counts)
    if len(keys) <= capacity:
        return keys, total, 0
    order = np.argsort(-total, kind="stable")
    error = int(total[order[capacity]])
    kept = order[:capacity][total[order[:capacity]] > error]
    return keys[kept], total[kept] - error, error


def _summaries(positions: list[int], capacity: int):
    def run(batches):
        from pyspark import TaskContext

        state = {p: (np.zeros(0, np.int64), np.zeros(0, np.int64), 0) for p in positions}
        for batch in batches:
            for i, p in enumerate(positions):
                keys, counts, error = state[p]
                found, n = np.unique(batch.column(i).drop_null().to_numpy(), return_counts=True)
                keys, counts, more = merged(np.concatenate([keys, found]), np.concatenate([counts, n]), capacity)
                state[p] = keys, counts, error + more
        yield _summary_rows([(p, TaskContext.get().partitionId(), *state[p]) for p in positions])

    return run


def _summary_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["position", "part", "keys", "counts", "error"])


def _merge_group(capacity: int):
    def run(found: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate([np.asarray(x, np.int64) for x in found.column(c).to_pylist()]) for c in ("keys", "counts"))
        keys, counts, error = merged(keys, counts, capacity)
        first = found.slice(0, 1).to_pylist()[0]
        return pa.Table.from_batches([_summary_rows([(first["position"], first["part"] // ARITY, keys, counts, error + sum(found.column("error").to_pylist()))])])

    return run


def heavy_hitters(df: DataFrame, columns: list[Col], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """position -> (digests, lower bounds of their counts, error): a count is at most its lower bound plus the error.

    A value that is not listed occurs at most ``error`` times. One row per column reaches the driver.
    """
    if not columns:
        return {}
    digests = normalized(df).select(*[_digests(c)[0].alias(f"h{c.position}") for c in columns])
    found = digests.mapInArrow(_summaries([c.position for c in columns], capacity), _SUMMARY)
    parts = digests.rdd.getNumPartitions()
    while parts > 1:
        found = found.groupBy("position", F.floor(F.col("part") / ARITY).alias("node")).applyInArrow(_merge_group(capacity), _SUMMARY)
        parts = -(-parts // ARITY)
    return {r.position: (np.array(r["keys"], np.int64), np.array(r["counts"], np.int64), r.error) for r in found.collect()}


def separated(counts: np.ndarray, error: int, k: int) -> np.ndarray | None:
    """Which digests of a summary can be among the first k, or None if others can be too."""
    if error == 0 and len(counts) <= k:
        return np.ones(len(counts), bool)
    if len(counts) < k:
        return None
    bound = int(np.sort(counts)[-k])
    return counts + error >= bound if error < bound else None


# ------------------------------------------------------------------ top values

def _values(df: DataFrame, columns: list[Col], wanted: DataFrame, few: bool, keys: list[str]) -> DataFrame:
    """(position, value, n) of the values of ``columns`` whose digests are ``wanted``: only these are shuffled."""
    entries = [F.struct(F.lit(c.position).alias("position"), *[h.alias(k) for h, k in zip(_digests(c), ("a", "b"))], c.ref.alias("value")) for c in columns]
    long = normalized(df).select(F.inline(F.array(*entries))).filter("value is not null")
    met = long.join(F.broadcast(wanted) if few else wanted, keys, "left_semi")
    return met.groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))


def _first(ranked: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each position; Spark cuts each task's rows down before the shuffle."""
    w = Window.partitionBy("position").orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_texts(df: DataFrame, columns: list[Col], k: int, counts: DataFrame | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(position, value, n, rank) of the k most frequent values of text columns, smaller value first among equals.

    With ``counts`` (a written ``value_counts`` table with ``prefix``) no summary is made.
    """
    spark: SparkSession = df.sparkSession
    schema = "position int, value string, n long, rank int"
    if not columns:
        return spark.createDataFrame([], schema)
    parts, left = [], columns
    if counts is None:
        found = {p: (keys, separated(n, error, k)) for p, (keys, n, error) in heavy_hitters(df, columns, capacity).items()}
        clear = [c for c in columns if found[c.position][1] is not None]
        left = [c for c in columns if found[c.position][1] is None]
        if clear:
            listed = [(c.position, int(h)) for c in clear for h in found[c.position][0][found[c.position][1]]]  # at most ``capacity`` a column
            wanted = spark.createDataFrame(listed, "position int, a long")
            parts.append(_values(df, clear, wanted, True, ["position", "a"]))
    if left:
        if counts is None:
            counts = cut_lineage(value_counts(df.select(*[c.ref for c in left]), prefix=True))
            order = {i: c.position for i, c in enumerate(left)}
            back = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
            counts = counts.withColumn("position", back[F.col("position")])
        mine = counts.filter(F.col("position").isin([c.position for c in left]))
        last = _first(mine.select("position", "n", "start"), k, F.desc("n"), F.col("start")).groupBy("position").agg(F.max(F.struct(-F.col("n"), F.col("start"))).alias("last"))
        wanted = mine.join(F.broadcast(last), "position").filter(F.struct(-F.col("n"), F.col("start")) <= F.col("last")).select("position", "a", "b")
        parts.append(_values(df, left, wanted, wanted.limit(FEW + 1).count() <= FEW, ["position", "a", "b"]))
    values = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return _first(values, k, F.desc("n"), F.col("value")).select("position", "value", "n", "rank")
