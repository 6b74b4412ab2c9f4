"""Global running totals and rank lookups without a single-task sort.

A ``row_number()`` or running ``sum()`` over a window with no partition key
puts the whole table into one task. Here the order is split across tasks:

1. range-partition on (group, order) so every task holds one contiguous,
   sorted slice of the global order;
2. a windowed running sum inside each (task slice, group) -- bounded by the
   slice size;
3. per-slice totals (one row per slice and group) give each slice its
   offset; Catalyst picks the join by the measured size of that table, since
   the number of groups has no bound.

The sliced table is written to the shared folder before steps 2 and 3 read
it. The bounds of a range split are sampled anew by every shuffle, so two
readers that split for themselves would not see the same slices.

``lookup_by_rank`` then maps integer positions onto the ``[start, end)``
intervals with an equi-join on a position bucket, so a hot interval (one
value holding a third of all rows) spreads over many buckets instead of
landing in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.session import cut_lineage, shuffle_partitions


def running_totals(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    weight: Column | None = None,
    group_cols: Sequence[str] = (),
    start: str = "rank_start",
    end: str = "rank_end",
    num_partitions: int | None = None,
    weight_type: str = "long",
) -> DataFrame:
    """Add ``start`` (exclusive running total) and ``end`` (inclusive).

    ``weight`` defaults to 1 per row, which makes ``start`` a 0-based row
    index in the order. Totals restart for every value of ``group_cols``.
    The order must be total within a group for the result to be
    deterministic; rows tied on every order column get adjacent positions.
    """
    spark = df.sparkSession
    parts = num_partitions or shuffle_partitions(spark)
    w = (weight if weight is not None else F.lit(1)).cast(weight_type)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    groups = list(group_cols)

    # The sliced table is read twice (running sums, slice totals). Written
    # once to the shared checkpoint folder, its upstream (typically a
    # frequency aggregation over the whole source) runs once, and the slice
    # ids stay fixed even if an executor is lost and work is redone.
    ranged = cut_lineage(
        df.withColumn("_w", w)
        .repartitionByRange(parts, *[F.col(g) for g in groups], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    local_win = (
        Window.partitionBy("_slice", *groups)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.withColumn("_local", F.sum("_w").over(local_win))

    totals = ranged.groupBy("_slice", *groups).agg(F.sum("_w").alias("_tot"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_slice", *groups, F.coalesce(F.sum("_tot").over(before), F.lit(0)).cast(weight_type).alias("_off")
    )
    out = local.join(offsets, ["_slice", *groups])
    out = out.withColumn(end, (F.col("_off") + F.col("_local")).cast(weight_type))
    out = out.withColumn(start, (F.col(end) - F.col("_w")).cast(weight_type))
    return out.drop("_w", "_slice", "_local", "_off")


def lookup_by_rank(
    intervals: DataFrame,
    positions: DataFrame,
    pos_col: str,
    start: str = "rank_start",
    end: str = "rank_end",
    group_cols: Sequence[str] = (),
    bucket_width: int | str = 1,
) -> DataFrame:
    """Join each position to the interval ``start <= pos < end`` of its group.

    ``bucket_width`` is a positive literal or the name of a column present on
    both sides (e.g. a per-group width = group total / interval count). Each
    interval is copied once per bucket it covers, so the copies number at most
    intervals + total/width, and the expected number of candidate intervals
    per position stays O(1) with the per-group width.
    """
    bw = F.col(bucket_width) if isinstance(bucket_width, str) else F.lit(int(bucket_width))
    iv = intervals.filter(F.col(end) > F.col(start))
    iv = iv.withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col(start) / bw).cast("long"), F.floor((F.col(end) - 1) / bw).cast("long"))),
    )
    pos = positions.withColumn("_bucket", F.floor(F.col(pos_col) / bw).cast("long"))
    keys = [*group_cols, "_bucket"] + ([bucket_width] if isinstance(bucket_width, str) else [])
    joined = pos.join(iv, keys).filter((F.col(pos_col) >= F.col(start)) & (F.col(pos_col) < F.col(end)))
    return joined.drop("_bucket")
