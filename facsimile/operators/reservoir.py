"""A fixed-size sample by keyed draws, as a mergeable bottom-n summary.

Every row has a keyed uniform; the sample is the n rows with the smallest draws.
A task keeps n rows of what it reads, and such summaries merge (the n smallest
of both) over a tree of ``ARITY`` a node, so no task ever holds more than
``ARITY`` x n rows, whatever the size of the table. Equal draws are told apart
by the value's text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARITY = 32


def _smallest(found: pa.Table, n: int) -> pa.Table:
    return found.take(pc.sort_indices(found, [("u", "ascending"), ("value", "ascending")])[:n]) if found.num_rows > n else found


def _bottom(n: int):
    def run(batches):
        from pyspark import TaskContext

        kept = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            if kept is not None and kept.num_rows >= n:  # most rows end here
                new = new.filter(pc.less_equal(new["u"], pc.max(kept["u"])))
            kept = _smallest(new if kept is None else pa.concat_tables([kept, new]), n)
        if kept is not None:
            part = pa.array(np.full(kept.num_rows, TaskContext.get().partitionId()), pa.int64())
            yield from kept.combine_chunks().append_column("part", part).to_batches()

    return run


def _merge(n: int):
    def run(found: pa.Table) -> pa.Table:
        part = found["part"][0].as_py() // ARITY
        kept = _smallest(found.drop_columns(["part"]), n)
        return kept.append_column("part", pa.array(np.full(kept.num_rows, part), pa.int64()))

    return run


def reservoir(df: DataFrame, value: Column, draw: Column, n: int) -> DataFrame:
    """(rank, value) of the ``n`` values that are there with the smallest draws, rank from 1."""
    rows = df.select(draw.cast("double").alias("u"), value.cast("string").alias("value")).filter("value is not null and u is not null")
    parts = rows.rdd.getNumPartitions()
    found = rows.mapInArrow(_bottom(n), "u double, value string, part bigint")
    while parts > 1:
        found = found.groupBy(F.floor(F.col("part") / ARITY).alias("node")).applyInArrow(_merge(n), "u double, value string, part bigint")
        parts = -(-parts // ARITY)
    order = Window.partitionBy(F.lit(0)).orderBy("u", "value")  # at most n rows
    return found.select(F.row_number().over(order).alias("rank"), "value")
