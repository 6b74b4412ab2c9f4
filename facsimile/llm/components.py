"""Connected components of a link table, as joins and aggregations.

Alternating large-star and small-star rounds: every node points all its
larger (then its smaller) neighbours at the smallest neighbour, until the
links form stars. Each star step is one aggregation (smallest neighbour, with
partial sums in the map tasks) and one join; the minima and the links are
written tables, so both join sides are plain exchanges which adaptive
execution can split when one centre holds most links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import written


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (two bigint columns ``a``, ``b``).

    ``root`` is the smallest node of the component. Links of a node to itself
    and repeated links are allowed; nodes without a link to another node are
    absent. An empty table gives an empty table. Raises if ``max_rounds``
    rounds do not suffice (each round about halves the longest path).
    """
    links = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _signature(links)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        wide = written(_large_star(links).distinct(), "links")
        links = written(_small_star(wide).distinct(), "links")
        before, state = state, _signature(links)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
