"""facsimile: profile, mask and synthesize tables with Spark.

Every operator takes and returns Spark DataFrames. Only small, bounded
summaries (one row per column, one row per partition) ever reach the driver.
"""

from facsimile.session import get_spark, cut_lineage

__all__ = ["get_spark", "cut_lineage"]
