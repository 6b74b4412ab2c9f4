"""A vault that is kept: a catalog table of pairs, bucketed by token, that grows.

The pairs of a run that the vault does not hold are appended; a run on a part
and then on the whole gives the vault of the whole. The table is bucketed and
sorted by token, so look-ups and appends bring the new rows to the vault's
buckets and never shuffle the vault itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.operators.mask import DEFAULT_TYPE, token_vault
from facsimile.session import cut_lineage

BUCKETS = 64


class KeptVault:
    """``name`` is a catalog table (data_type, value, token); ``location`` its folder when it is first made."""

    def __init__(self, spark: SparkSession, name: str, location: str | None = None, buckets: int = BUCKETS):
        self.spark, self.name, self.location, self.buckets = spark, name, location, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _missing(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the vault does not hold. Only the token is a join key, so the vault's buckets are used as they are."""
        new, old = pairs.alias("n"), self.table().alias("o")
        same = (F.col("n.value") <= F.col("o.value")) & (F.col("n.value") >= F.col("o.value")) & (F.col("n.data_type") <= F.col("o.data_type")) & (F.col("n.data_type") >= F.col("o.data_type"))
        return new.join(old, (F.col("n.token") == F.col("o.token")) & same, "left_anti")

    def add(self, df: DataFrame, column_types: dict[str, str], secret_key: str, columns: list[str] | None = None) -> None:
        """Add the pairs of ``df`` that are new, each once."""
        pairs = token_vault(df, column_types, secret_key, columns)
        if self.exists():
            # Written before the append, which must not read the table that it writes.
            pairs = cut_lineage(self._missing(pairs))
        w = pairs.repartition(self.buckets, "token").write.format("parquet").bucketBy(self.buckets, "token").sortBy("token")
        if self.location and not self.exists():
            w = w.option("path", self.location)
        w.mode("append").saveAsTable(self.name)

    def detokenize(self, df: DataFrame, column_types: dict[str, str], columns: list[str] | None = None) -> DataFrame:
        """Tokens back to values as ``mask.detokenize`` gives them; the vault is read in its buckets."""
        out = df
        for c in [c for c in (columns or list(column_types)) if c in df.columns]:
            mine = self.table().filter(F.col("data_type") == column_types.get(c, DEFAULT_TYPE))
            known = mine.groupBy("token").agg(F.min("value").alias("_orig"), (F.count(F.lit(1)) > 1).alias("_amb")).withColumnRenamed("token", "_tok")
            # A null has no partner: each gets a text of its own that no token equals, and so a task of its own.
            text = F.col(f"`{c}`").cast("string")
            keyed = out.withColumn("_key", F.coalesce(text, F.concat(F.lit("\x00null "), F.monotonically_increasing_id())))
            joined = keyed.join(known, F.col("_key") == F.col("_tok"), "left")
            out = joined.withColumn(c, F.coalesce("_orig", text)).withColumn(f"{c}_ambiguous", F.coalesce("_amb", F.lit(False))).drop("_key", "_tok", "_orig", "_amb")
        return out
