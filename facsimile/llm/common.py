"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.session import checkpoint_dir

# Fixed value: the ASCII white space that separates words.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder and read back (lineage is cut)."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is never inlined by the optimizer, while a projected
    column may be copied into every place that uses it.
    """
    return F.transform(F.array(value), body).getItem(0)


def text_of(column: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between ASCII white space, in order, as an array."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
