"""A kept vault grows by new pairs only and is never shuffled; modes of the table sink."""

import uuid

import pytest
from pyspark.sql import functions as F

from facsimile.operators import mask as M
from facsimile.operators.vault import KeptVault
from facsimile.sources import io

KEY = "fixture-key-0001"
KINDS = {"name": "name", "mail": "email", "ref": "alphanumeric"}


@pytest.fixture()
def people(spark):
    rows = [(i, f"Person {i % 40}", f"p{i % 25}@example.com", None if i % 4 == 0 else f"R{i % 60:03d}") for i in range(120)]
    return spark.createDataFrame(rows, "k int, name string, mail string, ref string")


@pytest.fixture()
def named(spark):
    made = []

    def make():
        made.append(f"kept_{uuid.uuid4().hex[:12]}")
        return made[-1]

    yield make
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_two_runs_equal_one_on_the_union(spark, people, named, tmp_path):
    vault = KeptVault(spark, named(), f"{tmp_path}/vault", buckets=8)
    vault.add(people.filter("k < 50"), KINDS, KEY)
    vault.add(people.filter("k >= 30"), KINDS, KEY)
    assert rows_of(vault.table()) == rows_of(M.token_vault(people, KINDS, KEY))
    before = vault.table().count()
    vault.add(people, KINDS, KEY)
    assert vault.table().count() == before
    masked = M.tokenize(people, KINDS, KEY)
    assert rows_of(vault.detokenize(masked, KINDS)) == rows_of(M.detokenize(masked, KINDS, M.token_vault(people, KINDS, KEY)))
    other = spark.createDataFrame([("unknown",), (None,)], "name string")
    assert rows_of(vault.detokenize(other, KINDS)) == [("unknown", False), (None, False)]


def test_the_vault_is_not_shuffled(spark, people, named, tmp_path):
    vault = KeptVault(spark, named(), f"{tmp_path}/vault", buckets=8)
    vault.add(people, KINDS, KEY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (vault._missing(M.token_vault(people, KINDS, KEY)), vault.detokenize(people.select("name"), KINDS)):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            lines = plan.splitlines()
            depth = lambda line: len(line) - len(line.lstrip(" :+-"))
            at = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "data_type" in line)
            indent, above = depth(lines[at]), []
            for line in reversed(lines[:at]):  # the nodes above the scan, up to the join
                if depth(line) < indent:
                    indent = depth(line)
                    above.append(line)
                    if "Join" in line:
                        break
            assert "Join" in above[-1] and not any("Exchange" in line for line in above), plan
            assert "Bucketed: true" in lines[at]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_modes_of_the_sink(spark, people, named, tmp_path):
    name = named()
    info = io.write_table(people, name, mode="create", location=f"{tmp_path}/t", partition_by=["k"])
    assert info["rows_written"] == 120 and info["partition_by"] == ["k"]
    with pytest.raises(Exception):
        io.write_table(people, name, mode="create")
    with pytest.raises(ValueError):
        io.write_table(people, name, mode="merge")
    changed = people.filter("k < 3").withColumn("name", F.lit("changed"))
    info = io.write_table(changed.select("k", "ref", "mail", "name"), name, mode="overwrite_partitions")
    assert info["rows_written"] == 3
    got = spark.table(name).select(*people.columns)
    assert rows_of(got) == rows_of(changed.union(people.filter("k >= 3")))
    io.write_table(people.limit(0), name, mode="overwrite_partitions")
    assert spark.table(name).count() == 120
    io.write_table(people.filter("k = 5"), name, mode="append", partition_by=["k"], location=f"{tmp_path}/t")
    assert spark.table(name).count() == 121
    io.write_table(people.select("name"), name, mode="overwrite", location=f"{tmp_path}/t")
    assert rows_of(spark.table(name)) == rows_of(people.select("name"))
