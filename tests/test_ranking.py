"""Distributed running totals and rank lookups against brute force."""

from pyspark.sql import functions as F

from facsimile.operators.ranking import lookup_by_rank, running_totals


def test_running_totals_brute_force(spark):
    rows = [(g, v, 1 + (v * 7) % 5) for g in range(3) for v in range(200)]
    rows += [(0, 1000, 100000)]  # one hot value
    df = spark.createDataFrame(rows, "g int, v int, w int")
    out = running_totals(df, ["v"], weight=F.col("w"), group_cols=["g"], num_partitions=7).collect()
    got = {(r.g, r.v): (r.rank_start, r.rank_end) for r in out}
    for g in range(3):
        acc = 0
        for _, v, w in sorted(r for r in rows if r[0] == g):
            assert got[(g, v)] == (acc, acc + w)
            acc += w


def test_lookup_by_rank(spark):
    iv = spark.createDataFrame([("a", 0, 5), ("b", 5, 6), ("c", 6, 100)], "value string, rank_start long, rank_end long")
    pos = spark.createDataFrame([(i, p) for i, p in enumerate([0, 4, 5, 6, 99])], "id long, pos long")
    got = {r.id: r.value for r in lookup_by_rank(iv, pos, "pos", bucket_width=3).collect()}
    assert got == {0: "a", 1: "a", 2: "b", 3: "c", 4: "c"}
