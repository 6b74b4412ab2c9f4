"""JSON rows of nested values."""

import datetime
import json

from facsimile.functions import format as FM


def test_nested_nan_becomes_null(spark):
    nan, inf = float("nan"), float("inf")
    schema = "a array<double>, s struct<x:float,y:array<struct<z:double,n:int>>>, m map<string,double>, d double, t struct<at:timestamp>, i array<int>, `p.q` struct<`u v`:double>"
    rows = [
        ([1.5, nan, None, -inf], (nan, [(inf, 1), None, (2.0, None)]), {"k": nan, "l": 3.0}, nan, (datetime.datetime(2024, 1, 2, 3, 4, 5),), [1, None], (nan,)),
        (None, None, None, None, None, None, None),
    ]
    got = [json.loads(r.json) for r in FM.json_safe(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == {
        "a": [1.5, None, None, None], "s": {"x": None, "y": [{"z": None, "n": 1}, None, {"z": 2.0, "n": None}]}, "m": {"k": None, "l": 3.0}, "d": None,
        "t": {"at": "2024-01-02T03:04:05.000000"}, "i": [1, None], "p.q": {"u v": None},
    }
    assert set(got[1].values()) == {None} and set(got[1]) == set(got[0])
