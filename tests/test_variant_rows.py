"""Nested values as rows against a plain walk."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tillwright.functions.variant_rows import value_rows


def leaves(value, path=""):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, value


def shown(value) -> tuple:
    if isinstance(value, bool):
        return str(value).lower(), None
    if isinstance(value, (int, float)):
        return None, float(value)
    return (value, None) if isinstance(value, str) else (None, None)


def test_every_leaf_is_a_row(spark):
    values = [
        {"a": 1, "b": {"c": [1.5, None, "x", True, {"d": [[], {}, [None], [[2]]]}]}, "e": None, "f": "", "g": -12345678901234},
        {}, [], [1, [2, {"k": "v"}]], "text", 7, None, [None, None], {"deep": {"er": {"still": {"more": ["1"]}}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(90, None), (91, "{broken")], "id int, doc string")
    got = sorted(((r["id"], r["path"], r["text"], r["number"]) for r in value_rows(df, F.col("doc"), "id").collect()), key=repr)
    want = sorted(((i, path, *shown(v)) for i, value in enumerate(values) for path, v in leaves(value)), key=repr)
    assert got == want


def test_structs_and_maps(spark):
    df = spark.createDataFrame([(1, (2, ["x"]), {"m": 1.5})], "id int, s struct<a:int,b:array<string>>, m map<string,double>")
    rows = value_rows(df, F.struct("s", "m"), "id").collect()
    assert sorted((r["path"], r["text"], r["number"]) for r in rows) == [("m.m", None, 1.5), ("s.a", None, 2.0), ("s.b[0]", "x", None)]
    assert value_rows(df.limit(0), F.col("s"), "id").count() == 0
