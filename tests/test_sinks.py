from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tillwright.functions.json_safe import json_safe, json_text
from tillwright.sources import star
from tillwright.sources.transactions import load_audit, manifest_upsert


def test_non_finite_numbers_become_null_at_any_depth(spark):
    df = spark.createDataFrame(
        [(1.5, float("nan"), [float("inf"), 2.0], {"a": float("-inf")}, (float("nan"), "x"), datetime(2011, 12, 9, 1, 2, 3))],
        "a double, b double, c array<double>, d map<string,double>, e struct<f:double,g:string>, t timestamp",
    )
    row = json.loads(json_text(df).first()["json"])
    assert row == {"a": 1.5, "b": None, "c": [None, 2.0], "d": {"a": None}, "e": {"f": None, "g": "x"}, "t": "2011-12-09T01:02:03"}
    assert json_safe(df).first()["e"]["f"] is None


def test_star_and_reconciliation(spark, four_lines, tmp_path):
    tables = star.star_tables(four_lines)
    star.write_star(tables, path=str(tmp_path / "star"))
    stored = {name: spark.read.parquet(str(tmp_path / "star" / name)) for name in tables}
    counts = {r["table_name"]: (r["row_count"], r["revenue"]) for r in star.reconcile(stored).collect()}
    assert counts == {"customers": (2, None), "products": (2, None), "transactions": (4, 600.0), "daily_metrics": (2, None)}
    with pytest.raises(ValueError):
        star.write_star(tables)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_customer_scores_are_written(spark, four_lines, tmp_path, fmt):
    from tillwright.operators.rfm import rfm_table
    from tillwright.sources.transactions import write_clean, write_table

    write_table(rfm_table(four_lines), str(tmp_path / "deep" / "rfm"), fmt)
    back = spark.read.format(fmt).option("header", True).load(str(tmp_path / "deep" / "rfm"))
    assert back.count() == 2 and "segment" in back.columns
    write_clean(four_lines, str(tmp_path / "clean"), fmt)
    assert spark.read.format(fmt).option("header", True).load(str(tmp_path / "clean")).count() == 4


def test_audit_counts_each_stage(make_raw):
    row = ("1", "A", "a", 1, "2011-01-01 09:00", 2.0, 1, "UK")
    audit = load_audit(make_raw([row, row, ("C2", *row[1:])])).first()
    assert (audit["raw_rows"], audit["deduped_rows"], audit["output_rows"], audit["total_revenue"]) == (3, 2, 1, 2.0)


def test_manifest_keeps_the_new_entry(spark):
    a, b_ = "0" * 31 + "A", "f" * 32
    schema = "dataset_id string, filename string, created_at string"
    old = spark.createDataFrame([(a, "old", "2030"), (b_, "kept", "2020"), ("short", "bad", "2025")], schema)
    new = spark.createDataFrame([(a, "new", "2021")], schema)
    assert [(r["dataset_id"], r["filename"]) for r in manifest_upsert(old, new).collect()] == [(a, "new"), (b_, "kept")]


def test_fact_fills(spark, four_lines):
    holes = four_lines.withColumns({"description": F.lit(None).cast("string"), "country": F.lit(None).cast("string"),
                                    "quantity": F.lit(None).cast("bigint")})
    row = star.transactions_fact(holes).first()
    assert (row["description"], row["country"], row["quantity"]) == ("", "Unspecified", 0)
