"""The daily rollup against plain aggregates."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tillwright.operators import cleaning, kpi, profile, rollup


@pytest.fixture(scope="module")
def lines(spark):
    """A day with a third of all lines, customers who come back, one invoice over two days, nulls in every member and date."""
    rows = spark.range(3_000).select(
        F.concat(F.lit("i"), (F.col("id") % 700).cast("string")).alias("invoice"),
        F.when(F.col("id") % 50 != 3, F.concat(F.lit("p"), (F.col("id") % 90).cast("string"))).alias("stock_code"),
        F.lit("thing").alias("description"), (F.col("id") % 7 - 1).alias("quantity"),
        F.when(F.col("id") % 101 != 5, F.timestamp_add("day", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).cast("int"),
                                                      F.lit("2011-01-20 10:00:00").cast("timestamp"))).alias("invoice_ts"),
        (F.col("id") % 13).cast("decimal(12,2)").alias("price"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 160).alias("customer_id"),
        F.when(F.col("id") % 29 != 0, F.concat(F.lit("c"), (F.col("id") % 5).cast("string"))).alias("country"),
    )
    return cleaning.add_revenue(rows.withColumn("invoice", F.when(F.col("invoice") != "i9", F.col("invoice"))))


def same(a, b) -> bool:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    plain = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    return plain(a) == plain(b)


def test_merged_counts_equal_distinct_counts(spark, lines, tmp_path):
    kept = rollup.write_rollup(lines, str(tmp_path / "rollup"))
    again = rollup.read_rollup(spark, str(tmp_path / "rollup"))
    assert same(rollup.daily_from(kept), kpi.daily_metrics(lines))
    assert same(rollup.monthly_from(again), kpi.monthly_metrics(lines))
    assert same(rollup.summary_from(kept), kpi.dataset_summary(lines))
    exact = profile.cardinality(lines)
    assert same(rollup.cardinality_from(kept, len(lines.columns)), exact)
    first, last = date(2011, 2, 1), date(2011, 3, 4)
    part = lines.filter(F.to_date("invoice_ts").between(F.lit(first), F.lit(last)))
    assert same(rollup.summary_from(rollup.within(kept, first, last)), kpi.dataset_summary(part))


def test_no_line_is_replicated(lines):
    for kind in rollup.KINDS:
        plan = rollup.day_members(lines, kind)._jdf.queryExecution().toString()
        assert "Expand" not in plan and "Generate" not in plan
    merged = rollup.daily_from(rollup.build_rollup(lines))._jdf.queryExecution().toString()
    assert "Expand" not in merged


def test_numbers_follow_the_first_day(lines):
    pairs = lines.select(F.to_date("invoice_ts").alias("date"), F.col("invoice").alias("member")).filter("member is not null").distinct()
    numbers = rollup.number_members(pairs).collect()
    first = {r["member"]: r["date"] for r in pairs.groupBy("member").agg(F.min("date").alias("date")).collect()}
    assert len({r["number"] for r in numbers}) == len(numbers) == len(first) and min(r["number"] for r in numbers) == 1
    known = [first[r["member"]] for r in sorted(numbers, key=lambda r: r["number"]) if first[r["member"]]]
    assert known == sorted(known)


def test_empty_rollup(lines):
    none = rollup.build_rollup(lines.limit(0))
    assert rollup.daily_from(none).count() == 0
    assert tuple(rollup.cardinality_from(none, 8).first()) == (0, 8, 0, 0, 0, 0)
    assert same(rollup.summary_from(none), kpi.dataset_summary(lines.limit(0)))


def test_sketches_merge_within_their_error(spark):
    many = spark.range(200_000).select(
        F.col("id").cast("string").alias("invoice"), (F.col("id") % 60_000).alias("customer_id"), F.lit(None).cast("string").alias("stock_code"),
        F.lit("x").alias("country"), F.timestamp_add("day", (F.col("id") % 50).cast("int"), F.lit("2011-01-01").cast("timestamp")).alias("invoice_ts"))
    row = rollup.approximate_cardinality(rollup.day_sketches(many), 5).first()
    assert (row["rows"], row["products"], row["countries"]) == (200_000, 0, 1)
    assert abs(row["invoices"] - 200_000) < 200_000 * 3 * 1.04 / 64 and abs(row["customers"] - 60_000) < 60_000 * 3 * 1.04 / 64


def test_uncleaned_lines_are_written_before_the_rollup_reads_them(spark, monkeypatch):
    """The rollup reads its lines once per kind and for the measures; the tables are joined once for all of them."""
    from tillwright.catalog import ENTRIES
    from tillwright.catalog import rollup as catalog

    given = []
    monkeypatch.setattr(catalog.rollup, "build_rollup", lambda lines: given.append(lines))
    monkeypatch.setattr(catalog.rollup, "cardinality_from", lambda built, columns: spark.sql(
        "select 1 rows, 1 columns, 1 invoices, 1 products, 1 customers, 1 countries"))
    ENTRIES["cardinality_from_rollup"].query(spark, "/root/testdata/sf0.001")
    assert given and not [f for f in given[0].inputFiles() if "lineitem" in f]


def test_members_are_shuffled_once(lines):
    """One row per member meets its days and is numbered there: lines and pairs are not shuffled again to be numbered."""
    pairs = lines.select(F.to_date("invoice_ts").alias("date"), F.col("customer_id").alias("member")).filter("member is not null")
    numbered = rollup.number_members(pairs)
    rows = numbered.collect()
    assert len(rows) == pairs.select("member").distinct().count()
    assert {(d, r["member"]) for r in rows for d in r["dates"]} == {tuple(r) for r in pairs.collect()}
    assert sum(len(r["dates"]) for r in rows) == pairs.distinct().count()
    plan = rollup._bitmaps(lines, "customers")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hash") == 2 and "Exchange range" not in plan
    assert "Sort [array_min(" in plan


def test_bitmaps_are_complete_in_every_task(spark, lines, tmp_path):
    """Members of many tasks, none of which share a bucket; every kind of key counts as the lines do."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        built = rollup.write_rollup(lines, str(tmp_path / "many"))
        assert built.members.filter("kind = 'invoices'").select("bucket").distinct().count() > 1
        assert same(rollup.daily_from(built), kpi.daily_metrics(lines))
        assert same(rollup.cardinality_from(built, len(lines.columns)), profile.cardinality(lines))
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
