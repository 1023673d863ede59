"""Derived lines: what is shuffled, and the rows that the joins give."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tillwright.operators.cleaning import clean_transactions
from tillwright.operators.kpi import orders_by
from tillwright.sources import retail_tables
from tillwright.sources.retail_tables import raw_transactions

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not present")


@pytest.fixture
def large_plans(spark):
    """Plans as of tables that are too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_shuffled_for_the_joins_only(spark, large_plans):
    # Two sides each of four joins, and the lines dealt out if the file has fewer splits than there are cores.
    joins = _plan(raw_transactions(spark, FOLDER)).count("Exchange ")
    lines = clean_transactions(raw_transactions(spark, FOLDER))
    assert _plan(lines).count("Exchange ") == joins
    assert _plan(orders_by(lines, {"date": F.to_date("invoice_ts")})).count("Exchange ") == joins


def test_clean_lines_are_the_same_by_either_plan(spark, large_plans):
    lines = clean_transactions(raw_transactions(spark, FOLDER))
    total = F.sum(F.xxhash64(*lines.columns).cast("decimal(38,0)"))
    large = lines.agg(F.count(F.lit(1)), total).first()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert clean_transactions(raw_transactions(spark, FOLDER)).agg(F.count(F.lit(1)), total).first() == large


def test_partitions_follow_the_lines(spark, large_plans, monkeypatch):
    total = F.sum(F.xxhash64("invoice", "stock_code", "quantity", "price").cast("decimal(38,0)"))
    few = clean_transactions(raw_transactions(spark, FOLDER))
    monkeypatch.setattr(retail_tables, "LINES_PER_TASK", 200)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        many = clean_transactions(raw_transactions(spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    # Neither merged to a few large ones nor shuffled once more to find copies.
    assert _plan(many).count("Exchange ") == _plan(few).count("Exchange ")
    assert many.rdd.getNumPartitions() == 24 < spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 200
    assert many.agg(F.count(F.lit(1)), total).first() == few.agg(F.count(F.lit(1)), total).first()
