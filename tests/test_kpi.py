from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillwright.operators import kpi, segments
from tillwright.operators.cleaning import clean_transactions


def test_revenue_and_order_value(spark):
    tx = spark.createDataFrame([("10001", 100.0), ("10001", 200.0), ("10002", 50.0)], "invoice string, revenue double")
    assert kpi.total_revenue(tx).first()[0] == 350.0
    assert kpi.average_order_value(tx).first()[0] == 175.0
    nothing = tx.filter("false")
    assert kpi.total_revenue(nothing).first()[0] == 0 and kpi.average_order_value(nothing).first()[0] == 0


def test_growth(spark):
    pairs = spark.createDataFrame([(1, 120.0, 100.0), (2, 80.0, 100.0), (3, 100.0, 100.0), (4, 100.0, 0.0)], "i int, c double, p double")
    got = [r["growth_pct"] for r in kpi.growth(pairs, "c", "p").orderBy("i").collect()]
    assert got[:3] == pytest.approx([20, -20, 0]) and got[3] is None


def test_two_unit_definitions(make_raw):
    tx = clean_transactions(make_raw([
        ("1", "A", "a", 10, "2011-01-01 09:00", 1.0, 1, "UK"),
        ("2", "A", "a", -4, "2011-01-01 10:00", 1.0, 1, "UK"),
        ("3", "A", "a", -2, "2011-01-02 10:00", 1.0, None, "UK"),
        ("4", "A", "a", 5, None, 1.0, 2, "UK"),
    ]))
    daily = {str(r["date"]): r for r in kpi.daily_metrics(tx).collect()}
    assert (daily["2011-01-01"]["units_sold"], daily["2011-01-01"]["orders"], daily["2011-01-01"]["customers"]) == (6, 2, 1)
    assert (daily["2011-01-02"]["units_sold"], daily["2011-01-02"]["customers"]) == (-2, 0) and len(daily) == 2
    month = kpi.monthly_metrics(tx).collect()
    assert [(r["month"], r["units_sold"]) for r in month] == [("2011-01", 10)]
    assert kpi.dataset_summary(tx).first()["total_units_sold"] == 9
    assert kpi.analytics_kpis(tx).first()["units_sold"] == 4


def test_customer_metrics(four_lines):
    row = kpi.customer_metrics(four_lines).first()
    assert (row["total_customers"], row["new_customers"], row["repeat_customers"]) == (2, 0, 2)
    assert row["repeat_customer_rate"] == 100 and row["revenue_per_customer"] == 300
    nobody = kpi.customer_metrics(four_lines.filter("false")).first()
    assert nobody["total_customers"] == 0 and nobody["repeat_customer_rate"] == 0


def test_ties_and_null_members_have_a_fixed_order(make_raw):
    tx = clean_transactions(make_raw([
        ("1", "B", None, 1, "2011-01-01 09:00", 5.0, 1, "UK"),
        ("2", "B", "b", 1, "2011-01-01 09:00", 5.0, 1, "UK"),
        ("3", "A", "a", 1, "2011-01-01 09:00", 5.0, 1, "UK"),
    ]))
    order = [(r["stock_code"], r["description"]) for r in kpi.top_products(tx).collect()]
    assert order == [("A", "a"), ("B", "b"), ("B", None)]
    both = kpi.product_metrics(tx, 2)
    assert both["top_products_by_units"].count() == 2


def test_monthly_growth_over_an_empty_month_is_null(spark):
    monthly = spark.createDataFrame([("2011-01", 0.0), ("2011-02", 5.0), ("2011-03", 10.0)], "month string, revenue double")
    assert [r["growth_pct"] for r in kpi.with_growth(monthly).orderBy("month").collect()] == [None, None, 100.0]


def test_expected_revenue_and_day_over_day(series):
    daily = series([10, 20, 0, 5, -5])
    expected = [r["expected"] for r in kpi.expected_revenue(daily, 2).orderBy("date").collect()]
    assert expected == [10, 10, 15, 10, 2.5]
    change = [r["change_pct"] for r in kpi.day_over_day(daily).orderBy("date").collect()]
    assert change == [None, 100.0, -100.0, None, -200.0]
    assert [r["label"] for r in kpi.trailing_days(kpi.expected_revenue(daily), 2).collect()] == ["04 Jan", "05 Jan"]


def test_new_customers_by_month(make_raw):
    tx = clean_transactions(make_raw([
        ("1", "A", "a", 1, "2011-01-31 23:00", 1.0, 1, "UK"),
        ("2", "A", "a", 1, "2011-02-01 00:00", 1.0, 1, "UK"),
        ("3", "A", "a", 1, "2011-02-10 00:00", 1.0, 2, "UK"),
    ]))
    mix = {r["month"]: (r["new_customers"], r["repeat_customers"], r["repeat_customer_pct"]) for r in segments.monthly_customer_mix(tx).collect()}
    assert mix == {"2011-01": (1, 0, 0.0), "2011-02": (1, 1, 50.0)}
    labels = {r["invoice"]: r["customer_type"] for r in segments.new_vs_repeat(tx).collect()}
    assert labels == {"1": "New", "2": "Repeat", "3": "New"}


def test_best_worst_ties_go_to_the_smallest_key(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("d", 1.0), ("c", 1.0), ("e", None)], "k string, v double")
    assert {r["kind"]: r["member"] for r in segments.best_worst(df, "k", "v").collect()} == {"best": "a", "worst": "c"}


def test_series_keys_do_not_mix(four_lines):
    daily = kpi.daily_metrics(four_lines, ("country",))
    assert daily.filter(F.col("country") == "Germany").count() == 2 and daily.count() == 3
