"""Pooled forecasts of many series."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwright.operators import forecast as f
from tillwright.operators import series_forecast as s
from tillwright.operators.cleaning import clean_transactions
from tillwright.operators.kpi import daily_metrics, daily_revenue

KEYS = ("country",)


@pytest.fixture(scope="module")
def rows(spark):
    """Weekly patterns at levels from 10 to 10 million, a series too short for a level, and one of zeros."""
    rng, days = np.random.default_rng(2), []
    for country, level, length in (("A", 10.0, 160), ("B", 1e7, 160), ("C", 3e3, 140), ("short", 50.0, 45), ("zero", 0.0, 120)):
        for i in range(length):
            revenue = float(level * (1 + 0.6 * ((i % 7) in (5, 6)) + 0.15 * rng.normal()))
            days.append((country, date(2020, 1, 1) + timedelta(i), revenue, 3, 2, 5, revenue / 3))
    daily = spark.createDataFrame(days, "country string, date date, revenue double, orders bigint, customers bigint, units_sold bigint, aov double")
    return f.feature_rows(daily, keys=KEYS).cache()


@pytest.fixture(scope="module")
def split(rows):
    return s.split_series(f.training_rows(rows), KEYS).cache()


@pytest.fixture(scope="module")
def model(split):
    return s.train_pooled(split, KEYS, rounds=15, depth=2)


def test_rows_of_a_series_of_revenue_alone(rows):
    known = rows.select("country", "date", "revenue")
    alone = f.feature_rows(known, keys=KEYS)
    assert not {"orders", "customers", "units_sold", "aov"} & set(alone.columns)
    order = ["country", "date"]
    assert alone.orderBy(order).collect() == rows.select(alone.columns).orderBy(order).collect()
    gap = known.filter("day(date) != 9")
    assert f.zero_fill(f.densify(gap, KEYS)).filter("day(date) = 9 and revenue = 0").count() == rows.filter("day(date) = 9").count()


def test_daily_revenue_per_series(make_raw):
    lines = clean_transactions(make_raw([
        ("1", "A", "a", 2, "2020-01-01 10:00", 3.0, 1, "UK"), ("2", "A", "a", 1, "2020-01-01 11:00", 3.0, 2, "UK"),
        ("3", "A", "a", 1, "2020-01-02 10:00", 5.0, 1, "DE"), ("4", "A", "a", 1, "2020-01-02 10:00", 7.0, 1, None), ("5", "A", "a", 1, None, 7.0, 1, "DE"),
    ]))
    got = sorted((r["country"], r["date"], r["revenue"]) for r in daily_revenue(lines, KEYS).collect())
    assert got == [("DE", date(2020, 1, 2), 5.0), ("UK", date(2020, 1, 1), 9.0)]
    assert got == sorted((r["country"], r["date"], r["revenue"]) for r in daily_metrics(lines, KEYS).collect())


def test_split_is_chronological_per_series(split):
    for r in split.groupBy("country").agg(F.max(F.when(F.col("is_train"), F.col("date"))).alias("a"), F.min(F.when(~F.col("is_train"), F.col("date"))).alias("b"),
                                          F.count_if("is_train").alias("n"), F.count(F.lit(1)).alias("all")).collect():
        assert r["a"] < r["b"] and r["n"] == r["all"] * 8 // 10


def test_levels_see_no_test_day(split, model):
    levels = {r["country"]: r["level"] for r in model.levels.collect()}
    assert set(levels) == {"A", "B", "C"}
    spoiled = split.withColumn(f.TARGET, F.when(F.col("is_train"), F.col(f.TARGET)).otherwise(F.lit(1e12)))
    assert {r["country"]: r["level"] for r in s.series_levels(spoiled, KEYS).collect()} == levels


def test_one_model_serves_all_levels(split, model):
    got = {r["country"]: r for r in s.evaluate_series(s.predict_series(model, split), KEYS).collect()}
    assert set(got) == {"A", "B", "C", "short", "zero"}
    # Few test days each: no series is much worse than the naive rule, whatever its level, and together they are better.
    ratios = [got[c]["mae"] / got[c]["naive_mae"] for c in "ABC"]
    assert max(ratios) < 1.2 and sum(ratios) < 3 and all(got[c]["rmse"] >= got[c]["mae"] for c in "ABC")
    assert got["short"]["mae"] == pytest.approx(got["short"]["naive_mae"]) and got["zero"]["mae"] == 0


def test_forecast_of_every_series(rows, split, model):
    future = {r["country"]: r for r in s.forecast_series(model, rows, "future").collect()}
    reference = {r["country"]: r for r in s.forecast_series(model, rows).collect()}
    assert set(future) == set(reference) == {"A", "B", "C", "short", "zero"}
    assert all(future[c]["based_on_date"] == reference[c]["based_on_date"] + timedelta(7) for c in future)
    assert 5 * 10 < future["A"][f.TARGET] < 12 * 10 and 5e7 < future["B"][f.TARGET] < 12e7
    with pytest.raises(ValueError):
        s.forecast_series(model, rows, "past")
    history = s.history_of_series(s.predict_series(model, split), KEYS, 4)
    assert {(r["country"], r["n"]) for r in history.groupBy("country").agg(F.count(F.lit(1)).alias("n")).collect()} >= {("A", 4), ("B", 4)}
