from __future__ import annotations

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tillwright.operators import anomaly, isolation
from tillwright.operators.significance import compare_anomaly_period, student_t_two_sided_p


def test_window_must_be_full(series):
    rows = anomaly.detect(series([1000 + (i % 3) for i in range(32)])).orderBy("date").collect()
    assert all(r["z_score"] is None and not r["is_anomaly"] and r["severity"] == "NORMAL" for r in rows[:30])
    assert rows[30]["rolling_mean_30"] == pytest.approx(1001) and rows[30]["z_score"] is not None


def test_baseline_counts_present_days_not_calendar_days(series):
    gapped = [1000 + (i % 2) if i % 4 else None for i in range(60)]
    rows = anomaly.baseline(series(gapped)).orderBy("date").collect()
    assert [r["z_score"] is None for r in rows[:31]] == [True] * 30 + [False]


def test_constant_baseline(series):
    rows = anomaly.detect(series([100] * 31 + [150])).orderBy("date").collect()
    assert rows[30]["z_score"] is None and not rows[30]["is_anomaly"]
    spike = anomaly.detect(series([100] * 30 + [150])).orderBy(F.desc("date")).first()
    assert spike["z_score"] == math.inf and spike["is_anomaly"] and spike["severity"] == "CRITICAL"
    dip = anomaly.detect(series([100] * 30 + [50])).orderBy(F.desc("date")).first()
    assert dip["z_score"] == -math.inf and dip["revenue_deviation_pct"] == -50


def test_severity_steps(spark):
    scores = [None, 0.0, -1.99, 2.0, -2.99, 3.0, 3.99, -4.0]
    df = spark.createDataFrame([(i, z) for i, z in enumerate(scores)], "i int, z_score double")
    got = [r["severity"] for r in anomaly.severity(df).orderBy("i").collect()]
    assert got == ["NORMAL"] * 3 + ["MEDIUM"] * 2 + ["HIGH"] * 2 + ["CRITICAL"]


def test_most_critical_and_listing(series):
    values = [100 + (i % 5) for i in range(40)]
    values[35], values[38] = 300, 400
    found = anomaly.detect(series(values))
    assert anomaly.most_critical_day(found).first()["date"] == date(2020, 1, 1) + timedelta(35)
    assert anomaly.list_anomalies(found, "CRITICAL", "severity").count() >= 1
    with pytest.raises(ValueError):
        anomaly.list_anomalies(found, order="size")


def test_spike_against_constant_month_is_significant(series, spark):
    daily = series([1000] * 30 + [10000])
    day = spark.createDataFrame([(date(2020, 1, 31),)], "date date")
    row = compare_anomaly_period(daily, day).first()
    assert row["is_significant"] and row["anomaly_revenue"] == 10000 and row["p_value"] < 0.05
    assert row["t_statistic"] == -math.inf


def test_short_and_missing_baselines(series, spark):
    days = spark.createDataFrame([(date(2020, 1, d),) for d in (1, 2, 20)], "date date")
    rows = {r["date"].day: r for r in compare_anomaly_period(series([10, 20]), days).collect()}
    assert rows[1]["baseline_mean"] is None and not rows[1]["is_significant"]
    assert rows[2]["baseline_days"] == 1 and rows[2]["p_value"] is None and not rows[2]["is_significant"]
    assert rows[20]["anomaly_revenue"] == 0 and rows[20]["baseline_days"] == 2


def test_t_distribution_critical_points(spark):
    # Two-sided 5% points of Student's t.
    points = {1: 12.7062, 2: 4.30265, 3: 3.18245, 4: 2.77645, 10: 2.22814, 29: 2.04523, 30: 2.04227}
    df = spark.createDataFrame([(v, t) for v, t in points.items()], "v int, t double")
    for row in df.select("v", student_t_two_sided_p(F.col("t"), F.col("v")).alias("p")).collect():
        assert row["p"] == pytest.approx(0.05, abs=1e-6), row["v"]


@pytest.fixture(scope="module")
def planted(spark):
    """200 ordinary days in two series, with one tenfold day each."""
    rows = []
    for s, country in enumerate(("UK", "DE")):
        for i in range(200):
            size = 10 if i == 120 + s else 1
            wave = 1 + 0.1 * math.sin(i * 1.7 + s)
            rows.append((country, date(2020, 1, 1) + timedelta(i), 1000.0 * wave * size, int(50 * wave * size),
                         int(40 * wave * size), int(300 * wave * size), 20.0 * wave))
    return spark.createDataFrame(
        rows, "country string, date date, revenue double, orders bigint, customers bigint, units_sold bigint, aov double"
    )


def test_forest_flags_the_planted_day(planted):
    one = planted.filter("country = 'UK'")
    scored = isolation.multivariate_anomalies(one, contamination=0.02, seed=7, trees=50)
    rows = sorted((r["isolation_score"], r["date"], r["is_multivariate_anomaly"]) for r in scored.collect())
    assert rows[0][1] == date(2020, 1, 1) + timedelta(120) and rows[0][2]
    assert 1 <= sum(r[2] for r in rows) <= 4
    assert all((score < 0) == flagged for score, _, flagged in rows)


def test_forest_does_not_depend_on_partitioning(planted):
    def scores(df):
        found = isolation.multivariate_anomalies(df, keys=("country",), trees=20, seed=3)
        return {(r["country"], r["date"]): round(r["isolation_score"], 12) for r in found.collect()}

    first = scores(planted.repartition(7))
    assert first == scores(planted.coalesce(1))
    worst = min((v, k) for k, v in first.items() if k[0] == "DE")[1]
    assert worst[1] == date(2020, 1, 1) + timedelta(121)


def test_combine_keeps_unseen_days(spark, series):
    detected = anomaly.detect(series([100 + (i % 5) for i in range(35)] + [900]))
    seen = spark.createDataFrame([(date(2020, 1, 5), True, -0.1)], "date date, is_multivariate_anomaly boolean, isolation_score double")
    flags = {r["date"].isoformat(): r["final_anomaly"] for r in anomaly.combine(detected, seen).collect()}
    assert flags["2020-01-05"] and flags["2020-02-05"] and not flags["2020-01-06"] and len(flags) == 36
