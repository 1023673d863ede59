from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwright.operators import forecast as f
from tillwright.operators import treeshap


@pytest.fixture(scope="module")
def training(ramp):
    return f.forecasting_data(ramp).cache()


def test_ramp_leaves_43_rows(training):
    assert training.count() == 43 and len(f.FEATURES) == 13
    first = training.orderBy("date").first()
    assert first["date"] == date(2020, 1, 31) and first["repeat_customer_rate"] == 0
    step = 2000 / 79
    assert first["revenue_lag_14"] == pytest.approx(1000 + 16 * step)
    assert first["next_7_days_revenue"] == pytest.approx(sum(1000 + step * i for i in range(31, 38)))


def test_gaps_become_zero_days(series):
    daily = series([10, None, 30]).withColumn("orders", F.lit(2)).withColumn("customers", F.lit(1)).withColumn("units_sold", F.lit(4))
    filled = f.zero_fill(f.densify(daily.withColumn("aov", F.lit(5.0)))).orderBy("date").collect()
    assert [(r["revenue"], r["orders"], r["aov"]) for r in filled] == [(10, 2, 5.0), (0, 0, 0.0), (30, 2, 15.0)]


def test_repeat_rate(four_lines):
    rates = {str(r["date"]): r["repeat_customer_rate"] for r in f.daily_repeat_rate(four_lines).collect()}
    assert rates == {"2011-12-09": 50.0, "2011-12-10": 0.0}


def test_too_little_history(series):
    with pytest.raises(ValueError):
        f.require_history(series([1.0] * 19))
    f.require_history(series([1.0] * 20))


@pytest.mark.parametrize("n, train", [(5, 4), (7, 5), (43, 34), (99, 79)])
def test_split_is_rounded_down(series, n, train):
    assert f.chrono_split(series([1.0] * n)).filter("is_train").count() == train


def test_metrics_skip_zero_actuals(spark):
    rows = spark.createDataFrame(
        [(True, 1.0, 1.0), (False, 100.0, 90.0), (False, 0.0, 10.0)], "is_train boolean, next_7_days_revenue double, prediction double"
    )
    row = f.evaluate(rows).first()
    assert (row["train_rows"], row["test_rows"], row["mae"], row["rmse"]) == (1, 2, 10.0, 10.0)
    assert row["mape"] == pytest.approx(10.0)
    assert f.evaluate(rows.filter("next_7_days_revenue = 0")).first()["mape"] is None


@pytest.fixture(scope="module")
def model(training):
    return f.train(training, rounds=10)


def test_predictions_are_finite_and_close(model, training):
    rows = f.predict(model, training).select("next_7_days_revenue", "prediction").collect()
    assert all(np.isfinite(r["prediction"]) for r in rows)
    spread = [r["next_7_days_revenue"] for r in rows]
    error = np.mean([abs(r["prediction"] - r["next_7_days_revenue"]) for r in rows])
    assert error < 0.1 * (max(spread) - min(spread))


def test_forecast_modes(model, ramp):
    rows = f.feature_rows(ramp)
    assert f.forecast(model, rows).first()["based_on_date"] == date(2020, 3, 13)
    assert f.forecast(model, rows, "future").first()["based_on_date"] == date(2020, 3, 20)
    with pytest.raises(ValueError):
        f.forecast(model, rows, "past")


def test_attributions_add_up_to_the_prediction(model, training):
    explained = treeshap.tree_shap(model, training)
    assert explained.columns == ["date", "base_value", *f.FEATURES]
    predicted = {r["date"]: r["prediction"] for r in f.predict(model, training).collect()}
    rows = explained.collect()
    assert len(rows) == 43
    for row in rows:
        total = row["base_value"] + sum(row[c] for c in f.FEATURES)
        assert total == pytest.approx(predicted[row["date"]], abs=1e-6)
    importance = treeshap.shap_importance(explained, 13).collect()
    assert len(importance) == 13 and all(r["importance"] is not None for r in importance)


def test_attribution_by_brute_force():
    """Shapley values of one small tree, from the definition over all coalitions."""
    from itertools import combinations
    from math import factorial

    import pandas as pd

    table = pd.DataFrame(
        [(0, 0.0, 100, 1, 2, 0, 5.0), (1, 0.0, 40, 3, 4, 1, 2.0), (2, 7.0, 60, -1, -1, -1, 0.0),
         (3, 1.0, 10, -1, -1, -1, 0.0), (4, 0.0, 30, 5, 6, 0, 1.0), (5, 4.0, 12, -1, -1, -1, 0.0), (6, -3.0, 18, -1, -1, -1, 0.0)],
        columns=["id", "prediction", "rows", "left", "right", "feature", "threshold"],
    ).set_index("id")
    nodes = table.to_dict("index")

    def value(x, known, node=0):
        n = nodes[node]
        if n["left"] < 0:
            return n["prediction"]
        if n["feature"] in known:
            return value(x, known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
        return sum(nodes[k]["rows"] / n["rows"] * value(x, known, k) for k in (n["left"], n["right"]))

    leaves = treeshap.tree_leaves(table, 0.5)
    for x in ([0.5, 3.0, 9.0], [4.0, 3.0, 0.0], [6.0, 1.0, 0.0], [3.0, 1.0, 0.0]):
        got = treeshap.attributions(np.array([x]), leaves)[0]
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            want = sum(
                factorial(s) * factorial(2 - s) / 6 * (value(x, {*k, i}) - value(x, set(k)))
                for s in range(3) for k in combinations(rest, s)
            )
            assert got[i] == pytest.approx(0.5 * want)
        assert treeshap.base_value(leaves) == pytest.approx(0.5 * value(x, set()))


def test_importance_sample_prefers_test_rows(series):
    split = series(range(10)).withColumn("is_train", F.col("date") < F.lit(date(2020, 1, 8)))
    assert sorted(r["revenue"] for r in treeshap.recent_rows(split, 5).collect()) == [7, 8, 9]
    assert sorted(r["revenue"] for r in treeshap.recent_rows(split.withColumn("is_train", F.lit(True)), 5).collect()) == [5, 6, 7, 8, 9]


def test_looked_up_attributions_equal_the_definition():
    rng = np.random.default_rng(1)
    leaves = [treeshap.Leaf(2.5, [], [], [], [])]
    for size in [1, 2, 3, 4, 5, 6] * 30:
        bounds = np.sort(rng.normal(size=(size, 2)), axis=1)
        features = rng.choice(13, size, replace=False).tolist()
        leaves.append(treeshap.Leaf(float(rng.normal()), features, bounds[:, 0].tolist(), bounds[:, 1].tolist(), rng.random(size).tolist()))
    values = rng.normal(size=(70, 13))
    tables = treeshap.LeafTables(leaves, 13)
    assert np.abs(tables(values) - treeshap.attributions(values, leaves)).max() < 1e-9
    assert tables(values[:0]).shape == (0, 13) and not treeshap.LeafTables([], 13)(values).any()


def test_given_features_are_not_built_again(four_lines, ramp, monkeypatch):
    """A flow that has the features reads no line for them again."""
    seen = []
    monkeypatch.setattr(f, "feature_rows", lambda *args, **kwargs: seen.append("built"))
    monkeypatch.setattr(f, "train", lambda *args, **kwargs: None)
    monkeypatch.setattr(f, "predict", lambda model, rows: rows.withColumn("prediction", F.lit(1.0)))
    given = f.forward_target(f.rolling_means(f.lags(f.calendar_features(f.with_repeat_rate(ramp, None)))))
    rows, _, _, forecast = f.forecast_run(four_lines, everything=given)
    assert seen == [] and rows.count() == 80 - 30 - 7 and forecast.count() == 1
