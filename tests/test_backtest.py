from __future__ import annotations

from datetime import date, timedelta

import pytest

from tillwright.operators import backtest as b
from tillwright.operators.anomaly import detect_from_revenue, detect_from_transactions
from tillwright.operators.cleaning import clean_transactions
from tillwright.operators.contribution import lines_on


@pytest.fixture(scope="module")
def tx(make_raw):
    rows = []
    for i in range(101):
        day = date(2011, 1, 1) + timedelta(i)
        for k in range(5):
            rows.append((f"{i}-{k}", f"P{k % 2}", f"Product {k % 2}", 10 + (i * 7 + k) % 9, f"{day} {9 + k:02d}:00", 2.0, k % 3, ("UK", "DE")[k % 2]))
    return clean_transactions(make_raw(rows))


@pytest.fixture(scope="module")
def target(tx):
    from tillwright.operators.kpi import daily_revenue

    return b.pick_target_date(daily_revenue(tx)).cache()


def test_confusion_counts(spark):
    def days(*numbers):
        return spark.createDataFrame([(date(2020, 1, n),) for n in numbers], "date date")

    row = b.detection_metrics(days(1, 2), days(2, 3, 9), days(*range(1, 9))).first()
    assert (row["true_positive"], row["false_positive"], row["false_negative"], row["true_negative"]) == (1, 1, 1, 5)
    assert (row["precision"], row["recall"]) == (0.5, 0.5) and row["false_positive_rate"] == pytest.approx(1 / 6)
    empty = b.detection_metrics(days(), days(), days()).first()
    assert (empty["precision"], empty["recall"], empty["false_positive_rate"]) == (0, 0, 0)


def test_target_date(series, target):
    assert target.first()["date"] == date(2011, 1, 1) + timedelta(40 + 51 // 2)
    assert b.pick_target_date(series([1.0] * 50)).count() == 0
    assert b.pick_target_date(series([1.0] * 51)).first()["date"] == date(2020, 1, 1) + timedelta(40)


def test_injected_shock_is_detected(tx, target):
    shocked = b.inject_uniform_shock(tx, target)
    assert shocked.count() == tx.count()
    gain = float(shocked.selectExpr("sum(revenue)").first()[0]) - float(tx.selectExpr("sum(revenue)").first()[0])
    assert gain == pytest.approx(100_000)
    found = detect_from_transactions(shocked).filter("is_anomaly")
    row = b.detection_metrics(target, found, detect_from_transactions(tx)).first()
    assert (row["true_positive"], row["false_negative"], row["recall"]) == (1, 0, 1.0)


def test_detection_needs_no_more_than_dates_and_revenue(tx, target):
    shocked = b.inject_uniform_shock(tx, target)
    found = detect_from_revenue(shocked.select("invoice_ts", "revenue")).orderBy("date").collect()
    whole = detect_from_transactions(shocked).orderBy("date").collect()
    assert [(r["date"], r["is_anomaly"], r["severity"]) for r in found] == [(r["date"], r["is_anomaly"], r["severity"]) for r in whole]
    assert [r["revenue"] for r in found] == pytest.approx([r["revenue"] for r in whole])
    # Lines are not combined and replicated to count invoices and customers.
    assert "Expand" not in detect_from_revenue(shocked)._jdf.queryExecution().executedPlan().toString()


def test_every_injected_member_becomes_the_top_cause(tx, target):
    lines = lines_on(tx, target).cache()
    targets = b.require_targets(b.select_targets(lines))
    assert b.inject_member_rows(targets).count() == 42
    rows = {r["scenario"]: r for r in b.scenario_eval(lines, targets).collect()}
    assert set(rows) == set(b.SCENARIOS)
    assert all(r["target_rank"] == 1 and r["top_1_correct"] and r["top_3_correct"] for r in rows.values())
    assert all(r["predicted_top_1"] == r["scenario"] and len(r["top_5"]) == 5 for r in rows.values())
    score = b.accuracy(b.scenario_eval(lines, targets)).first()
    assert (score["scenario_count"], score["top_1_accuracy"]) == (3, 1.0)


def test_missing_targets_raise(four_lines, the_day):
    with pytest.raises(ValueError, match="customer"):
        b.require_targets(b.select_targets(lines_on(four_lines.filter("customer_id = 200"), the_day)))


def test_dimension_of_unknown_dates_is_wrong(spark, four_lines, the_day):
    from tillwright.operators.contribution import all_contributions, rank_root_causes

    ranked = rank_root_causes(all_contributions(lines_on(four_lines, the_day)))
    expected = spark.createDataFrame(
        [("a", date(2011, 12, 9), "country"), ("b", date(2011, 12, 9), "hour"), ("c", date(2012, 1, 1), "product")],
        "scenario string, date date, expected_dimension string",
    )
    got = {r["scenario"]: (r["top_1_correct"], r["top_3_correct"]) for r in b.dimension_eval(ranked, expected).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (False, False)}
    assert b.accuracy(b.dimension_eval(ranked, expected).filter("false")).first()["top_1_accuracy"] == 0


def test_deltas_rank_as_the_lines_themselves_would(make_raw):
    """Days with ties, returns, nulls in every member, members beyond the list limits, and a target below them."""
    from tillwright.operators.contribution import all_contributions, member_measures, rank_root_causes

    rows = []
    for day in ("2011-12-09", "2011-12-10"):
        for k in range(60):
            rows.append((f"{k % 40}", f"P{k % 25}" if k % 13 else None, f"Product {k % 25}" if k % 7 else None, k % 9 - 1,
                         f"{day} {6 + k % 17:02d}:00", 2.0 + k % 3, k % 31 if k % 5 else None, f"C{k % 14}" if k % 11 else None))
    lines = lines_on(clean_transactions(make_raw(rows)), make_raw(rows).selectExpr("to_date(invoice_ts) as date").distinct()).cache()
    measures = member_measures(lines)
    targets = b.targets_from(measures).cache()
    assert targets.count() == 6
    contributions = all_contributions(b.scenario_lines(lines, targets), 10, hour_top_n=20, by=("date", "scenario"))
    want = rank_root_causes(contributions.filter("rank <= 10"), 10, ("date", "scenario"))
    columns = ["date", "scenario", "cause_rank", "dimension", "cause", "round(revenue, 4)", "round(contribution_pct, 8)", "orders", "units"]
    key = lambda df: sorted(map(repr, df.selectExpr(*columns).collect()))
    assert key(b.ranked_from(measures, targets)) == key(want)
    plan = b.ranked_from(measures, targets)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Expand" not in plan
