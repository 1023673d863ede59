from __future__ import annotations

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tillwright.operators import contribution as c
from tillwright.operators import evidence as e
from tillwright.operators.cleaning import clean_transactions
from tillwright.plans.investigate import investigate, investigate_date


@pytest.fixture(scope="module")
def anomaly_row(spark):
    return spark.createDataFrame(
        [(date(2011, 12, 9), 500.0, 200.0, 4.0, "CRITICAL", 300.0, 150.0)],
        "date date, revenue double, rolling_mean_30 double, z_score double, severity string, revenue_deviation double, "
        "revenue_deviation_pct double",
    )


@pytest.fixture(scope="module")
def summary(four_lines, the_day, anomaly_row):
    lines = c.lines_on(four_lines, the_day)
    members = c.top_members(c.all_contributions(lines))
    return e.investigation_summary(anomaly_row, members, c.intersections(lines, members))


def test_leading_members(four_lines, the_day):
    product = c.product_contribution(four_lines, the_day).orderBy("rank").collect()
    assert (product[0]["stock_code"], product[0]["revenue"], product[0]["revenue_share_pct"]) == ("A", 300.0, 75.0)
    customer = c.customer_contribution(four_lines, the_day).orderBy("rank").first()
    assert (customer["customer_id"], customer["revenue"]) == (100, 300.0)
    country = c.country_contribution(four_lines, the_day).orderBy("rank").first()
    assert (country["country"], country["revenue"]) == ("United Kingdom", 300.0)
    hours = c.time_contribution(four_lines, the_day).orderBy("rank").collect()
    assert [(h["hour"], h["revenue"], h["revenue_share_pct"]) for h in hours] == [(9, 200.0, 50.0), (10, 200.0, 50.0)]


def test_intersection(four_lines, the_day):
    row = c.intersection(four_lines, the_day, customer_id=100, country="United Kingdom", hour=9).first()
    assert (row["revenue"], row["orders"], row["transaction_rows"]) == (100.0, 1, 1)
    assert c.intersection(four_lines, the_day, customer_id=200, country="United Kingdom").count() == 0


def test_day_without_net_revenue_has_zero_shares(make_raw, the_day):
    tx = clean_transactions(make_raw([
        ("1", "A", "a", 10, "2011-12-09 09:00", 1.0, None, None),
        ("2", "B", None, -10, "2011-12-09 10:00", 1.0, None, "UK"),
    ]))
    shares = [r["revenue_share_pct"] for r in c.product_contribution(tx, the_day).collect()]
    assert shares == [0.0, 0.0]
    assert c.customer_contribution(tx, the_day).count() == 0
    assert c.country_contribution(tx, the_day).filter("country is null").count() == 1


def test_causes_are_ranked_by_share_then_revenue(four_lines, the_day):
    causes = c.rank_root_causes(c.all_contributions(c.lines_on(four_lines, the_day)), 5).orderBy("cause_rank").collect()
    assert [r["cause"] for r in causes] == ["United Kingdom", "100", "Product A", "09:00", "10:00"]
    assert causes[0]["contribution_pct"] == 75.0


def test_summary(summary):
    row = summary.first()
    assert row["anomaly_date"] == "2011-12-09 00:00:00" and row["severity"] == "CRITICAL"
    assert row["top_product"]["stock_code"] == "A" and row["top_customer"]["customer_id"] == 100
    assert row["top_country"]["country"] == "United Kingdom" and row["top_hour"]["hour"] == 9
    assert row["intersection"]["revenue"] == 100.0


def test_evidence_text_and_order(summary):
    ranked = e.rank_evidence(e.build_evidence(summary)).orderBy("evidence_rank").collect()
    assert [r["evidence_type"] for r in ranked] == ["intersection", "anomaly"] + ["contribution"] * 4
    assert ranked[1]["finding"] == "Revenue was £500.00, against an expected £200.00."
    assert ranked[1]["impact"] == "150.00% above expected revenue."
    assert ranked[2]["finding"] == "Product A generated £300.00." and ranked[2]["identifier"] == "A"
    assert ranked[5]["finding"] == "The 09:00 hour generated £200.00."
    assert ranked[0]["strength_score"] == 4 and ranked[0]["impact"] == "Intersection revenue: £100.00."


def test_signed_impact_of_a_dip(summary):
    dip = summary.withColumn("revenue_deviation_pct", F.lit(-12.5))
    rows = e.build_evidence(dip, signed=True).filter("ordinal = 1").collect()
    assert rows[0]["impact"] == "12.50% below expected revenue."
    assert e.build_evidence(dip).filter("ordinal = 1").first()["impact"] == "-12.50% above expected revenue."


def test_unknown_strength_scores_zero(spark):
    rows = spark.createDataFrame(
        [("2011-12-09", "b", 1, "LOW"), ("2011-12-09", "a", 2, "odd"), ("2011-12-09", "a", 3, "Critical")],
        "date string, evidence_type string, ordinal int, strength string",
    )
    got = [(r["strength_score"], r["evidence_rank"]) for r in e.rank_evidence(rows).orderBy("evidence_rank").collect()]
    assert got == [(4, 1), (1, 2), (0, 3)]


def test_no_intersection_finding_without_positive_revenue(summary):
    none = summary.withColumn("intersection", F.col("intersection").withField("revenue", F.lit(0.0)))
    assert e.build_evidence(none).filter("evidence_type = 'intersection'").count() == 0


def test_context_and_lines(summary):
    report = e.build_report(summary, e.rank_evidence(e.build_evidence(summary)))
    context = json.loads(e.explanation_context(report).first()["context"])
    assert set(context) == {"investigation", "root_causes", "intersection", "evidence"}
    assert context["root_causes"]["product"]["description"] == "Product A" and len(context["evidence"]) == 6
    assert context["evidence"][1]["identifier"] is None
    prompt = e.explanation_prompts(e.explanation_context(report)).first()["prompt"]
    assert "six parts" in prompt and "Product A" in prompt
    lines = e.report_lines(report).orderBy("line").collect()
    assert (lines[0]["label"], lines[0]["value"], lines[1]["label"]) == ("Investigation", None, "Anomaly Date")
    assert ("Item 6", None) in {(r["label"], r["value"]) for r in lines}


@pytest.fixture(scope="module")
def half_year(make_raw):
    """60 ordinary days and one with a planted customer, product and country."""
    rows = []
    for i in range(60):
        day = date(2011, 1, 1) + timedelta(i)
        for k in range(4):
            rows.append((f"{i}-{k}", f"P{k}", f"Product {k}", 10 + (i * 7 + k) % 5, f"{day} {9 + k:02d}:00", 2.0, k, "UK"))
    rows.append(("big", "P9", "Rare", 1000, f"{date(2011, 2, 20)} 15:00", 2.0, 77, "Malta"))
    return clean_transactions(make_raw(rows))


def test_investigation_of_all_flagged_days(half_year):
    result = investigate(half_year, significance=True)
    row = result.summary.collect()
    assert [r["date"] for r in row] == [date(2011, 2, 20)]
    assert row[0]["top_product"]["stock_code"] == "P9" and row[0]["top_hour"]["hour"] == 15
    assert row[0]["intersection"]["transaction_rows"] == 1 and row[0]["is_significant"]
    assert result.causes.count() == 10 and result.prompts.count() == 1


def test_single_date_mode(half_year):
    assert investigate_date(half_year, "2011-02-20").report.count() == 1
    with pytest.raises(ValueError, match="2011-02-10"):
        investigate_date(half_year, "2011-02-10")


def test_partitioned_source_is_pruned(spark, half_year, tmp_path):
    from tillwright.sources.transactions import write_clean

    write_clean(half_year, str(tmp_path / "tx"))
    stored = spark.read.parquet(str(tmp_path / "tx"))
    days = spark.createDataFrame([(date(2011, 2, 20),)], "date date")
    lines = c.lines_on(stored, days)
    assert lines.count() == 5
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "month#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(invoice_ts" in plan
