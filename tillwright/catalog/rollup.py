"""Queries of the daily rollup: measures and distinct counts of days merged into months, periods and the whole."""

from datetime import date

from pyspark.sql import functions as F

from tillwright.catalog.base import raw, register, stored
from tillwright.catalog.kpi import MEASURES
from tillwright.operators import cleaning, profile, rollup
from tillwright.plans.staging import once, stage


def kept_rollup(spark, folder):
    """The rollup of the clean set, built once per folder and application."""
    return once(spark, ("rollup", folder), lambda: rollup.build_rollup(stored(spark, folder)))


def _staged_raw(spark, folder):
    """Uncleaned lines with what the rollup reads, written once: it reads them for every kind and for the measures."""
    lines = cleaning.add_revenue(raw(spark, folder))
    return stage(lines.select("invoice_ts", *rollup.KINDS.values(), "quantity", "revenue"), "raw-lines")


SUMMARY = (
    "total_revenue:m total_orders:n total_customers:n total_units_sold:n average_order_value:f average_revenue_per_customer:f"
)
SUMMARY_SQL = """SELECT sum(revenue) AS total_revenue, count(DISTINCT invoice) AS total_orders,
 count(DISTINCT customer_id) AS total_customers, sum(quantity) AS total_units_sold,
 cast(sum(revenue) AS DOUBLE) / count(DISTINCT invoice) AS average_order_value,
 cast(sum(revenue) AS DOUBLE) / count(DISTINCT customer_id) AS average_revenue_per_customer FROM clean"""

register(
    "daily_metrics_from_rollup", f"date:d {MEASURES}", lambda spark, folder: rollup.daily_from(kept_rollup(spark, folder)),
    "SELECT * FROM daily", views="daily",
)
register(
    "monthly_metrics_from_rollup", f"month:s {MEASURES} growth_pct:f",
    lambda spark, folder: rollup.monthly_from(kept_rollup(spark, folder)),
    "SELECT * FROM monthly", views="monthly",
)
register(
    "dataset_summary_from_rollup", SUMMARY, lambda spark, folder: rollup.summary_from(kept_rollup(spark, folder)), SUMMARY_SQL,
)
register(
    "period_summary_from_rollup", SUMMARY,
    lambda spark, folder: rollup.summary_from(rollup.within(kept_rollup(spark, folder), date(1996, 3, 10), date(1997, 2, 20))),
    SUMMARY_SQL + " WHERE cast(invoice_ts AS DATE) BETWEEN DATE '1996-03-10' AND DATE '1997-02-20'",
)
register(
    "cardinality_from_rollup", "rows:n columns:n invoices:n products:n customers:n countries:n",
    lambda spark, folder: rollup.cardinality_from(rollup.build_rollup(_staged_raw(spark, folder)), 8),
    """SELECT count(*) AS rows, 8 AS columns, count(DISTINCT invoice) AS invoices, count(DISTINCT stock_code) AS products,
 count(DISTINCT customer_id) AS customers, count(DISTINCT country) AS countries FROM raw""",
    views="raw",
)


def _sketched(spark, folder):
    """Rows and columns, and which estimates are within 5 percent of the exact count (three standard errors)."""
    lines = raw(spark, folder)
    estimates = rollup.approximate_cardinality(rollup.day_sketches(lines), 8)
    exact = profile.cardinality(lines).select(*[F.col(k).alias(f"exact_{k}") for k in rollup.KINDS])
    close = [(F.abs(F.col(k) - F.col(f"exact_{k}")) <= 0.05 * F.col(f"exact_{k}")).alias(k) for k in rollup.KINDS]
    return estimates.crossJoin(exact).select("rows", "columns", *close)  # one row each


register(
    "cardinality_from_sketches", "rows:n columns:n invoices:b customers:b products:b countries:b", _sketched,
    "SELECT count(*) AS rows, 8 AS columns, true AS invoices, true AS customers, true AS products, true AS countries FROM raw",
    views="raw",
)

