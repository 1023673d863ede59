"""Anomaly detection queries."""

from pyspark.sql import functions as F

from tillwright.catalog.base import clean, daily, on_daily, register
from tillwright.operators import anomaly, isolation, significance
from tillwright.operators.kpi import daily_metrics, daily_revenue
from tillwright.plans.staging import stage

BASE = "date:d revenue:m rolling_mean_30:f rolling_std_30:c z_score:f"
IMPACT = "revenue_deviation:f revenue_deviation_pct:f"
DETECTED = f"{BASE} is_anomaly:b severity:s {IMPACT}"

register(
    "baseline", "date:d revenue:m rolling_mean_30:f rolling_std_30:c", on_daily(anomaly.baseline), "SELECT * FROM scored",
    views="scored",
)
register(
    "z_score", "date:d z_score:f", lambda spark, folder: anomaly.with_z_score(anomaly.baseline(daily(spark, folder))),
    "SELECT date, z_score FROM scored", views="scored",
)
register(
    "flag", "date:d z_score:f is_anomaly:b", lambda spark, folder: anomaly.flag(anomaly.baseline(daily(spark, folder))),
    "SELECT date, z_score, is_anomaly FROM scored", views="scored",
)
register(
    "severity", "date:d z_score:f severity:s",
    lambda spark, folder: anomaly.severity(anomaly.baseline(daily(spark, folder))),
    "SELECT date, z_score, severity FROM scored", views="scored",
)
register(
    "impact", f"date:d revenue:m {IMPACT}", lambda spark, folder: anomaly.impact(anomaly.baseline(daily(spark, folder))),
    "SELECT * FROM scored", views="scored",
)
register("detect", f"{DETECTED} orders:n customers:n units_sold:n aov:f", on_daily(anomaly.detect), "SELECT * FROM scored", views="scored")


def _by_country(spark, folder):
    return anomaly.detect_from_transactions(clean(spark, folder), keys=("country",))


register(
    "detect_by_country", f"country:s {BASE} is_anomaly:b", _by_country,
    """SELECT country, date, revenue, m AS rolling_mean_30, s AS rolling_std_30, (revenue - m) / nullif(s, 0) AS z_score,
 coalesce(abs((revenue - m) / nullif(s, 0)) >= 3, false) AS is_anomaly
FROM (SELECT country, date, revenue, CASE WHEN n = 30 THEN m END AS m, CASE WHEN n = 30 THEN s END AS s
 FROM (SELECT *, avg(revenue) OVER w AS m, stddev_samp(revenue) OVER w AS s, count(*) OVER w AS n FROM by_country
  WINDOW w AS (PARTITION BY country ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)))""",
    helpers="""by_country AS (SELECT country, cast(invoice_ts AS DATE) AS date, cast(sum(revenue) AS DOUBLE) AS revenue
 FROM clean WHERE country IS NOT NULL GROUP BY 1, 2)""",
)
register(
    "multivariate_anomalies", "date:d revenue:m isolation_score:f is_multivariate_anomaly:b",
    lambda spark, folder: isolation.multivariate_anomalies(stage(daily(spark, folder), "daily")),
)
register(
    "multivariate_anomalies_by_country", "country:s date:d revenue:m isolation_score:f is_multivariate_anomaly:b",
    lambda spark, folder: isolation.multivariate_anomalies(
        stage(daily_metrics(clean(spark, folder), ("country",)), "daily"), keys=("country",)
    ),
)


def _flag_counts(spark, folder):
    found = isolation.multivariate_anomalies(stage(daily(spark, folder), "daily"))
    flagged = F.col("is_multivariate_anomaly")
    return found.agg(
        F.count(F.lit(1)).alias("days"), F.count_if(flagged).alias("flagged"),
        F.every(flagged == (F.col("isolation_score") < 0)).alias("flag_is_sign"),
    )


register(
    "multivariate_flag_counts", "days:n flagged:n flag_is_sign:b", _flag_counts,
    "SELECT count(*) AS days, floor(0.02 * (count(*) - 1)) + 1 AS flagged, true AS flag_is_sign FROM daily", views="daily",
)


def _combined(spark, folder):
    days = stage(daily(spark, folder), "daily")
    return anomaly.combine(anomaly.detect(days), isolation.multivariate_anomalies(days))


register(
    "combine_with_forest", f"{DETECTED} isolation_score:f is_multivariate_anomaly:b final_anomaly:b", _combined
)


def _combined_rule(spark, folder):
    days = daily(spark, folder)
    rule = days.filter(F.dayofmonth("date") > 10).select(
        "date", (F.col("orders") > F.col("customers") + 1).alias("is_multivariate_anomaly"),
        (F.col("customers") - F.col("orders")).cast("double").alias("isolation_score"),
    )
    return anomaly.combine(anomaly.detect(days), rule)


register(
    "combine", f"{DETECTED} isolation_score:f is_multivariate_anomaly:b final_anomaly:b", _combined_rule,
    """SELECT *, CASE WHEN day(date) > 10 THEN customers - orders END AS isolation_score,
 CASE WHEN day(date) > 10 THEN orders > customers + 1 END AS is_multivariate_anomaly,
 is_anomaly OR coalesce(day(date) > 10 AND orders > customers + 1, false) AS final_anomaly FROM scored""",
    views="scored",
)


def _tested(spark, folder):
    days = stage(daily_revenue(clean(spark, folder)), "daily")
    return significance.compare_anomaly_period(days, days)


T_TEST = """tested AS (
 SELECT t.date, coalesce(max(CASE WHEN d.date = t.date THEN d.revenue END), 0) AS anomaly_revenue,
  count(CASE WHEN d.date < t.date THEN 1 END) AS baseline_days, avg(CASE WHEN d.date < t.date THEN d.revenue END) AS baseline_mean,
  stddev_samp(CASE WHEN d.date < t.date THEN d.revenue END) AS baseline_std
 FROM daily t JOIN daily d ON d.date BETWEEN t.date - 30 AND t.date GROUP BY 1),
t_value AS (
 SELECT *, (baseline_mean - anomaly_revenue) / nullif(baseline_std / sqrt(baseline_days), 0) AS t_statistic, baseline_days - 1 AS v
 FROM tested),
angle AS (SELECT *, CASE WHEN v > 0 THEN atan(abs(t_statistic) / sqrt(v)) END AS th FROM t_value),
p AS (
 SELECT *, greatest(0, 1 - CASE
  WHEN v = 1 THEN 2 / pi() * th
  WHEN v % 2 = 1 THEN 2 / pi() * (th + sin(th) * list_sum([gamma(j + 1) * gamma(1.5) / gamma(j + 1.5) * pow(cos(th), 2 * j + 1)
    FOR j IN range(0, (v - 3) // 2 + 1)]))
  ELSE sin(th) * list_sum([gamma(j + 0.5) / gamma(0.5) / gamma(j + 1) * pow(cos(th), 2 * j) FOR j IN range(0, (v - 2) // 2 + 1)])
  END) AS p_raw FROM angle)"""
register(
    "compare_anomaly_period",
    "date:d anomaly_revenue:m baseline_mean:f baseline_std:c t_statistic:f p_value:f is_significant:b", _tested,
    """SELECT *, CASE WHEN t_statistic IS NOT NULL THEN p_raw END AS p_value,
 coalesce(t_statistic IS NOT NULL AND p_raw < 0.05, false) AS is_significant FROM p""",
    views="daily", helpers=T_TEST,
)
register(
    "list_anomalies", DETECTED,
    lambda spark, folder: anomaly.list_anomalies(anomaly.detect(daily(spark, folder)), order="severity"),
    "SELECT * FROM scored WHERE is_anomaly", views="scored",
)
register(
    "list_critical_anomalies", DETECTED,
    lambda spark, folder: anomaly.list_anomalies(anomaly.detect(daily(spark, folder)), severity="CRITICAL"),
    "SELECT * FROM scored WHERE is_anomaly AND severity = 'CRITICAL'", views="scored",
)
register(
    "severity_counts", "severity:s days:n",
    lambda spark, folder: anomaly.severity_counts(anomaly.detect(daily(spark, folder))),
    "SELECT severity, count(*) AS days FROM scored WHERE is_anomaly GROUP BY 1", views="scored",
)
register(
    "most_critical_day", DETECTED,
    lambda spark, folder: anomaly.most_critical_day(anomaly.detect(daily(spark, folder))),
    "SELECT * FROM scored WHERE is_anomaly AND severity = 'CRITICAL' ORDER BY abs(z_score) DESC, date LIMIT 1", views="scored",
)
