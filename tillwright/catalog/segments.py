"""Customer, product, country, time and RFM queries."""

from tillwright.catalog.base import clean, on_clean, register, stored
from tillwright.operators import kpi, rfm, segments

MEASURES = "revenue:m orders:n customers:n units_sold:n aov:f"
GROUPED = """count(DISTINCT invoice) AS orders, count(DISTINCT customer_id) AS customers,
 sum(CASE WHEN quantity > 0 THEN quantity ELSE 0 END) AS units_sold,
 cast(sum(revenue) AS DOUBLE) / count(DISTINCT invoice) AS aov"""

register(
    "first_purchase", "customer_id:n first_purchase_ts:t", on_clean(segments.first_purchase),
    "SELECT customer_id, min(invoice_ts) AS first_purchase_ts FROM clean WHERE customer_id IS NOT NULL GROUP BY 1",
)
FIRST = "min(invoice_ts) OVER (PARTITION BY customer_id) AS first_purchase_ts"
register(
    "with_first_purchase", "invoice:s stock_code:s customer_id:n invoice_ts:t revenue:m first_purchase_ts:t",
    on_clean(segments.with_first_purchase),
    f"SELECT *, {FIRST} FROM clean WHERE customer_id IS NOT NULL",
)
register(
    "new_vs_repeat", "invoice:s stock_code:s customer_id:n invoice_ts:t revenue:m customer_type:s",
    on_clean(segments.new_vs_repeat),
    f"""SELECT *, CASE WHEN date_trunc('month', invoice_ts) = date_trunc('month', first_purchase_ts) THEN 'New' ELSE 'Repeat' END
 AS customer_type FROM (SELECT *, {FIRST} FROM clean WHERE customer_id IS NOT NULL)""",
)
register(
    "monthly_customer_mix", "month:s new_customers:n repeat_customers:n total_customers:n repeat_customer_pct:f",
    on_clean(segments.monthly_customer_mix),
    f"""SELECT strftime(invoice_ts, '%Y-%m') AS month,
 count(DISTINCT CASE WHEN strftime(invoice_ts, '%Y-%m') = strftime(first_purchase_ts, '%Y-%m') THEN customer_id END) AS new_customers,
 count(DISTINCT CASE WHEN strftime(invoice_ts, '%Y-%m') <> strftime(first_purchase_ts, '%Y-%m') THEN customer_id END) AS repeat_customers,
 count(DISTINCT customer_id) AS total_customers,
 count(DISTINCT CASE WHEN strftime(invoice_ts, '%Y-%m') <> strftime(first_purchase_ts, '%Y-%m') THEN customer_id END) * 100.0
  / count(DISTINCT customer_id) AS repeat_customer_pct
FROM (SELECT *, {FIRST} FROM clean WHERE customer_id IS NOT NULL) GROUP BY 1""",
)
register(
    "customer_revenue", "customer_id:n revenue:m", on_clean(segments.customer_revenue),
    "SELECT customer_id, sum(revenue) AS revenue FROM clean WHERE customer_id IS NOT NULL GROUP BY 1",
)
for _name, _member, _members in (
    ("customers", "customer_id", segments.customer_revenue),
    ("products", "stock_code", segments.product_profile),
    ("countries", "country", segments.country_profile),
):
    register(
        f"concentration_{_name}", "top_n:n top_revenue:c total_revenue:c share_pct:f",
        lambda spark, folder, members=_members, member=_member: segments.concentration(members(clean(spark, folder)), member),
        "\nUNION ALL ".join(
            f"""SELECT {n} AS top_n, sum(revenue) AS top_revenue, (SELECT sum(revenue) FROM members) AS total_revenue,
 cast(sum(revenue) AS DOUBLE) / (SELECT cast(sum(revenue) AS DOUBLE) FROM members) * 100 AS share_pct
FROM (SELECT * FROM members ORDER BY revenue DESC, member LIMIT {n})"""
            for n in (10, 20)
        ),
        helpers=f"""members AS (SELECT {_member} AS member, sum(revenue) AS revenue FROM clean
 WHERE {_member} IS NOT NULL GROUP BY 1)""",
    )
PROFILE_SQL = """SELECT stock_code, sum(revenue) AS revenue, sum(CASE WHEN quantity > 0 THEN quantity ELSE 0 END) AS units_sold,
 count(DISTINCT invoice) AS orders, cast(sum(price) AS DOUBLE) / count(price) AS average_price,
 first(description ORDER BY invoice_ts, invoice, description) FILTER (WHERE description IS NOT NULL) AS description
FROM clean WHERE stock_code IS NOT NULL GROUP BY 1"""
PROFILE = "stock_code:s revenue:m units_sold:n orders:n average_price:m description:s"
register("product_profile", PROFILE, on_clean(segments.product_profile), PROFILE_SQL)
for _by in ("revenue", "units_sold"):
    register(
        f"top_product_profiles_by_{_by}", PROFILE, on_clean(segments.top_product_profiles, _by),
        f"{PROFILE_SQL} ORDER BY {_by} DESC, stock_code LIMIT 10",
    )
COUNTRY_SQL = f"""SELECT country, sum(revenue) AS revenue, {GROUPED},
 cast(sum(revenue) AS DOUBLE) / (SELECT cast(sum(revenue) AS DOUBLE) FROM clean WHERE country IS NOT NULL) * 100 AS revenue_share_pct
FROM clean WHERE country IS NOT NULL GROUP BY 1"""
register("country_profile", f"country:s {MEASURES} revenue_share_pct:f", on_clean(segments.country_profile), COUNTRY_SQL)
register(
    "country_lookup", f"country:s {MEASURES} revenue_share_pct:f", on_clean(segments.country_lookup, "NATION_7"),
    f"SELECT * FROM ({COUNTRY_SQL}) WHERE country = 'NATION_7'",
)
register(
    "calendar_columns", "invoice:s stock_code:s invoice_ts:t year:n month:n day:n hour:n day_name:s month_name:s",
    on_clean(segments.calendar_columns),
    """SELECT invoice, stock_code, invoice_ts, year(invoice_ts) AS year, month(invoice_ts) AS month, day(invoice_ts) AS day,
 hour(invoice_ts) AS hour, dayname(invoice_ts) AS day_name, monthname(invoice_ts) AS month_name FROM clean""",
)
register(
    "weekday_profile", f"weekday:n day_name:s {MEASURES}", on_clean(segments.weekday_profile),
    f"""SELECT isodow(invoice_ts) - 1 AS weekday, any_value(dayname(invoice_ts)) AS day_name, sum(revenue) AS revenue, {GROUPED}
FROM clean GROUP BY 1""",
)
register(
    "hourly_profile", f"hour:n {MEASURES}", on_clean(segments.hourly_profile),
    f"SELECT hour(invoice_ts) AS hour, sum(revenue) AS revenue, {GROUPED} FROM clean GROUP BY 1",
)


def _extremes(spark, folder):
    lines = stored(spark, folder)
    monthly = kpi.monthly_metrics(lines)
    parts = [
        segments.best_worst(monthly, "month", "revenue"),
        segments.best_worst(monthly, "month", "aov"),
        segments.best_worst(monthly, "month", "growth_pct"),
        segments.best_worst(segments.weekday_profile(lines), "weekday", "revenue"),
        segments.best_worst(segments.hourly_profile(lines), "hour", "revenue"),
    ]
    labelled = [p.selectExpr(f"'{n}' AS series", "*") for n, p in zip(
        ("month revenue", "month aov", "month growth", "weekday revenue", "hour revenue"), parts)]
    result = labelled[0]
    for part in labelled[1:]:
        result = result.unionByName(part)
    return result


def _extreme_sql(series, source, key, metric):
    return "\nUNION ALL ".join(
        f"""SELECT * FROM (SELECT '{series}' AS series, '{metric}' AS metric, '{kind}' AS kind, cast({key} AS VARCHAR) AS member,
 {metric} AS value FROM {source} WHERE {metric} IS NOT NULL ORDER BY {metric} {way}, {key} LIMIT 1)"""
        for kind, way in (("best", "DESC"), ("worst", "ASC"))
    )


register(
    "best_worst", "series:s metric:s kind:s member:s value:f", _extremes,
    "\nUNION ALL ".join([
        _extreme_sql("month revenue", "monthly", "month", "revenue"),
        _extreme_sql("month aov", "monthly", "month", "aov"),
        _extreme_sql("month growth", "monthly", "month", "growth_pct"),
        _extreme_sql("weekday revenue", "weekdays", "weekday", "revenue"),
        _extreme_sql("hour revenue", "hours", "hour", "revenue"),
    ]),
    views="monthly",
    helpers="""weekdays AS (SELECT isodow(invoice_ts) - 1 AS weekday, cast(sum(revenue) AS DOUBLE) AS revenue FROM clean GROUP BY 1),
hours AS (SELECT hour(invoice_ts) AS hour, cast(sum(revenue) AS DOUBLE) AS revenue FROM clean GROUP BY 1)""",
)

RFM_SQL = """rfm AS (
 SELECT customer_id, date_sub('hour', last_ts, (SELECT max(invoice_ts) FROM clean WHERE customer_id IS NOT NULL)) // 24 AS recency,
  frequency, monetary, last_ts AS last_purchase_ts
 FROM (SELECT customer_id, max(invoice_ts) AS last_ts, count(DISTINCT invoice) AS frequency,
   cast(sum(revenue) AS DOUBLE) AS monetary FROM clean WHERE customer_id IS NOT NULL GROUP BY 1)),
ranked AS (
 SELECT *, row_number() OVER (ORDER BY recency, customer_id) AS r, row_number() OVER (ORDER BY frequency, customer_id) AS f,
  row_number() OVER (ORDER BY monetary, customer_id) AS m, count(*) OVER () AS n FROM rfm),
scores AS (
 SELECT customer_id, recency, frequency, monetary, last_purchase_ts,
  6 - greatest(1, ceil((r - 1) * 5.0 / (n - 1))) AS r_score, greatest(1, ceil((f - 1) * 5.0 / (n - 1))) AS f_score,
  greatest(1, ceil((m - 1) * 5.0 / (n - 1))) AS m_score FROM ranked),
segmented AS (
 SELECT *, concat(cast(r_score AS INT), cast(f_score AS INT), cast(m_score AS INT)) AS rfm_score,
  r_score + f_score + m_score AS rfm_total,
  CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
   WHEN r_score >= 3 AND f_score >= 4 THEN 'Loyal Customers' WHEN r_score >= 3 AND m_score >= 4 THEN 'Big Spenders'
   WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers' WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'At Risk'
   WHEN r_score <= 2 AND f_score <= 2 THEN 'Hibernating' WHEN r_score >= 3 AND f_score >= 3 THEN 'Potential Loyalists'
   ELSE 'Others' END AS segment FROM scores)"""
METRICS = "customer_id:n recency:n frequency:n monetary:m last_purchase_ts:t"
SCORES = "r_score:n f_score:n m_score:n"
register("rfm", METRICS, on_clean(rfm.rfm), "SELECT * FROM rfm", helpers=RFM_SQL)
register(
    "rfm_scores", f"{METRICS} {SCORES}", lambda spark, folder: rfm.rfm_scores(rfm.rfm(clean(spark, folder))),
    "SELECT * FROM scores", helpers=RFM_SQL,
)
register(
    "rfm_combined", f"customer_id:n {SCORES} rfm_score:s rfm_total:n",
    lambda spark, folder: rfm.rfm_combined(rfm.rfm_scores(rfm.rfm(clean(spark, folder)))),
    "SELECT * FROM segmented", helpers=RFM_SQL,
)
register(
    "rfm_segment", f"customer_id:n {SCORES} segment:s",
    lambda spark, folder: rfm.rfm_segment(rfm.rfm_scores(rfm.rfm(clean(spark, folder)))),
    "SELECT * FROM segmented", helpers=RFM_SQL,
)
register(
    "segment_summary",
    "segment:s customers:n revenue:c avg_recency:f avg_frequency:f avg_monetary:f customer_share_pct:f revenue_share_pct:f",
    lambda spark, folder: rfm.segment_summary(rfm.rfm_table(clean(spark, folder))),
    """SELECT segment, count(*) AS customers, sum(monetary) AS revenue, avg(recency) AS avg_recency,
 avg(frequency) AS avg_frequency, avg(monetary) AS avg_monetary,
 count(*) * 100.0 / (SELECT count(*) FROM segmented) AS customer_share_pct,
 sum(monetary) / (SELECT sum(monetary) FROM segmented) * 100 AS revenue_share_pct FROM segmented GROUP BY 1""",
    helpers=RFM_SQL,
)
for _by, _way in (("monetary", "DESC"), ("frequency", "DESC"), ("recency", "ASC")):
    register(
        f"top_customers_by_{_by}", METRICS,
        lambda spark, folder, by=_by: rfm.top_customers(rfm.rfm(clean(spark, folder)), by),
        f"SELECT * FROM rfm ORDER BY {_by} {_way}, customer_id LIMIT 20", helpers=RFM_SQL,
    )
register(
    "top_champions", f"{METRICS} rfm_score:s segment:s",
    lambda spark, folder: rfm.top_customers(rfm.rfm_table(clean(spark, folder)), "monetary", 20, "Champions"),
    "SELECT * FROM segmented WHERE segment = 'Champions' ORDER BY monetary DESC, customer_id LIMIT 20", helpers=RFM_SQL,
)
