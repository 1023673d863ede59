"""KPI queries."""

from tillwright.catalog.base import clean, daily, on_clean, on_daily, register
from tillwright.operators import kpi

MEASURES = "revenue:m orders:n customers:n units_sold:n aov:f"

register("total_revenue", "total_revenue:m", on_clean(kpi.total_revenue), "SELECT sum(revenue) AS total_revenue FROM clean")
register(
    "average_order_value", "aov:f", on_clean(kpi.average_order_value),
    "SELECT cast(sum(revenue) AS DOUBLE) / count(DISTINCT invoice) AS aov FROM clean",
)
register(
    "customer_metrics",
    "total_customers:n new_customers:n repeat_customers:n repeat_customer_rate:f revenue_per_customer:f",
    on_clean(kpi.customer_metrics),
    """SELECT count(*) AS total_customers, count(*) FILTER (WHERE orders = 1) AS new_customers,
 count(*) FILTER (WHERE orders > 1) AS repeat_customers,
 count(*) FILTER (WHERE orders > 1) * 100.0 / count(*) AS repeat_customer_rate,
 cast(sum(revenue) AS DOUBLE) / count(*) AS revenue_per_customer
FROM (SELECT customer_id, count(DISTINCT invoice) AS orders, sum(revenue) AS revenue FROM clean
 WHERE customer_id IS NOT NULL GROUP BY 1)""",
)
for _by in ("revenue", "units_sold"):
    register(
        f"top_products_by_{_by}", "stock_code:s description:s revenue:m units_sold:n orders:n",
        on_clean(kpi.top_products, _by),
        f"""SELECT stock_code, description, sum(revenue) AS revenue, sum(quantity) AS units_sold,
 count(DISTINCT invoice) AS orders FROM clean GROUP BY 1, 2
ORDER BY {_by} DESC, stock_code NULLS LAST, description NULLS LAST LIMIT 10""",
    )
register(
    "product_measures", "stock_code:s description:s revenue:m units_sold:n orders:n", on_clean(kpi.product_measures),
    """SELECT stock_code, description, sum(revenue) AS revenue, sum(quantity) AS units_sold,
 count(DISTINCT invoice) AS orders FROM clean GROUP BY 1, 2""",
)
register(
    "growth", "month:s revenue:m orders:n growth_pct:f",
    lambda spark, folder: kpi.growth(kpi.monthly_metrics(clean(spark, folder)), "revenue", "orders"),
    "SELECT month, revenue, orders, (revenue - orders) / nullif(orders, 0) * 100 AS growth_pct FROM monthly",
    views="monthly",
)
register("daily_metrics", f"date:d {MEASURES}", on_clean(kpi.daily_metrics), "SELECT * FROM daily", views="daily")
register(
    "daily_metrics_by_country", f"date:d country:s {MEASURES}",
    lambda spark, folder: kpi.daily_metrics(clean(spark, folder), ("country",)),
    """SELECT cast(invoice_ts AS DATE) AS date, country, sum(revenue) AS revenue, count(DISTINCT invoice) AS orders,
 count(DISTINCT customer_id) AS customers, sum(quantity) AS units_sold,
 cast(sum(revenue) AS DOUBLE) / count(DISTINCT invoice) AS aov FROM clean WHERE country IS NOT NULL GROUP BY 1, 2""",
)
register(
    "monthly_metrics", f"month:s {MEASURES} growth_pct:f", on_clean(kpi.monthly_metrics),
    "SELECT * FROM monthly", views="monthly",
)
register(
    "dataset_summary",
    "total_revenue:m total_orders:n total_customers:n total_units_sold:n average_order_value:f average_revenue_per_customer:f",
    on_clean(kpi.dataset_summary),
    """SELECT sum(revenue) AS total_revenue, count(DISTINCT invoice) AS total_orders,
 count(DISTINCT customer_id) AS total_customers, sum(quantity) AS total_units_sold,
 cast(sum(revenue) AS DOUBLE) / count(DISTINCT invoice) AS average_order_value,
 cast(sum(revenue) AS DOUBLE) / count(DISTINCT customer_id) AS average_revenue_per_customer FROM clean""",
)
register(
    "analytics_kpis", "average_order_value:f revenue_per_customer:f repeat_customer_rate:f units_sold:n",
    on_clean(kpi.analytics_kpis),
    """SELECT cast(sum(revenue) AS DOUBLE) / count(DISTINCT invoice) AS average_order_value,
 cast(sum(revenue) AS DOUBLE) / count(DISTINCT customer_id) AS revenue_per_customer,
 (SELECT avg(CASE WHEN n > 1 THEN 100.0 ELSE 0 END) FROM (SELECT count(DISTINCT invoice) AS n FROM clean
  WHERE customer_id IS NOT NULL AND invoice_ts IS NOT NULL GROUP BY customer_id)) AS repeat_customer_rate,
 sum(quantity) AS units_sold FROM clean WHERE invoice_ts IS NOT NULL""",
)
EXPECTED = """expected AS (
 SELECT date, revenue, coalesce(avg(revenue) OVER (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), revenue) AS expected
 FROM daily)"""
register(
    "expected_revenue", "date:d revenue:m expected:f",
    lambda spark, folder: kpi.expected_revenue(kpi.daily_revenue(clean(spark, folder))),
    "SELECT * FROM expected", views="daily", helpers=EXPECTED,
)
register(
    "trailing_days", "date:d label:s revenue:m expected:f",
    lambda spark, folder: kpi.trailing_days(kpi.expected_revenue(kpi.daily_revenue(clean(spark, folder)))),
    "SELECT *, strftime(date, '%d %b') AS label FROM (SELECT * FROM expected ORDER BY date DESC LIMIT 90)",
    views="daily", helpers=EXPECTED,
)
register(
    "trailing_months", "month:s label:s revenue:m",
    lambda spark, folder: kpi.trailing_months(kpi.monthly_revenue_orders(clean(spark, folder))),
    """SELECT month, revenue, strftime(cast(month || '-01' AS DATE), '%b %Y') AS label
FROM (SELECT * FROM monthly ORDER BY month DESC LIMIT 18)""",
    views="monthly",
)
register(
    "top_product_share", "product:s revenue:m share:f", on_clean(kpi.top_product_share),
    """SELECT coalesce(description, 'Unknown product') AS product, sum(revenue) AS revenue,
 cast(sum(revenue) AS DOUBLE) / (SELECT cast(sum(revenue) AS DOUBLE) FROM clean) * 100 AS share
FROM clean GROUP BY 1 ORDER BY revenue DESC, product LIMIT 5""",
)
register(
    "day_over_day", "date:d revenue:m previous_revenue:m change_pct:f",
    lambda spark, folder: kpi.day_over_day(kpi.daily_revenue(clean(spark, folder))),
    """SELECT date, revenue, previous AS previous_revenue, (revenue - previous) / nullif(abs(previous), 0) * 100 AS change_pct
FROM (SELECT date, revenue, lag(revenue) OVER (ORDER BY date) AS previous FROM daily)""",
    views="daily",
)
register(
    "monthly_revenue_orders", "month:s revenue:m orders:n growth_pct:f", on_clean(kpi.monthly_revenue_orders),
    "SELECT month, revenue, orders, growth_pct FROM monthly", views="monthly",
)
register(
    "kpi_long", "metric:s value:f", on_clean(kpi.kpi_long),
    """SELECT unnest(['Total Revenue', 'Total Orders', 'Total Customers', 'Total Units Sold', 'Average Order Value',
 'Average Revenue per Customer']) AS metric, unnest([r, o, c, u, r / o, r / c]) AS value
FROM (SELECT cast(sum(revenue) AS DOUBLE) AS r, cast(count(DISTINCT invoice) AS DOUBLE) AS o,
 cast(count(DISTINCT customer_id) AS DOUBLE) AS c,
 cast(sum(CASE WHEN quantity > 0 THEN quantity END) AS DOUBLE) AS u FROM clean)""",
)
