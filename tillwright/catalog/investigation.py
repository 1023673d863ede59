"""Root-cause investigation queries, over every flagged day."""

from pyspark.sql import functions as F

from tillwright.catalog.anomaly import T_TEST
from tillwright.catalog.base import register, stored
from tillwright.functions.variant_rows import value_rows
from tillwright.operators import contribution as c
from tillwright.operators import evidence as e
from tillwright.plans.investigate import flagged_days, investigate
from tillwright.plans.staging import stage

SHARE = "revenue:m units_sold:n orders:n revenue_share_pct:f"
LINES = """lines AS (
 SELECT s.date, hour(c.invoice_ts) AS hour, c.* FROM clean c JOIN scored s ON cast(c.invoice_ts AS DATE) = s.date WHERE s.is_anomaly)"""


def _list_sql(name, members, where="true"):
    keys = ", ".join(members)
    order = ", ".join(f"{m} NULLS LAST" for m in members)
    return f"""{name} AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY revenue DESC, {order}) AS rank,
   coalesce(revenue / nullif(cast(sum(amount) OVER (PARTITION BY date) AS DOUBLE), 0) * 100, 0) AS revenue_share_pct
  FROM (SELECT date, {keys}, sum(revenue) AS amount, cast(sum(revenue) AS DOUBLE) AS revenue, sum(quantity) AS units_sold,
    count(DISTINCT invoice) AS orders FROM lines WHERE {where} GROUP BY date, {keys})) WHERE rank <= 10)"""


LISTS = ",\n".join([
    LINES,
    _list_sql("products", ["stock_code", "description"]),
    _list_sql("customers", ["customer_id"], "customer_id IS NOT NULL"),
    _list_sql("countries", ["country"]),
    _list_sql("hours", ["hour"]),
])
for _name, _operator, _view, _columns in (
    ("product_contribution", c.product_contribution, "products", "stock_code:s description:s"),
    ("customer_contribution", c.customer_contribution, "customers", "customer_id:n"),
    ("country_contribution", c.country_contribution, "countries", "country:s"),
    ("time_contribution", c.time_contribution, "hours", "hour:n"),
):
    def _contribution(spark, folder, operator=_operator):
        tx = stored(spark, folder)
        return operator(tx, flagged_days(tx))

    register(
        _name, f"date:d rank:n {_columns} {SHARE}", _contribution, f"SELECT * FROM {_view}", views="scored", helpers=LISTS
    )


def _peak_lines(spark, folder):
    tx = stored(spark, folder)
    return c.intersection(tx, flagged_days(tx), hour=9)


INTERSECTION = "date:d revenue:m units_sold:n orders:n transaction_rows:n"
register(
    "intersection", INTERSECTION, _peak_lines,
    """SELECT date, sum(revenue) AS revenue, sum(quantity) AS units_sold, count(DISTINCT invoice) AS orders,
 count(*) AS transaction_rows FROM lines WHERE hour = 9 GROUP BY 1""",
    views="scored", helpers=LINES,
)
LEADERS = LISTS + """,
together AS (
 SELECT l.date, cast(sum(l.revenue) AS DOUBLE) AS revenue, sum(l.quantity) AS units_sold, count(DISTINCT l.invoice) AS orders,
  count(*) AS transaction_rows
 FROM lines l JOIN products p ON p.date = l.date AND p.rank = 1 AND p.stock_code = l.stock_code
  JOIN countries n ON n.date = l.date AND n.rank = 1 AND n.country = l.country
  JOIN hours h ON h.date = l.date AND h.rank = 1 AND h.hour = l.hour
  LEFT JOIN customers k ON k.date = l.date AND k.rank = 1
 WHERE k.date IS NULL OR k.customer_id = l.customer_id GROUP BY 1),
causes AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(contribution_pct, 9) DESC, round(revenue, 4) DESC, dimension, rank) AS cause_rank
  FROM (SELECT date, 'product' AS dimension, rank, description AS cause, revenue, revenue_share_pct AS contribution_pct, orders, units_sold AS units FROM products
   UNION ALL SELECT date, 'customer', rank, cast(customer_id AS VARCHAR), revenue, revenue_share_pct, orders, units_sold FROM customers
   UNION ALL SELECT date, 'country', rank, country, revenue, revenue_share_pct, orders, units_sold FROM countries
   UNION ALL SELECT date, 'hour', rank, printf('%02d:00', hour), revenue, revenue_share_pct, orders, units_sold FROM hours))
 WHERE cause_rank <= 10),
summary AS (
 SELECT s.date, strftime(s.date, '%Y-%m-%d 00:00:00') AS anomaly_date, s.revenue AS actual_revenue, s.rolling_mean_30 AS expected_revenue,
  s.z_score, s.severity, s.revenue_deviation, s.revenue_deviation_pct,
  p.stock_code, p.description, p.revenue AS product_revenue, p.revenue_share_pct AS product_pct,
  k.customer_id, k.revenue AS customer_revenue, k.revenue_share_pct AS customer_pct,
  n.country, n.revenue AS country_revenue, n.revenue_share_pct AS country_pct,
  h.hour, h.revenue AS hour_revenue, h.revenue_share_pct AS hour_pct,
  t.revenue AS joint_revenue, t.units_sold AS joint_units, t.orders AS joint_orders, t.transaction_rows AS joint_rows
 FROM scored s LEFT JOIN products p ON p.date = s.date AND p.rank = 1 LEFT JOIN customers k ON k.date = s.date AND k.rank = 1
  LEFT JOIN countries n ON n.date = s.date AND n.rank = 1 LEFT JOIN hours h ON h.date = s.date AND h.rank = 1
  LEFT JOIN together t ON t.date = s.date WHERE s.is_anomaly),
evidence AS (
 SELECT date, 1 AS ordinal, 'anomaly' AS evidence_type, 'revenue' AS dimension, NULL AS identifier,
  format('Revenue was £{:,.2f}, against an expected £{:,.2f}.', actual_revenue, expected_revenue) AS finding,
  format('{:.2f}% above expected revenue.', revenue_deviation_pct) AS impact, 'high' AS strength FROM summary
 UNION ALL SELECT date, 2, 'contribution', 'product', stock_code,
  format('{} generated £{:,.2f}.', coalesce(description, 'Unknown product'), product_revenue),
  format('{:.2f}% of anomaly-day revenue.', product_pct), 'high' FROM summary WHERE product_revenue IS NOT NULL
 UNION ALL SELECT date, 3, 'contribution', 'customer', cast(customer_id AS VARCHAR),
  format('Customer {} generated £{:,.2f}.', customer_id, customer_revenue),
  format('{:.2f}% of identified-customer revenue.', customer_pct), 'high' FROM summary WHERE customer_id IS NOT NULL
 UNION ALL SELECT date, 4, 'contribution', 'country', country, format('{} generated £{:,.2f}.', country, country_revenue),
  format('{:.2f}% of anomaly-day revenue.', country_pct), 'high' FROM summary WHERE country_revenue IS NOT NULL
 UNION ALL SELECT date, 5, 'contribution', 'time', cast(hour AS VARCHAR),
  format('The {:02d}:00 hour generated £{:,.2f}.', hour, hour_revenue),
  format('{:.2f}% of anomaly-day revenue.', hour_pct), 'high' FROM summary WHERE hour IS NOT NULL
 UNION ALL SELECT date, 6, 'intersection', 'multi_dimension', NULL,
  'Multiple investigation dimensions co-occurred in the same transaction subset.',
  format('Intersection revenue: £{:,.2f}.', joint_revenue), 'critical' FROM summary WHERE joint_revenue > 0),
ranked AS (
 SELECT *, row_number() OVER (PARTITION BY date ORDER BY strength_score DESC, evidence_type, ordinal) AS evidence_rank
 FROM (SELECT *, CASE strength WHEN 'critical' THEN 4 ELSE 3 END AS strength_score FROM evidence))"""


def _found(spark, folder):
    """Flagged days, their lines and their contribution lists."""
    tx = stored(spark, folder)
    days = stage(flagged_days(tx), "flagged")
    lines = stage(c.lines_on(tx, days), "lines")
    return days, lines, c.all_contributions(lines)


def _intersections(spark, folder):
    _, lines, lists = _found(spark, folder)
    return c.intersections(lines, c.top_members(lists))


register("intersections", INTERSECTION, _intersections, "SELECT * FROM together", views="scored", helpers=LEADERS)
register(
    "rank_root_causes", "date:d cause_rank:n dimension:s cause:s revenue:m contribution_pct:f orders:n units:n",
    lambda spark, folder: c.rank_root_causes(_found(spark, folder)[2]),
    "SELECT * FROM causes", views="scored", helpers=LEADERS,
)


def _flat(summary):
    parts = {
        "stock_code": "top_product.stock_code", "description": "top_product.description",
        "product_revenue": "top_product.revenue", "product_pct": "top_product.contribution_pct",
        "customer_id": "top_customer.customer_id", "customer_revenue": "top_customer.revenue",
        "customer_pct": "top_customer.contribution_pct", "country": "top_country.country",
        "country_revenue": "top_country.revenue", "country_pct": "top_country.contribution_pct",
        "hour": "top_hour.hour", "hour_revenue": "top_hour.revenue", "hour_pct": "top_hour.contribution_pct",
        "joint_revenue": "intersection.revenue", "joint_units": "intersection.units_sold",
        "joint_orders": "intersection.orders", "joint_rows": "intersection.transaction_rows",
    }
    return summary.select("*", *[F.col(path).alias(name) for name, path in parts.items()])


SUMMARY = (
    "date:d anomaly_date:s actual_revenue:m expected_revenue:f z_score:f severity:s revenue_deviation:f "
    "revenue_deviation_pct:f stock_code:s description:s product_revenue:m product_pct:f customer_id:n customer_revenue:m "
    "customer_pct:f country:s country_revenue:m country_pct:f hour:n hour_revenue:m hour_pct:f joint_revenue:m "
    "joint_units:n joint_orders:n joint_rows:n"
)
register(
    "investigate", SUMMARY, lambda spark, folder: _flat(investigate(stored(spark, folder)).summary),
    "SELECT * FROM summary", views="scored", helpers=LEADERS,
)


def _summary(spark, folder):
    days, lines, lists = _found(spark, folder)
    members = c.top_members(stage(lists, "contributions"))
    return e.investigation_summary(days, members, c.intersections(lines, members))


register(
    "investigation_summary", SUMMARY, lambda spark, folder: _flat(_summary(spark, folder)),
    "SELECT * FROM summary", views="scored", helpers=LEADERS,
)
FINDINGS = "date:d evidence_type:s dimension:s identifier:s finding:s impact:s strength:s"
register(
    "build_evidence", FINDINGS, lambda spark, folder: e.build_evidence(_summary(spark, folder)),
    "SELECT * FROM evidence", views="scored", helpers=LEADERS,
)
RANKED = f"{FINDINGS} strength_score:n evidence_rank:n"
register(
    "rank_evidence", RANKED, lambda spark, folder: investigate(stored(spark, folder)).evidence,
    "SELECT * FROM ranked", views="scored", helpers=LEADERS,
)
register(
    "build_report", "date:d anomaly_date:s severity:s stock_code:s customer_id:n country:s hour:n findings:n strongest:s",
    lambda spark, folder: investigate(stored(spark, folder)).report.select(
        "date", "investigation.anomaly_date", "investigation.severity", "root_causes.product.stock_code",
        "root_causes.customer.customer_id", "root_causes.country.country", "root_causes.time.hour",
        F.size("evidence").alias("findings"), F.get("evidence", F.lit(0))["finding"].alias("strongest"),
    ),
    """SELECT s.*, findings, strongest FROM summary s JOIN (SELECT date, count(*) AS findings, arg_min(finding, evidence_rank) AS strongest
 FROM ranked GROUP BY 1) r USING (date)""",
    views="scored", helpers=LEADERS,
)
register(
    "explanation_context", "date:d context:s", lambda spark, folder: investigate(stored(spark, folder)).context
)
register(
    "explanation_prompts", "date:d prompt:s", lambda spark, folder: investigate(stored(spark, folder)).prompts
)
register(
    "report_lines", "date:d line:n depth:n label:s value:s", lambda spark, folder: investigate(stored(spark, folder)).lines
)
register(
    "investigate_significance", "date:d z_score:f t_statistic:f p_value:f is_significant:b",
    lambda spark, folder: investigate(stored(spark, folder), significance=True).summary,
    """SELECT s.date, s.z_score, p.t_statistic, CASE WHEN p.t_statistic IS NOT NULL THEN p_raw END AS p_value,
 coalesce(p.t_statistic IS NOT NULL AND p_raw < 0.05, false) AS is_significant FROM scored s JOIN p USING (date) WHERE s.is_anomaly""",
    views="scored", helpers=T_TEST,
)


def _context_fields(spark, folder):
    """Fields read back from the JSON inside the prompts."""
    prompts = investigate(stored(spark, folder)).prompts
    text = F.substring_index("prompt", "Evidence:\n", -1)

    def at(path):
        return F.get_json_object(text, f"$.{path}")

    return prompts.select(
        "date", F.col("prompt").startswith(e.INSTRUCTIONS).alias("instructed"),
        at("investigation.anomaly_date").alias("anomaly_date"), at("investigation.severity").alias("severity"),
        at("investigation.z_score").cast("double").alias("z_score"),
        at("root_causes.product.stock_code").alias("stock_code"), at("root_causes.customer.customer_id").alias("customer_id"),
        at("root_causes.country.country").alias("country"), at("root_causes.time.hour").alias("hour"),
        at("intersection.transaction_rows").alias("joint_rows"), at("evidence[0].finding").alias("strongest"),
    )


register(
    "explanation_prompt_fields",
    "date:d instructed:b anomaly_date:s severity:s z_score:f stock_code:s customer_id:n country:s hour:n joint_rows:n strongest:s",
    _context_fields,
    """SELECT s.*, true AS instructed, strongest FROM summary s
 JOIN (SELECT date, arg_min(finding, evidence_rank) AS strongest FROM ranked GROUP BY 1) r USING (date)""",
    views="scored", helpers=LEADERS,
)


def _values_sql():
    """Every leaf of the context: (path, condition, text, number) of the summary, and of the findings."""
    text, number = "cast({c} AS VARCHAR), NULL", "NULL, CASE WHEN isfinite(cast({c} AS DOUBLE)) THEN cast({c} AS DOUBLE) END"
    parts = {
        "investigation": ("true", {"anomaly_date": (text, "anomaly_date"), "severity": (text, "severity"), **{
            c: (number, c) for c in ("actual_revenue", "expected_revenue", "revenue_deviation", "revenue_deviation_pct", "z_score")}}),
        "root_causes.product": ("product_revenue IS NOT NULL", {
            "stock_code": (text, "stock_code"), "description": (text, "description"), "revenue": (number, "product_revenue"), "contribution_pct": (number, "product_pct")}),
        "root_causes.customer": ("customer_id IS NOT NULL", {
            "customer_id": (number, "customer_id"), "revenue": (number, "customer_revenue"), "contribution_pct": (number, "customer_pct")}),
        "root_causes.country": ("country_revenue IS NOT NULL", {
            "country": (text, "country"), "revenue": (number, "country_revenue"), "contribution_pct": (number, "country_pct")}),
        "root_causes.time": ("hour IS NOT NULL", {"hour": (number, "hour"), "revenue": (number, "hour_revenue"), "contribution_pct": (number, "hour_pct")}),
        "intersection": ("joint_rows IS NOT NULL", {
            "revenue": (number, "joint_revenue"), "units_sold": (number, "joint_units"), "orders": (number, "joint_orders"), "transaction_rows": (number, "joint_rows")}),
    }
    rows = []
    for name, (present, fields) in parts.items():
        rows += [f"SELECT date, '{name}.{field}' AS path, {form.format(c=c)} FROM summary WHERE {present}" for field, (form, c) in fields.items()]
        rows.append(f"SELECT date, '{name}', NULL, NULL FROM summary WHERE NOT ({present})")
    for field in ("evidence_type", "dimension", "identifier", "finding", "impact", "strength", "strength_score", "evidence_rank"):
        form = number if field in ("strength_score", "evidence_rank") else text
        rows.append(f"SELECT date, 'evidence[' || (evidence_rank - 1) || '].{field}', {form.format(c=field)} FROM ranked")
    body = "\nUNION ALL ".join(rows)
    return f"SELECT date, path, text, number FROM (SELECT NULL::DATE, '', NULL::VARCHAR, NULL::DOUBLE WHERE false\nUNION ALL {body}) t(date, path, text, number)"


def _report_values(spark, folder):
    return value_rows(investigate(stored(spark, folder)).report.withColumn("body", F.struct(
        "investigation", "root_causes", "intersection", "evidence")), F.col("body"), "date")


def _context_values(spark, folder):
    """The JSON inside the prompts, taken apart again."""
    prompts = investigate(stored(spark, folder)).prompts
    return value_rows(prompts, F.substring_index("prompt", "Evidence:\n", -1), "date")


for _name, _query in (("report_values", _report_values), ("explanation_context_values", _context_values)):
    register(_name, "date:d path:s text:s number:r", _query, _values_sql(), views="scored", helpers=LEADERS)


def _line_counts(spark, folder):
    finding = F.when(F.col("label") == "Finding", F.col("value"))
    return investigate(stored(spark, folder)).lines.groupBy("date").agg(
        F.count(F.lit(1)).alias("lines"), F.count(finding).alias("findings"), F.min(finding).alias("first_finding"),
        F.count_if(F.col("value").isNull()).alias("headings"),
    )


register(
    "report_line_counts", "date:d lines:n findings:n first_finding:s headings:n", _line_counts,
    """SELECT s.date, 8 + 1 + CASE WHEN product_revenue IS NULL THEN 1 ELSE 5 END + CASE WHEN customer_id IS NULL THEN 1 ELSE 4 END
  + CASE WHEN country_revenue IS NULL THEN 1 ELSE 4 END + CASE WHEN hour IS NULL THEN 1 ELSE 4 END
  + CASE WHEN joint_rows IS NULL THEN 1 ELSE 5 END + 1 + 9 * findings AS lines, findings, first_finding,
 3 + CASE WHEN product_revenue IS NULL THEN 0 ELSE 1 END + CASE WHEN customer_id IS NULL THEN 0 ELSE 1 END
  + CASE WHEN country_revenue IS NULL THEN 0 ELSE 1 END + CASE WHEN hour IS NULL THEN 0 ELSE 1 END
  + CASE WHEN joint_rows IS NULL THEN 0 ELSE 1 END + findings AS headings
FROM summary s JOIN (SELECT date, count(*) AS findings, min(finding) AS first_finding FROM ranked GROUP BY 1) r USING (date)""",
    views="scored", helpers=LEADERS,
)
