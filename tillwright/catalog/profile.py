"""Profiling queries."""

from pyspark.sql import functions as F

from tillwright.catalog.base import clean, on_clean, on_raw, raw, register
from tillwright.catalog.load import LINE
from tillwright.operators import profile
from tillwright.operators.cleaning import add_revenue
from tillwright.operators.rfm import rfm
from tillwright.sources.transactions import union_sources

_COLUMNS = [c.split(":")[0] for c in LINE.split()]
register(
    "null_profile", "field:s nulls:n null_pct:f", on_raw(profile.null_profile),
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL) AS nulls,"
        f" count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS null_pct FROM raw"
        for c in _COLUMNS
    ),
    views="raw",
)
register(
    "duplicate_profile", "rows:n duplicate_rows:n duplicate_pct:f", on_raw(profile.duplicate_profile),
    """SELECT n AS rows, n - d AS duplicate_rows, (n - d) * 100.0 / n AS duplicate_pct
FROM (SELECT (SELECT count(*) FROM raw) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS d)""",
    views="raw",
)
register(
    "duplicate_rows", LINE, on_raw(profile.duplicate_rows),
    f"SELECT * EXCLUDE (copies) FROM (SELECT *, count(*) OVER (PARTITION BY {', '.join(_COLUMNS)}) AS copies FROM raw) WHERE copies > 1",
    views="raw",
)
register(
    "duplicate_preview", LINE, on_raw(profile.duplicate_preview),
    f"""SELECT * EXCLUDE (copies) FROM (SELECT *, count(*) OVER (PARTITION BY {', '.join(_COLUMNS)}) AS copies FROM raw) WHERE copies > 1
ORDER BY invoice, stock_code, invoice_ts, description NULLS LAST, quantity, price, customer_id NULLS LAST, country LIMIT 20""",
    views="raw",
)
register(
    "cardinality", "rows:n columns:n invoices:n products:n customers:n countries:n", on_raw(profile.cardinality),
    """SELECT count(*) AS rows, 8 AS columns, count(DISTINCT invoice) AS invoices, count(DISTINCT stock_code) AS products,
 count(DISTINCT customer_id) AS customers, count(DISTINCT country) AS countries FROM raw""",
    views="raw",
)


def _counts_sql(column, n, where="true"):
    return (
        f"SELECT {column} AS value, count(*) AS count FROM raw WHERE {column} IS NOT NULL AND {where}"
        f" GROUP BY 1 ORDER BY count DESC, value LIMIT {n}"
    )


register(
    "value_counts_country", "value:s count:n", on_raw(profile.value_counts, "country", 1000),
    _counts_sql("country", 1000), views="raw",
)
register(
    "value_counts_stock_code", "value:s count:n", on_raw(profile.value_counts, "stock_code", 20),
    _counts_sql("stock_code", 20), views="raw",
)
register(
    "value_counts_zero_price", "value:s count:n",
    lambda spark, folder: profile.value_counts(raw(spark, folder), "description", 20, F.col("price") == 0),
    _counts_sql("description", 20, "price = 0"), views="raw",
)


def _ranges(spark, folder):
    lines = raw(spark, folder)
    moment = F.lit("1998-01-01").cast("timestamp_ntz")
    parts = {"first": lines.filter(F.col("invoice_ts") < moment), "second": lines.filter(F.col("invoice_ts") >= moment)}
    return profile.date_range(union_sources(parts), by="source")


register(
    "date_range", "part:s first_ts:t last_ts:t", _ranges,
    """SELECT 'all' AS part, min(invoice_ts) AS first_ts, max(invoice_ts) AS last_ts FROM raw
UNION ALL SELECT CASE WHEN invoice_ts < TIMESTAMP '1998-01-01' THEN 'first' ELSE 'second' END, min(invoice_ts), max(invoice_ts)
FROM raw GROUP BY 1""",
    views="raw",
)
register(
    "sign_profile", "field:s negative:n zero:n positive:n",
    lambda spark, folder: profile.sign_profile(add_revenue(raw(spark, folder))),
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) FILTER (WHERE {e} < 0) AS negative, count(*) FILTER (WHERE {e} = 0) AS zero,"
        f" count(*) FILTER (WHERE {e} > 0) AS positive FROM raw"
        for c, e in (("quantity", "quantity"), ("price", "price"), ("revenue", "quantity * price"))
    ),
    views="raw",
)
register(
    "cancel_by_negative", "is_cancelled:s is_negative:s rows:n", on_raw(profile.cancel_by_negative),
    """SELECT CASE WHEN grouping(c) = 1 THEN 'all' ELSE cast(c AS VARCHAR) END AS is_cancelled,
 CASE WHEN grouping(n) = 1 THEN 'all' ELSE cast(n AS VARCHAR) END AS is_negative, count(*) AS rows
FROM (SELECT starts_with(invoice, 'C') AS c, quantity < 0 AS n FROM raw) GROUP BY CUBE (c, n)""",
    views="raw",
)


def _describe_sql(columns, source):
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,"
        f" quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max"
        f" FROM (SELECT cast({e} AS DOUBLE) AS {c} FROM {source})"
        for c, e in columns
    )


NUMBERS = "field:s count:n mean:r std:r min:r q25:r q50:r q75:r max:r"
register(
    "describe_numbers", NUMBERS,
    lambda spark, folder: profile.describe_numbers(clean(spark, folder), ["quantity", "price", "revenue"]),
    _describe_sql([(c, c) for c in ("quantity", "price", "revenue")], "clean"),
)
register(
    "describe_rfm", NUMBERS,
    lambda spark, folder: profile.describe_numbers(rfm(clean(spark, folder)), ["frequency", "monetary"]),
    _describe_sql(
        [("frequency", "frequency"), ("monetary", "monetary")],
        "(SELECT count(DISTINCT invoice) AS frequency, sum(revenue) AS monetary FROM clean WHERE customer_id IS NOT NULL GROUP BY customer_id)",
    ),
)
register(
    "describe_text", "field:s count:n distinct_values:n top:s freq:n",
    on_raw(profile.describe_text, ["invoice", "stock_code", "description", "country"]),
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS field, sum(n) AS count, count(*) AS distinct_values, arg_min(v, (-n, v)) AS top, max(n) AS freq"
        f" FROM (SELECT {c} AS v, count(*) AS n FROM raw WHERE {c} IS NOT NULL GROUP BY 1)"
        for c in ("invoice", "stock_code", "description", "country")
    ),
    views="raw",
)


def _rebated(spark, folder):
    """Some prices turned negative, as manual corrections do."""
    lines = raw(spark, folder)
    return lines.withColumn("price", F.when(F.col("quantity") % 11 == 0, -F.col("price")).otherwise(F.col("price")))


REBATED = """rebated AS (SELECT * REPLACE (CASE WHEN quantity % 11 = 0 THEN -price ELSE price END AS price) FROM raw)"""
register(
    "negative_price_impact", "rows:n revenue:m",
    lambda spark, folder: profile.negative_price_impact(_rebated(spark, folder)),
    "SELECT count(*) AS rows, sum(quantity * price) AS revenue FROM rebated WHERE price < 0",
    views="raw", helpers=REBATED,
)
register(
    "negative_price_by_description", "description:s count:n sum:m",
    lambda spark, folder: profile.negative_price_by_description(_rebated(spark, folder)),
    """SELECT description, count(*) AS count, sum(quantity * price) AS sum FROM rebated
WHERE price < 0 AND description IS NOT NULL GROUP BY 1 ORDER BY sum, description LIMIT 20""",
    views="raw", helpers=REBATED,
)
register(
    "revenue_by_row_class", "row_class:s rows:n revenue:m duplicate_rows:n", on_raw(profile.revenue_by_row_class),
    """SELECT CASE WHEN starts_with(invoice, 'C') THEN 'cancelled' WHEN quantity < 0 THEN 'negative' ELSE 'regular' END AS row_class,
 sum(n) AS rows, sum(quantity * price * n) AS revenue, sum(n - 1) AS duplicate_rows
FROM (SELECT *, count(*) AS n FROM raw GROUP BY ALL) GROUP BY 1""",
    views="raw",
)
register(
    "missing_customer_profile", "rows:n quantity:n", on_raw(profile.missing_customer_profile),
    "SELECT count(*) AS rows, sum(quantity) AS quantity FROM raw WHERE customer_id IS NULL", views="raw",
)
register(
    "missing_customer_countries", "value:s count:n", on_raw(profile.missing_customer_countries),
    _counts_sql("country", 10, "customer_id IS NULL"), views="raw",
)
register(
    "clean_invariants",
    "cancelled_remaining:n duplicates_remaining:n bad_debt_remaining:n incorrect_revenue:n negative_revenue:n",
    on_clean(profile.clean_invariants),
    """SELECT count(*) FILTER (WHERE starts_with(invoice, 'C')) AS cancelled_remaining,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM clean)) AS duplicates_remaining,
 count(*) FILTER (WHERE lower(trim(description)) = 'adjust bad debt') AS bad_debt_remaining,
 count(*) FILTER (WHERE revenue <> quantity * price) AS incorrect_revenue,
 count(*) FILTER (WHERE revenue < 0) AS negative_revenue FROM clean""",
)
_CONDITIONS = {
    "negative_quantity": "quantity < 0",
    "zero_price": "price = 0",
    "cancelled": "starts_with(invoice, 'C')",
    "uncancelled_negative": "NOT starts_with(invoice, 'C') AND quantity < 0",
    "cancelled_positive": "starts_with(invoice, 'C') AND quantity >= 0",
    "free_sales": "price = 0 AND quantity > 0",
    "negative_price": "price < 0",
    "negative_revenue": "quantity * price < 0",
}
register(
    "inspect_rows", f"{LINE} view:s",
    lambda spark, folder: profile.all_inspections(_rebated(spark, folder)),
    "\nUNION ALL ".join(
        f"SELECT * FROM (SELECT *, '{view}' AS view FROM rebated WHERE {condition} ORDER BY invoice_ts NULLS LAST, invoice NULLS LAST,"
        " stock_code NULLS LAST, quantity NULLS LAST, price NULLS LAST, description NULLS LAST, customer_id NULLS LAST,"
        " country NULLS LAST LIMIT 20)"
        for view, condition in _CONDITIONS.items()
    ),
    views="raw", helpers=REBATED,
)
