"""Registration of queries and the SQL views they share.

An entry names its output columns once, with a type letter; the same list finishes the DataFrame and the SQL
text, so both sides return equal names, types and rounding:
d date, s text, n whole number, m exact amount, c amount summed as floating point (2 places), r large mean (4 places),
f computed number (6 places), b boolean, t timestamp as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwright.operators import kpi
from tillwright.operators.cleaning import clean_transactions
from tillwright.plans.staging import once, stage
from tillwright.sources.retail_tables import raw_transactions

RAW_SQL = """
base AS (
 SELECT concat(CASE WHEN l_returnflag='R' AND l_linenumber % 4 = 0 THEN 'C' ELSE '' END, cast(l_orderkey AS VARCHAR(20))) AS invoice,
  cast(l_partkey AS VARCHAR(20)) AS stock_code,
  CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN ' Adjust bad debt ' ELSE p_name END AS description,
  cast(CASE WHEN (l_returnflag='R' AND l_linenumber % 4 = 0) OR (l_returnflag='A' AND l_linenumber = 7) THEN -l_quantity ELSE l_quantity END AS BIGINT) AS quantity,
  o_orderdate + (8 + l_orderkey % 12) * INTERVAL '1' HOUR AS invoice_ts,
  CASE WHEN l_partkey % 53 = 0 THEN cast(0 AS DECIMAL(12,2)) ELSE cast(l_extendedprice AS DECIMAL(12,2)) END AS price,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS customer_id,
  n_name AS country, l_orderkey
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
raw AS (
 SELECT invoice, stock_code, description, quantity, invoice_ts, price, customer_id, country FROM base
 UNION ALL
 SELECT invoice, stock_code, description, quantity, invoice_ts, price, customer_id, country FROM base WHERE l_orderkey % 50 = 0)"""

VIEWS = {
    "raw": RAW_SQL,
    "clean": """
clean AS (
 SELECT *, quantity * price AS revenue, false AS is_cancelled, quantity < 0 AS is_return, price = 0 AS is_zero_price,
  false AS is_bad_debt
 FROM (SELECT DISTINCT * FROM raw) d
 WHERE coalesce(substr(invoice,1,1),'') <> 'C' AND lower(trim(coalesce(description,''))) <> 'adjust bad debt')""",
    "daily": """
daily AS (
 SELECT cast(invoice_ts AS DATE) AS date, cast(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT invoice) AS orders,
  count(DISTINCT customer_id) AS customers, sum(quantity) AS units_sold,
  cast(sum(revenue) AS DOUBLE) / count(DISTINCT invoice) AS aov
 FROM clean GROUP BY 1)""",
    "monthly": """
monthly AS (
 SELECT *, revenue / orders AS aov, (revenue - lag(revenue) OVER (ORDER BY month)) / lag(revenue) OVER (ORDER BY month) * 100 AS growth_pct
 FROM (SELECT strftime(invoice_ts, '%Y-%m') AS month, cast(sum(revenue) AS DOUBLE) AS revenue,
   count(DISTINCT invoice) AS orders, count(DISTINCT customer_id) AS customers,
   sum(CASE WHEN quantity > 0 THEN quantity ELSE 0 END) AS units_sold
  FROM clean GROUP BY 1))""",
    "scored": """
baseline AS (
 SELECT *, CASE WHEN present = 30 THEN m END AS rolling_mean_30, CASE WHEN present = 30 THEN s END AS rolling_std_30
 FROM (SELECT *, avg(revenue) OVER w AS m, stddev_samp(revenue) OVER w AS s, count(*) OVER w AS present
  FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))),
zscored AS (
 SELECT *, CASE WHEN rolling_std_30 <> 0 THEN (revenue - rolling_mean_30) / rolling_std_30
  WHEN rolling_std_30 = 0 AND revenue > rolling_mean_30 THEN 'inf'::DOUBLE
  WHEN rolling_std_30 = 0 AND revenue < rolling_mean_30 THEN '-inf'::DOUBLE END AS z_score FROM baseline),
scored AS (
 SELECT date, revenue, orders, customers, units_sold, aov, rolling_mean_30, rolling_std_30, z_score,
  coalesce(abs(z_score) >= 3, false) AS is_anomaly,
  CASE WHEN z_score IS NULL OR abs(z_score) < 2 THEN 'NORMAL' WHEN abs(z_score) < 3 THEN 'MEDIUM'
   WHEN abs(z_score) < 4 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  revenue - rolling_mean_30 AS revenue_deviation,
  (revenue - rolling_mean_30) / nullif(rolling_mean_30, 0) * 100 AS revenue_deviation_pct
 FROM zscored)""",
}
CHAIN = ("raw", "clean", "daily", "scored")


@dataclass(frozen=True)
class Entry:
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}

SPARK_FINISH = {
    "d": lambda c: c.cast("date"),
    "s": lambda c: c.cast("string"),
    "n": lambda c: c.cast("bigint"),
    "m": lambda c: c.cast("double"),
    "c": lambda c: F.round(c.cast("double"), 2),
    "r": lambda c: F.round(c.cast("double"), 4),
    "f": lambda c: F.round(c.cast("double"), 6),
    "b": lambda c: c.cast("boolean"),
    "t": lambda c: c.cast("string"),
}
SQL_FINISH = {
    "d": "CAST({c} AS DATE)",
    "s": "CAST({c} AS VARCHAR)",
    "n": "CAST({c} AS BIGINT)",
    "m": "CAST({c} AS DOUBLE)",
    "c": "round(CAST({c} AS DOUBLE), 2)",
    "r": "round(CAST({c} AS DOUBLE), 4)",
    "f": "round(CAST({c} AS DOUBLE), 6)",
    "b": "CAST({c} AS BOOLEAN)",
    "t": "CAST({c} AS VARCHAR)",
}


def with_views(body: str, *names: str) -> str:
    """Prefix a SQL body with the shared views it uses, in dependency order."""
    needed = set(names)
    if needed & {"scored"}:
        needed |= {"daily"}
    if needed & {"daily", "monthly"}:
        needed |= {"clean"}
    if "clean" in needed:
        needed |= {"raw"}
    return ",".join(text for name, text in VIEWS.items() if name in needed).strip() + body


def register(
    name: str,
    columns: str,
    query: Callable[[SparkSession, str], DataFrame],
    sql: str | None = None,
    views: str = "clean",
    helpers: str = "",
) -> None:
    """Add an entry. ``columns`` is 'name:letter ...'; ``helpers`` are extra CTEs placed after the shared views."""
    spec = [item.split(":") for item in columns.split()]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = query(spark, folder)
        return df.select(*[SPARK_FINISH[kind](F.col(c)).alias(c) for c, kind in spec])

    text = None
    if sql is not None:
        finish = ", ".join(f"{SQL_FINISH[kind].format(c=c)} AS {c}" for c, kind in spec)
        ctes = with_views("", *views.split())
        parts = ", ".join(p for p in (ctes, helpers.strip()) if p)
        text = (f"WITH {parts}\n" if parts else "") + f"SELECT {finish} FROM (\n{sql.strip()}\n) answer"
    if name in ENTRIES:
        raise ValueError(f"Query {name} is registered twice")
    ENTRIES[name] = Entry(run, text)


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return raw_transactions(spark, folder)


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_transactions(raw_transactions(spark, folder))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The clean set, written once per folder and application as it was computed.

    Not by month, as the load step leaves it: that would shuffle every line again for queries that read it all anyway.
    """
    return once(spark, ("clean", folder), lambda: stage(clean(spark, folder), "clean-set"))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return kpi.daily_metrics(clean(spark, folder))


def on_clean(operator: Callable[..., DataFrame], *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(clean(spark, folder), *args, **kwargs)


def on_raw(operator: Callable[..., DataFrame], *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(raw(spark, folder), *args, **kwargs)


def on_daily(operator: Callable[..., DataFrame], *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(daily(spark, folder), *args, **kwargs)
