"""Revenue KPIs: totals, per-customer and per-product figures, daily and monthly series.

Two unit definitions exist on purpose. ``units="net"`` subtracts returned quantities; ``units="sold"``
counts sale lines only. Each operator names the one it uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.functions.scalar import (
    change_pct,
    day_of,
    growth_pct,
    money,
    month_of,
    percent_of,
    positive,
    ratio,
    ratio_or_zero,
    zero_if_null,
)
from tillwright.plans.staging import stage


def orders_by(tx: DataFrame, keys: dict[str, Column], units: str = "net") -> DataFrame:
    """Collapse lines to one row per key, invoice and customer.

    Counting two distinct things at once makes Spark replicate its input once per distinct column.
    Doing so on this much smaller table, after a map-side combined shuffle, keeps the line-level data
    unreplicated; hashing on the invoice also spreads a key that owns a large part of the rows.
    """
    quantity = F.col("quantity") if units == "net" else positive(F.col("quantity"))
    return (
        tx.select(*[value.alias(name) for name, value in keys.items()], "invoice", "customer_id", "revenue",
                  quantity.alias("_units"))
        .groupBy(*keys, "invoice", "customer_id")
        .agg(F.sum("revenue").alias("_revenue"), F.sum("_units").alias("_units"))
    )


def rollup_orders(orders: DataFrame, *keys: str) -> DataFrame:
    """Revenue, distinct invoices, distinct customers, units and average order value per key."""
    measures = orders.groupBy(*keys).agg(
        money(F.sum("_revenue")).alias("revenue"),
        F.count_distinct("invoice").alias("orders"),
        F.count_distinct("customer_id").alias("customers"),
        zero_if_null(F.sum("_units")).alias("units_sold"),
    )
    return measures.withColumn("aov", ratio(F.col("revenue"), F.col("orders")))


def measures_by(tx: DataFrame, keys: dict[str, Column], units: str = "net") -> DataFrame:
    """The five standard measures grouped by the given expressions; rows with a null key are dropped."""
    orders = orders_by(tx, keys, units).dropna(subset=list(keys))
    return rollup_orders(orders, *keys)


def period_metrics(tx: DataFrame, period: str = "day", units: str = "net", keys: tuple[str, ...] = ()) -> DataFrame:
    """The standard measures per day (``date``) or month (``month``), optionally per series ``keys``."""
    stamp = {"day": ("date", day_of), "month": ("month", month_of)}[period]
    groups = {stamp[0]: stamp[1](F.col("invoice_ts"))} | {k: F.col(k) for k in keys}
    return measures_by(tx, groups, units)


def total_revenue(tx: DataFrame) -> DataFrame:
    return tx.agg(money(F.sum("revenue")).alias("total_revenue"))


def average_order_value(tx: DataFrame) -> DataFrame:
    """Revenue over distinct invoices, 0 without invoices."""
    return tx.agg(ratio_or_zero(F.sum("revenue"), F.count_distinct("invoice")).alias("aov"))


def customer_orders(tx: DataFrame) -> DataFrame:
    """Distinct invoices and revenue per known customer."""
    return (
        tx.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count_distinct("invoice").alias("orders"), F.sum("revenue").alias("revenue"))
    )


def customer_metrics(tx: DataFrame) -> DataFrame:
    """Known customers, those with one and with several orders, repeat rate, and their revenue per head."""
    total, repeat = F.count(F.lit(1)), F.count_if(F.col("orders") > 1)
    return customer_orders(tx).agg(
        total.alias("total_customers"),
        F.count_if(F.col("orders") == 1).alias("new_customers"),
        repeat.alias("repeat_customers"),
        percent_of(repeat, total).alias("repeat_customer_rate"),
        ratio_or_zero(F.sum("revenue"), total).alias("revenue_per_customer"),
    )


def product_measures(tx: DataFrame) -> DataFrame:
    """Revenue, net units and orders per (stock code, description); null members are kept."""
    return tx.groupBy("stock_code", "description").agg(
        money(F.sum("revenue")).alias("revenue"),
        zero_if_null(F.sum("quantity")).alias("units_sold"),
        F.count_distinct("invoice").alias("orders"),
    )


def top_products(tx: DataFrame, by: str = "revenue", top_n: int = 10) -> DataFrame:
    """The ``top_n`` products by ``revenue`` or ``units_sold``."""
    return (
        product_measures(tx)
        .orderBy(F.desc(by), F.asc_nulls_last("stock_code"), F.asc_nulls_last("description"))
        .limit(top_n)
    )


def product_metrics(tx: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    """Both product rankings."""
    return {
        "top_products_by_revenue": top_products(tx, "revenue", top_n),
        "top_products_by_units": top_products(tx, "units_sold", top_n),
    }


def growth(df: DataFrame, current: str, previous: str, name: str = "growth_pct") -> DataFrame:
    """Percentage growth from ``previous`` to ``current``; null when previous is 0."""
    return df.withColumn(name, growth_pct(F.col(current), F.col(previous)))


def daily_metrics(tx: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Daily measures with net units. Lines without a date are dropped."""
    return period_metrics(tx, "day", "net", keys)


def with_growth(monthly: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add growth over the previous present month. One row per month and series, so the window stays small."""
    previous = F.lag("revenue").over(Window.partitionBy(*keys).orderBy("month"))
    return monthly.withColumn("growth_pct", growth_pct(F.col("revenue"), previous))


def monthly_metrics(tx: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Monthly measures with units of sale lines only, and growth over the previous present month.

    Growth over a month with revenue 0 is null.
    """
    return with_growth(period_metrics(tx, "month", "sold", keys), keys)


def _overall(tx: DataFrame, units: str) -> DataFrame:
    """One row of overall measures; revenue per customer divides all revenue by the known customers."""
    whole = rollup_orders(orders_by(tx, {}, units))
    return whole.withColumn("aov", F.coalesce("aov", F.lit(0.0))).withColumn(
        "revenue_per_customer", ratio_or_zero(F.col("revenue"), F.col("customers"))
    )


def dataset_summary(tx: DataFrame) -> DataFrame:
    """Six overall KPIs with net units."""
    return _overall(tx, "net").select(
        F.col("revenue").alias("total_revenue"),
        F.col("orders").alias("total_orders"),
        F.col("customers").alias("total_customers"),
        F.col("units_sold").alias("total_units_sold"),
        F.col("aov").alias("average_order_value"),
        F.col("revenue_per_customer").alias("average_revenue_per_customer"),
    )


def analytics_kpis(tx: DataFrame) -> DataFrame:
    """Order value, revenue per customer, repeat rate and net units over dated lines.

    One pass: the (invoice, customer) pairs are grouped once by invoice, whose groups are the orders, and once by
    customer, whose pairs are that customer's distinct invoices.
    """
    pairs = orders_by(tx.filter(F.col("invoice_ts").isNotNull()), {}, "net").withColumn(
        "_pair", F.when(F.col("invoice").isNotNull(), 1)
    )
    groups = pairs.groupingSets([["invoice"], ["customer_id"]], "invoice", "customer_id").agg(
        (F.grouping("customer_id") == 0).alias("_by_customer"),
        F.sum("_pair").alias("_orders"),
        F.sum("_revenue").alias("_revenue"),
        F.sum("_units").alias("_units"),
    )
    invoices = F.count_if(~F.col("_by_customer") & F.col("invoice").isNotNull())
    known = F.col("_by_customer") & F.col("customer_id").isNotNull()
    customers = F.count_if(known)
    return groups.agg(
        ratio_or_zero(F.sum(F.when(F.col("_by_customer"), F.col("_revenue"))), invoices).alias("average_order_value"),
        ratio_or_zero(F.sum(F.when(F.col("_by_customer"), F.col("_revenue"))), customers).alias("revenue_per_customer"),
        percent_of(F.count_if(known & (F.col("_orders") > 1)), customers).alias("repeat_customer_rate"),
        zero_if_null(F.sum(F.when(F.col("_by_customer"), F.col("_units")))).alias("units_sold"),
    )


def daily_revenue(tx: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Date (per series ``keys``) and revenue only: no distinct counts, so one combined shuffle of a few bytes per day."""
    return (
        tx.groupBy(*keys, day_of(F.col("invoice_ts")).alias("date"))
        .agg(money(F.sum("revenue")).alias("revenue"))
        .dropna(subset=[*keys, "date"])
    )


def expected_revenue(daily: DataFrame, window: int = 30, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add ``expected``: the mean of up to ``window`` previous present days, and the day itself at the start.

    With fewer previous days than the window the trailing mean and the expanding mean cover the same rows, so
    one frame serves both. Input is one row per day and series.
    """
    before = Window.partitionBy(*keys).orderBy("date").rowsBetween(-window, -1)
    return daily.withColumn("expected", F.coalesce(F.avg("revenue").over(before), F.col("revenue")))


def trailing(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows by ``order``, ascending."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def trailing_days(daily: DataFrame, n: int = 90) -> DataFrame:
    """Last days of an expected-revenue series with a 'dd MMM' label."""
    return trailing(daily, "date", n).withColumn("label", F.date_format("date", "dd MMM"))


def trailing_months(monthly: DataFrame, n: int = 18) -> DataFrame:
    """Last months with a 'MMM yyyy' label."""
    first_day = F.to_date(F.concat("month", F.lit("-01")))
    return trailing(monthly, "month", n).withColumn("label", F.date_format(first_day, "MMM yyyy"))


def top_product_share(tx: DataFrame, n: int = 5) -> DataFrame:
    """Top descriptions by revenue over dated lines and their percentage of all revenue."""
    product = F.coalesce("description", F.lit("Unknown product"))
    dated = tx.filter(F.col("invoice_ts").isNotNull())
    # The total is the sum of the exact sums, so the lines are read once.
    sums = dated.groupBy(product.alias("product")).agg(F.sum("revenue").alias("_exact"), money(F.sum("revenue")).alias("revenue"))
    sums = stage(sums, "products")
    total = sums.select(money(F.sum("_exact"))).scalar()
    top = sums.drop("_exact").orderBy(F.desc("revenue"), "product").limit(n)
    return top.withColumn("share", percent_of(F.col("revenue"), total))


def day_over_day(daily: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Change of each day against the previous present day, relative to that day's size."""
    previous = F.lag("revenue").over(Window.partitionBy(*keys).orderBy("date"))
    return daily.select(
        *keys, "date", "revenue", previous.alias("previous_revenue"),
        change_pct(F.col("revenue"), previous).alias("change_pct"),
    )


def monthly_revenue_orders(tx: DataFrame) -> DataFrame:
    """Monthly revenue beside monthly distinct orders, with growth; one distinct count needs no replication."""
    monthly = (
        tx.groupBy(month_of(F.col("invoice_ts")).alias("month"))
        .agg(money(F.sum("revenue")).alias("revenue"), F.count_distinct("invoice").alias("orders"))
        .filter(F.col("month").isNotNull())
    )
    return with_growth(monthly)


def kpi_long(tx: DataFrame) -> DataFrame:
    """Six KPIs as metric/value rows; units are those of sale lines only."""
    # Metric labels of the KPI table.
    labels = {
        "Total Revenue": "revenue",
        "Total Orders": "orders",
        "Total Customers": "customers",
        "Total Units Sold": "units_sold",
        "Average Order Value": "aov",
        "Average Revenue per Customer": "revenue_per_customer",
    }
    row = _overall(tx, "sold").select(*[F.col(c).cast("double").alias(label) for label, c in labels.items()])
    return row.unpivot([], list(labels), "metric", "value")
