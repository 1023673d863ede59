"""Customer, product, country and time analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwright.functions.scalar import money, month_of, percent_of, positive, ratio, zero_if_null
from tillwright.operators.kpi import measures_by, orders_by, rollup_orders
from tillwright.plans.first_value import first_values
from tillwright.plans.skew import join_key_facts
from tillwright.plans.staging import stage

# Weekday names in calendar order, Monday first.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _known(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("customer_id").isNotNull())


def first_purchase(tx: DataFrame) -> DataFrame:
    """First purchase time per known customer."""
    return _known(tx).groupBy("customer_id").agg(F.min("invoice_ts").alias("first_purchase_ts"))


def with_first_purchase(tx: DataFrame) -> DataFrame:
    """Known-customer lines with their customer's first purchase time; very large customers are salted."""
    facts = _known(tx).groupBy("customer_id").agg(
        F.min("invoice_ts").alias("first_purchase_ts"), F.count(F.lit(1)).alias("_lines")
    )
    return join_key_facts(_known(tx), facts, "customer_id", "_lines")


def new_vs_repeat(tx: DataFrame) -> DataFrame:
    """Label known-customer lines New in the month of the first purchase, Repeat afterwards."""
    same_month = F.trunc("invoice_ts", "month") == F.trunc("first_purchase_ts", "month")
    return with_first_purchase(tx).withColumn("customer_type", F.when(same_month, "New").otherwise("Repeat"))


def monthly_customer_mix(tx: DataFrame) -> DataFrame:
    """New and repeat customers per month, their total, and the repeat percentage.

    Only the distinct (customer, month) pairs are needed: a customer's first month is New, later ones Repeat.
    The window therefore holds at most one row per month for a customer, however many lines it has.
    """
    pairs = (
        _known(tx)
        .filter(F.col("invoice_ts").isNotNull())
        .select("customer_id", month_of(F.col("invoice_ts")).alias("month"))
        .distinct()
    )
    first = F.min("month").over(Window.partitionBy("customer_id"))
    new, repeat = F.count_if(F.col("month") == F.col("_first")), F.count_if(F.col("month") != F.col("_first"))
    return (
        pairs.withColumn("_first", first)
        .groupBy("month")
        .agg(new.alias("new_customers"), repeat.alias("repeat_customers"), F.count(F.lit(1)).alias("total_customers"))
        .withColumn("repeat_customer_pct", percent_of(F.col("repeat_customers"), F.col("total_customers")))
    )


def customer_revenue(tx: DataFrame) -> DataFrame:
    """Revenue per known customer, largest first."""
    return (
        _known(tx)
        .groupBy("customer_id")
        .agg(money(F.sum("revenue")).alias("revenue"))
        .orderBy(F.desc("revenue"), "customer_id")
    )


def concentration(members: DataFrame, member: str, sizes: Sequence[int] = (10, 20), metric: str = "revenue") -> DataFrame:
    """Revenue of the top n members and its share of the total, for each n in ``sizes``."""
    members = stage(members.select(member, metric), "members")  # read for the total and for the leaders
    total = members.select(F.sum(metric)).scalar()
    leaders = members.orderBy(F.desc(metric), F.asc_nulls_last(member)).limit(max(sizes))
    place = F.row_number().over(Window.orderBy(F.desc(metric), F.asc_nulls_last(member)))  # at most max(sizes) rows
    row = leaders.withColumn("_place", place).agg(
        *[F.sum(F.when(F.col("_place") <= n, F.col(metric))).alias(str(n)) for n in sizes]
    )
    return row.unpivot([], [str(n) for n in sizes], "top_n", "top_revenue").select(
        F.col("top_n").cast("int").alias("top_n"), "top_revenue", total.alias("total_revenue"),
        percent_of(F.col("top_revenue"), total).alias("share_pct"),
    )


def product_profile(tx: DataFrame) -> DataFrame:
    """Per stock code: revenue, units of sale lines, orders, mean price and first non-null description."""
    measures = tx.filter(F.col("stock_code").isNotNull()).groupBy("stock_code").agg(
        money(F.sum("revenue")).alias("revenue"),
        zero_if_null(F.sum(positive(F.col("quantity")))).alias("units_sold"),
        F.count_distinct("invoice").alias("orders"),
        ratio(F.sum("price"), F.count("price")).alias("average_price"),
    )
    return measures.join(first_values(tx, "stock_code", "description", "invoice_ts", ["invoice"]), "stock_code", "left")


def top_product_profiles(tx: DataFrame, by: str = "revenue", n: int = 10) -> DataFrame:
    return product_profile(tx).orderBy(F.desc(by), "stock_code").limit(n)


def country_profile(tx: DataFrame) -> DataFrame:
    """Measures per country (units of sale lines) and the percentage of revenue, largest first.

    The orders are staged: they are far fewer than the lines, and the total is the sum of their exact revenues.
    """
    orders = stage(orders_by(tx, {"country": F.col("country")}, "sold").dropna(subset=["country"]), "country-orders")
    total = orders.select(money(F.sum("_revenue"))).scalar()
    measures = rollup_orders(orders, "country")
    return measures.withColumn("revenue_share_pct", percent_of(F.col("revenue"), total)).orderBy(
        F.desc("revenue"), "country"
    )


def country_lookup(tx: DataFrame, country: str) -> DataFrame:
    """The profile row of one country."""
    return country_profile(tx).filter(F.col("country") == country)


def calendar_columns(tx: DataFrame) -> DataFrame:
    """Add year, month, day, hour, weekday name and month name of the invoice time."""
    ts = F.col("invoice_ts")
    return tx.withColumns({
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts),
        "day_name": F.date_format(ts, "EEEE"), "month_name": F.date_format(ts, "MMMM"),
    })


def weekday_profile(tx: DataFrame) -> DataFrame:
    """Measures per weekday, Monday (0) first; units of sale lines."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return (
        measures_by(tx, {"weekday": F.weekday("invoice_ts")}, units="sold")
        .withColumn("day_name", F.element_at(names, F.col("weekday") + 1))
        .orderBy("weekday")
    )


def hourly_profile(tx: DataFrame) -> DataFrame:
    """Measures per hour of day; units of sale lines."""
    return measures_by(tx, {"hour": F.hour("invoice_ts")}, units="sold").orderBy("hour")


def best_worst(df: DataFrame, key: str, metric: str) -> DataFrame:
    """The rows with the largest and the smallest ``metric``; ties go to the smallest key, nulls are ignored."""
    row = F.struct(F.col(key).cast("string").alias("member"), F.col(metric).cast("double").alias("value"))
    extremes = df.filter(F.col(metric).isNotNull()).agg(
        F.min_by(row, F.struct(-F.col(metric), F.col(key))).alias("best"),
        F.min_by(row, F.struct(F.col(metric), F.col(key))).alias("worst"),
    )
    return extremes.unpivot([], ["best", "worst"], "kind", "_row").select(
        F.lit(metric).alias("metric"), "kind", "_row.member", "_row.value"
    )
