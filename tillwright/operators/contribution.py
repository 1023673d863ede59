"""Which products, customers, countries and hours make up the revenue of given days, for all days at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.functions.scalar import clock_hour, day_of, money, month_of, percent_of, zero_if_null
from tillwright.plans.staging import BROADCAST_ROWS, bounded_side, stage

# Columns identifying a member of each dimension.
MEMBERS = {
    "product": ["stock_code", "description"],
    "customer": ["customer_id"],
    "country": ["country"],
    "hour": ["hour"],
}
MEMBER_TYPES = {
    "stock_code": "string", "description": "string", "customer_id": "bigint", "country": "string", "hour": "int",
}
LINE_COLUMNS = ["invoice", "stock_code", "description", "quantity", "customer_id", "country", "revenue"]
Keys = tuple[str, ...]


def lines_on(tx: DataFrame, dates: DataFrame) -> DataFrame:
    """The lines of the given dates with their ``date`` and ``hour``.

    The distinct dates are staged and counted; within the bound they are broadcast, so transactions are filtered
    where they are read. Their first and last day bound the timestamp for file and row-group skipping, and where
    transactions are stored by ``month`` (see write_clean) all other months' partitions are left out.
    """
    days = stage(dates.select("date").distinct(), "dates")
    first, last, count = days.agg(F.min("date"), F.max("date"), F.count(F.lit(1))).first()
    moment = tx.schema["invoice_ts"].dataType
    near = tx.filter(
        (F.col("invoice_ts") >= F.lit(first).cast("date").cast(moment))
        & (F.col("invoice_ts") < F.date_add(F.lit(last).cast("date"), 1).cast(moment))
    )
    if "month" in tx.columns and count <= BROADCAST_ROWS:
        months = days.select(month_of(F.col("date"))).distinct().collect()
        near = near.filter(F.col("month").isin([m[0] for m in months]))
    stamped = near.withColumns({"date": day_of(F.col("invoice_ts")), "hour": F.hour("invoice_ts")})
    wanted = F.broadcast(days) if count <= BROADCAST_ROWS else days
    return stamped.join(wanted, "date", "left_semi").select("date", "hour", *LINE_COLUMNS)


def _best_first(members: list[str]) -> list[Column]:
    """Revenue descending, then the member ascending: a total order, so ties do not depend on row order."""
    return [F.desc("revenue"), *[F.asc_nulls_last(m) for m in members]]


def _measured(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Revenue (also as the exact sum that totals are made of), units and orders per key."""
    return rows.groupBy(*keys).agg(
        F.sum("revenue").alias("_exact"),
        money(F.sum("revenue")).alias("revenue"),
        zero_if_null(F.sum("quantity")).alias("units_sold"),
        F.count_distinct("invoice").alias("orders"),
        F.count(F.lit(1)).alias("lines"),
    )


def contribution(lines: DataFrame, dimension: str, top_n: int = 10, by: Keys = ("date",)) -> DataFrame:
    """Top members of a dimension per day by revenue, with units, orders and the percentage of the day.

    Shares refer to the whole day, for customers to the revenue of identified customers; a day without
    revenue has share 0. The lines are read once: measures per member are staged, and totals are the sums of their
    exact revenues. The constant rank limit is applied inside each task before the shuffle, so a day that holds a
    large part of all members is never gathered.
    """
    members = MEMBERS[dimension]
    rows = lines.filter(F.col("customer_id").isNotNull()) if dimension == "customer" else lines
    measures = stage(_measured(rows, [*by, *members]), "members")
    totals = measures.groupBy(*by).agg(money(F.sum("_exact")).alias("_whole"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*_best_first(members)))
    top = measures.withColumn("rank", place).filter(F.col("rank") <= top_n)
    return (
        top.join(totals, list(by))
        .withColumn("revenue_share_pct", percent_of(F.col("revenue"), F.col("_whole")))
        .select(*by, "rank", *members, "revenue", "units_sold", "orders", "revenue_share_pct")
    )


def product_contribution(tx: DataFrame, dates: DataFrame, top_n: int = 10) -> DataFrame:
    """Top (stock code, description) pairs per date; a missing description is a member of its own."""
    return contribution(lines_on(tx, dates), "product", top_n)


def customer_contribution(tx: DataFrame, dates: DataFrame, top_n: int = 10) -> DataFrame:
    """Top known customers per date, as shares of identified-customer revenue."""
    return contribution(lines_on(tx, dates), "customer", top_n)


def country_contribution(tx: DataFrame, dates: DataFrame, top_n: int = 10) -> DataFrame:
    """Top countries per date; a missing country is a member of its own."""
    return contribution(lines_on(tx, dates), "country", top_n)


def time_contribution(tx: DataFrame, dates: DataFrame, top_n: int = 10) -> DataFrame:
    """Top hours of day per date."""
    return contribution(lines_on(tx, dates), "hour", top_n)


def member_measures(lines: DataFrame, by: Keys = ("date",)) -> DataFrame:
    """Measures of every member of every dimension: by, dimension, every member column (null where foreign), measures
    and the number of lines; staged.

    One pass: each line is emitted once per dimension with that dimension's member, so the four dimensions share a
    scan and one chain of shuffles instead of four. Skew is handled as in ``contribution``.
    """

    def member(dimension: str) -> Column:
        fields = [
            (F.col(m) if m in MEMBERS[dimension] else F.lit(None)).cast(kind).alias(m)
            for m, kind in MEMBER_TYPES.items()
        ]
        made = F.struct(F.lit(dimension).alias("dimension"), *fields)
        return F.when(F.col("customer_id").isNotNull(), made) if dimension == "customer" else made

    members = F.array_compact(F.array(*[member(d) for d in MEMBERS]))
    long = lines.select(*by, "invoice", "quantity", "revenue", F.inline(members))
    return stage(_measured(long, [*by, "dimension", *MEMBER_TYPES]), "members")


def member_lists(measures: DataFrame, top_n: int = 10, hour_top_n: int | None = None, by: Keys = ("date",)) -> DataFrame:
    """The first members of each dimension by revenue, with their ``rank``."""
    hours = top_n if hour_top_n is None else hour_top_n
    place = F.row_number().over(Window.partitionBy(*by, "dimension").orderBy(*_best_first(list(MEMBER_TYPES))))
    top = measures.withColumn("rank", place).filter(F.col("rank") <= max(top_n, hours))
    return top.filter(F.col("rank") <= F.when(F.col("dimension") == "hour", hours).otherwise(top_n))


def dimension_totals(measures: DataFrame, by: Keys = ("date",)) -> DataFrame:
    """``_whole``: revenue of all members of a dimension."""
    return measures.groupBy(*by, "dimension").agg(money(F.sum("_exact")).alias("_whole"))


def with_shares(listed: DataFrame, totals: DataFrame, by: Keys = ("date",)) -> DataFrame:
    return (
        listed.join(totals, [*by, "dimension"])
        .withColumn("revenue_share_pct", percent_of(F.col("revenue"), F.col("_whole")))
        .select(*by, "dimension", "rank", *MEMBER_TYPES, "revenue", "units_sold", "orders", "revenue_share_pct")
    )


def all_contributions(
    lines: DataFrame, top_n: int = 10, hour_top_n: int | None = None, by: Keys = ("date",)
) -> DataFrame:
    """The four lists in one table: by, dimension, rank, every member column (null where foreign), measures."""
    return contributions_from(member_measures(lines, by), top_n, hour_top_n, by)


def contributions_from(
    measures: DataFrame, top_n: int = 10, hour_top_n: int | None = None, by: Keys = ("date",)
) -> DataFrame:
    """``all_contributions`` of stored member measures."""
    return with_shares(member_lists(measures, top_n, hour_top_n, by), dimension_totals(measures, by), by)


def member_label() -> Column:
    """Readable name of a member row of all_contributions."""
    return (
        F.when(F.col("dimension") == "product", F.col("description"))
        .when(F.col("dimension") == "customer", F.col("customer_id").cast("string"))
        .when(F.col("dimension") == "country", F.col("country"))
        .otherwise(clock_hour(F.col("hour")))
    )


def rank_root_causes(contributions: DataFrame, top_n: int = 10, by: Keys = ("date",)) -> DataFrame:
    """The strongest members over all dimensions per day, by share and then revenue.

    Only the already limited lists are ranked: at most four times their limit per day. Shares are compared after
    rounding, so that members with equal revenue tie (and fall back to dimension and rank) whatever the summation order.
    """
    order = [F.round("revenue_share_pct", 9).desc(), F.round("revenue", 4).desc(), "dimension", "rank"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return (
        contributions.withColumn("cause_rank", place)
        .filter(F.col("cause_rank") <= top_n)
        .select(
            *by, "cause_rank", "dimension", member_label().alias("cause"), "revenue",
            F.col("revenue_share_pct").alias("contribution_pct"), "orders", F.col("units_sold").alias("units"),
        )
    )


def top_members(contributions: DataFrame, by: Keys = ("date",)) -> DataFrame:
    """One row per day with the rank-1 member of each dimension as a struct; null where a dimension is empty."""

    def leader(dimension: str, fields: list[Column]) -> Column:
        chosen = (F.col("dimension") == dimension) & (F.col("rank") == 1)
        return F.max(F.when(chosen, F.struct(*fields)))

    shared = [F.col("revenue"), F.col("revenue_share_pct").alias("contribution_pct")]
    return contributions.groupBy(*by).agg(
        leader("product", [F.col("stock_code"), F.col("description"), *shared]).alias("top_product"),
        leader("customer", [F.col("customer_id"), *shared]).alias("top_customer"),
        leader("country", [F.col("country"), *shared]).alias("top_country"),
        leader("hour", [F.col("hour"), *shared]).alias("top_hour"),
    )


def _intersection_measures(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        money(F.sum("revenue")).alias("revenue"),
        zero_if_null(F.sum("quantity")).alias("units_sold"),
        F.count_distinct("invoice").alias("orders"),
        F.count(F.lit(1)).alias("transaction_rows"),
    )


def intersection(
    tx: DataFrame,
    dates: DataFrame,
    customer_id: int | None = None,
    stock_code: str | None = None,
    country: str | None = None,
    hour: int | None = None,
) -> DataFrame:
    """Measures of the lines matching every given member on each date; a date without such lines has no row."""
    rows = lines_on(tx, dates)
    wanted = {"customer_id": customer_id, "stock_code": stock_code, "country": country, "hour": hour}
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return _intersection_measures(rows, "date")


def intersections(lines: DataFrame, members: DataFrame) -> DataFrame:
    """Batch form: each date with its own members (see top_members); a dimension without member sets no condition.

    ``members`` has one row per date of ``lines``; it is staged and broadcast within the counted bound.
    """
    chosen = members.select(
        "date",
        F.col("top_customer").isNotNull().alias("_by_customer"), F.col("top_customer.customer_id").alias("_customer"),
        F.col("top_product").isNotNull().alias("_by_product"), F.col("top_product.stock_code").alias("_product"),
        F.col("top_country").isNotNull().alias("_by_country"), F.col("top_country.country").alias("_country"),
        F.col("top_hour").isNotNull().alias("_by_hour"), F.col("top_hour.hour").alias("_hour"),
    )
    matched = lines.join(bounded_side(chosen, "members"), "date")
    for dimension, column in (
        ("customer", "customer_id"), ("product", "stock_code"), ("country", "country"), ("hour", "hour"),
    ):
        matched = matched.filter(~F.col(f"_by_{dimension}") | (F.col(column) == F.col(f"_{dimension}")))
    return _intersection_measures(matched, "date")
