"""Data profiling and quality checks on raw and clean transaction lines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.functions.scalar import money, percent_of, true_or_false, zero_if_null
from tillwright.operators.cleaning import bad_debt, cancelled, line_revenue
from tillwright.plans.selection import FETCHED, select_ranks
from tillwright.plans.staging import stage

COPY_CHUNK = 10_000


def row_counts(df: DataFrame, name: str = "copies") -> DataFrame:
    """Distinct rows with how often each occurs; a hot row collapses to a counter before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(name))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column and their percentage, most first. One pass, one combined row per task."""
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return (
        row.unpivot(["_rows"], df.columns, "field", "nulls")
        .withColumn("null_pct", percent_of(F.col("nulls"), F.col("_rows")))
        .select("field", "nulls", "null_pct")
        .orderBy(F.desc("nulls"), "field")
    )


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Rows, rows beyond the first of each group of equal rows, and their percentage."""
    rows, extra = F.sum("copies"), F.sum(F.col("copies") - 1)
    return row_counts(df).agg(
        zero_if_null(rows).alias("rows"),
        zero_if_null(extra).alias("duplicate_rows"),
        percent_of(extra, rows).alias("duplicate_pct"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every member of every group of equal rows, in no particular order.

    Groups are counted rather than collected, then re-expanded in chunks spread over tasks, so a row with
    very many copies is neither gathered nor emitted by a single task (a sort would bring its copies together).
    """
    groups = row_counts(df, "_copies").filter(F.col("_copies") > 1)
    last = ((F.col("_copies") - 1) / COPY_CHUNK).cast("bigint")
    chunk = groups.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    size = F.least(F.col("_copies") - F.col("_chunk") * COPY_CHUNK, F.lit(COPY_CHUNK)).cast("int")
    spread = chunk.repartition(F.xxhash64(*df.columns, "_chunk"))
    return spread.select(*df.columns, F.explode(F.sequence(F.lit(1), size)).alias("_copy")).drop("_copy")


def duplicate_preview(
    df: DataFrame, n: int = 20, order: Sequence[str] = ("invoice", "stock_code", "invoice_ts")
) -> DataFrame:
    """The first ``n`` duplicated rows in ``order``: groups are ordered and cut before they are expanded."""
    places = [F.asc_nulls_last(c) for c in [*order, *[c for c in df.columns if c not in order]]]
    groups = row_counts(df, "_copies").filter(F.col("_copies") > 1).orderBy(*places).limit(n)
    size = F.least(F.col("_copies"), F.lit(n)).cast("int")
    return groups.select(*df.columns, F.explode(F.sequence(F.lit(1), size)).alias("_copy")).orderBy(*places).limit(n).drop("_copy")


def cardinality(df: DataFrame) -> DataFrame:
    """Rows, columns and distinct invoices, products, customers and countries (nulls excluded)."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.count_distinct("invoice").alias("invoices"),
        F.count_distinct("stock_code").alias("products"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("country").alias("countries"),
    )


def value_counts(df: DataFrame, column: str, n: int = 20, where: Column | None = None) -> DataFrame:
    """Most frequent non-null values, optionally among rows matching ``where``; ties by value."""
    rows = df if where is None else df.filter(where)
    return (
        rows.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(n)
    )


def date_range(df: DataFrame, by: str | None = None) -> DataFrame:
    """First and last timestamp, per ``by`` (such as the source part) and overall ('all')."""
    bounds = (F.min("invoice_ts").alias("first_ts"), F.max("invoice_ts").alias("last_ts"))
    if by is None:
        return df.agg(F.lit("all").alias("part"), *bounds)
    label = F.when(F.grouping(by) == 1, F.lit("all")).otherwise(F.col(by)).alias("part")
    return df.rollup(by).agg(label, *bounds).select("part", "first_ts", "last_ts")


def sign_profile(df: DataFrame, columns: Sequence[str] = ("quantity", "price", "revenue")) -> DataFrame:
    """Negative, zero and positive counts per column."""
    tests = {"negative": lambda c: c < 0, "zero": lambda c: c == 0, "positive": lambda c: c > 0}
    row = df.agg(*[
        F.struct(F.lit(c).alias("field"), *[F.count_if(test(F.col(c))).alias(t) for t, test in tests.items()]).alias(c)
        for c in columns
    ])
    return row.select(F.explode(F.array(*columns)).alias("p")).select("p.*")


def cancel_by_negative(df: DataFrame) -> DataFrame:
    """Crosstab of cancelled against negative quantity with totals; 'all' marks a total."""
    flags = df.select(
        cancelled(F.col("invoice")).alias("cancelled"), true_or_false(F.col("quantity") < 0).alias("negative")
    )

    def label(name: str) -> Column:
        return F.when(F.grouping(name) == 1, F.lit("all")).otherwise(F.col(name).cast("string"))

    counted = flags.cube("cancelled", "negative").agg(
        label("cancelled").alias("is_cancelled"), label("negative").alias("is_negative"), F.count(F.lit(1)).alias("rows")
    )
    return counted.select("is_cancelled", "is_negative", "rows")


def describe_numbers(df: DataFrame, columns: Sequence[str], fetched: int = FETCHED) -> DataFrame:
    """Count, mean, standard deviation, minimum, exact quartiles (linear interpolation) and maximum per column.

    The built-in exact percentile keeps every distinct value of a group in one task, and a global order sorts them all.
    Here the quartiles are selected by counts (``plans.selection``). The input is read once: its columns are staged.
    A column without values has no row.
    """
    numbers = stage(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "numbers")
    long = numbers.unpivot([], list(columns), "field", "value")
    known = F.col("value").isNotNull()
    first = long.groupBy("field").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    facts = {r["field"]: r for r in first.filter("count > 0").collect()}  # one row per column
    means = F.create_map(*[x for c, r in facts.items() for x in (F.lit(c), F.lit(r["mean"]))]) if facts else F.lit(None)
    squares = {}
    if facts:
        apart = F.sum(F.pow(F.col("value") - F.try_element_at(means, F.col("field")), F.lit(2))).alias("squares")
        squares = {r["field"]: r["squares"] for r in long.filter(known).groupBy("field").agg(apart).collect()}

    places = {(c, q): 1 + q * (r["count"] - 1) for c, r in facts.items() for q in (0.25, 0.5, 0.75)}
    wanted = {c: {edge for (f, _), p in places.items() if f == c for edge in (math.floor(p), math.ceil(p))} for c in facts}
    at = select_ranks(long, wanted, fetched=fetched)

    def row(c: str) -> tuple:
        r, n = facts[c], facts[c]["count"]
        quartiles = []
        for q in (0.25, 0.5, 0.75):
            place = places[c, q]
            low, high = at[c, math.floor(place)].value, at[c, math.ceil(place)].value
            quartiles.append(low + (high - low) * (place - math.floor(place)) if low != high else low)
        return c, n, r["mean"], math.sqrt(squares[c] / (n - 1)) if n > 1 else None, r["min"], *quartiles, r["max"]

    kind = "field string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    return df.sparkSession.createDataFrame([row(c) for c in columns if c in facts], kind)


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value (ties: smallest) and its frequency per column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "field", "value")
    frequency = long.filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("_n"))
    return frequency.groupBy("field").agg(
        F.sum("_n").alias("count"), F.count(F.lit(1)).alias("distinct_values"),
        F.min_by("value", F.struct(-F.col("_n"), F.col("value"))).alias("top"), F.max("_n").alias("freq"),
    )


def negative_price_impact(raw: DataFrame) -> DataFrame:
    """Number and revenue of lines with a negative price."""
    hit = raw.filter(F.col("price") < 0)
    return hit.agg(F.count(F.lit(1)).alias("rows"), money(F.sum(line_revenue(raw))).alias("revenue"))


def negative_price_by_description(raw: DataFrame, n: int = 20) -> DataFrame:
    """Lines with a negative price per description, largest loss first."""
    return (
        raw.filter((F.col("price") < 0) & F.col("description").isNotNull())
        .groupBy("description")
        .agg(F.count(F.lit(1)).alias("count"), money(F.sum(line_revenue(raw))).alias("sum"))
        .orderBy("sum", "description")
        .limit(n)
    )


def revenue_by_row_class(raw: DataFrame) -> DataFrame:
    """Rows, revenue and duplicates of cancelled lines, of other negative lines, and of the rest."""
    kind = (
        F.when(cancelled(F.col("invoice")), F.lit("cancelled"))
        .when(F.col("quantity") < 0, F.lit("negative"))
        .otherwise(F.lit("regular"))
    )
    return (
        row_counts(raw)
        .groupBy(kind.alias("row_class"))
        .agg(
            F.sum("copies").alias("rows"),
            money(F.sum(line_revenue(raw) * F.col("copies"))).alias("revenue"),
            F.sum(F.col("copies") - 1).alias("duplicate_rows"),
        )
    )


def missing_customer_profile(df: DataFrame) -> DataFrame:
    """Lines without a customer: how many, and their net quantity."""
    return df.filter(F.col("customer_id").isNull()).agg(
        F.count(F.lit(1)).alias("rows"), zero_if_null(F.sum("quantity")).alias("quantity")
    )


def missing_customer_countries(df: DataFrame, n: int = 10) -> DataFrame:
    return value_counts(df, "country", n, F.col("customer_id").isNull())


def clean_invariants(clean: DataFrame, rtol: float = 1e-9, atol: float = 1e-9) -> DataFrame:
    """What a clean set must not contain, plus its negative-revenue lines, in one pass."""
    counted = row_counts(clean)
    expected = line_revenue(clean).cast("double")
    off = F.abs(F.col("revenue").cast("double") - expected) > F.lit(atol) + F.lit(rtol) * F.abs(expected)

    def rows(condition: Column) -> Column:
        return zero_if_null(F.sum(F.when(condition, F.col("copies"))))

    return counted.agg(
        rows(cancelled(F.col("invoice"))).alias("cancelled_remaining"),
        zero_if_null(F.sum(F.col("copies") - 1)).alias("duplicates_remaining"),
        rows(bad_debt(F.col("description"))).alias("bad_debt_remaining"),
        rows(off | F.col("revenue").isNull()).alias("incorrect_revenue"),
        rows(F.col("revenue") < 0).alias("negative_revenue"),
    )


def _inspections() -> dict[str, Column]:
    is_cancelled = cancelled(F.col("invoice"))
    negative = F.col("quantity") < 0
    return {
        "negative_quantity": negative,
        "zero_price": F.col("price") == 0,
        "cancelled": is_cancelled,
        "uncancelled_negative": ~is_cancelled & negative,
        "cancelled_positive": is_cancelled & ~negative,
        "free_sales": (F.col("price") == 0) & (F.col("quantity") > 0),
        "negative_price": F.col("price") < 0,
        "negative_revenue": F.col("quantity") * F.col("price") < 0,
    }


INSPECTION_ORDER = ["invoice_ts", "invoice", "stock_code", "quantity", "price", "description", "customer_id", "country"]


def inspect_rows(df: DataFrame, view: str, n: int = 20) -> DataFrame:
    """The first ``n`` lines of a named view, in a fixed order."""
    views = _inspections()
    if view not in views:
        raise ValueError(f"Unknown view {view!r}; known: {sorted(views)}")
    return df.filter(views[view]).orderBy(*[F.asc_nulls_last(c) for c in INSPECTION_ORDER]).limit(n)


def inspection_views() -> list[str]:
    return list(_inspections())


def all_inspections(df: DataFrame, n: int = 20) -> DataFrame:
    """Every named view at once, labelled by ``view``, in one pass; each task keeps only its first ``n`` per view."""
    matching = F.array_compact(F.array(*[F.when(test, F.lit(view)) for view, test in _inspections().items()]))
    place = F.row_number().over(Window.partitionBy("view").orderBy(*[F.asc_nulls_last(c) for c in INSPECTION_ORDER]))
    labelled = df.withColumn("view", F.explode(matching))
    return labelled.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
