"""Daily rollup of transactions whose distinct counts can be merged: days to months, to any period, to the whole.

Distinct counts of days can't be added up. The rollup keeps, per day and kind (invoice, customer, product, country), the
set of members as bitmaps. Members are numbered once, each task's in the order of their first day, so that the
invoices of a day fill few bitmaps densely. Counting any period is a bit-wise union; no line is read again, and no row
is replicated for each thing that is counted.

A bitmap has 32,768 members in 4 KB. Lines are combined to a row per member with its days before they are shuffled, the
only time per kind, so a day or member that owns a large part of the lines is no larger than its different pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwright.functions.scalar import day_of, money, month_of, positive, ratio, ratio_or_zero, zero_if_null
from tillwright.operators.kpi import with_growth
from tillwright.plans.staging import shared_path, stage

# What is counted, and the column whose values are its members.
KINDS = {"invoices": "invoice", "customers": "customer_id", "products": "stock_code", "countries": "country"}
# Default precision of approximate counts: 2**12 registers.
SKETCH_LG = 12


@dataclass(frozen=True)
class Rollup:
    """``measures``: date, rows, revenue, net and sold units. ``members``: date, kind, bucket and bitmap."""

    measures: DataFrame
    members: DataFrame


def number_members(pairs: DataFrame) -> DataFrame:
    """(member, dates, number) of each member of ``pairs`` (date, member): its different dates, and a number from 1 on, with gaps
    between tasks, in the order of first dates within a task.

    Dates are combined before the shuffle, so a member has at most as many as there are days. Rows of a task are in one total
    order when they are numbered, so a task that runs again gives the same numbers.
    """
    members = pairs.groupBy("member").agg(F.collect_set("date").alias("_known"), F.bool_or(F.col("date").isNull()).alias("_undated"))
    none = F.array(F.lit(None).cast("date"))
    ordered = members.sortWithinPartitions(F.array_min("_known").asc_nulls_last(), "member")
    return ordered.select(
        "member", F.when(F.col("_undated"), F.concat("_known", none)).otherwise(F.col("_known")).alias("dates"),
        (F.monotonically_increasing_id() + 1).alias("number"))


def _bitmaps(tx: DataFrame, kind: str) -> DataFrame:
    """(date, bucket, bitmap) of one kind. One row per member is spread over its dates, never a line."""
    pairs = tx.select(day_of(F.col("invoice_ts")).alias("date"), F.col(KINDS[kind]).alias("member")).filter("member is not null")
    numbered = number_members(pairs).select("number", F.explode("dates").alias("date"))
    # All members of a bucket were numbered by one task, so bitmaps are complete before they are shuffled.
    return numbered.groupBy("date", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))


def day_members(tx: DataFrame, kind: str) -> DataFrame:
    """Bitmaps of the members of one kind per day, staged; rows without the member do not count."""
    staged = stage(_bitmaps(tx, kind), f"days-of-{kind}")
    return staged.select("date", F.lit(kind).alias("kind"), "bucket", "bitmap")


def write_rollup(tx: DataFrame, path: str, kinds: tuple[str, ...] = tuple(KINDS)) -> Rollup:
    """Build the rollup of transactions below ``path`` and return it. Lines without a date are kept under a null date."""
    for kind in kinds:
        _bitmaps(tx, kind).write.mode("overwrite").parquet(f"{path}/members/kind={kind}")
    units = F.col("quantity")
    measures = tx.groupBy(day_of(F.col("invoice_ts")).alias("date")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("revenue").alias("revenue"),
        F.sum(units).alias("net_units"), F.sum(positive(units)).alias("sold_units"),
    )
    measures.write.mode("overwrite").parquet(f"{path}/measures")
    return read_rollup(tx.sparkSession, path)


def build_rollup(tx: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> Rollup:
    """``write_rollup`` into the shared folder."""
    return write_rollup(tx, shared_path(tx.sparkSession, "rollup"), kinds)


def read_rollup(spark: SparkSession, path: str) -> Rollup:
    return Rollup(spark.read.parquet(f"{path}/measures"), spark.read.parquet(f"{path}/members"))


def within(rollup: Rollup, first=None, last=None) -> Rollup:
    """The days from ``first`` to ``last``, both included; with either, lines without a date are left out."""
    inside = F.lit(True)
    inside = inside & (F.col("date") >= F.lit(first)) if first else inside
    inside = inside & (F.col("date") <= F.lit(last)) if last else inside
    return Rollup(rollup.measures.filter(inside), rollup.members.filter(inside))


def member_counts(rollup: Rollup, key: Column | None = None) -> DataFrame:
    """Distinct members per ``key`` (an expression over ``date``; one row without it), a column per kind.

    Days are united per bucket; buckets hold different members, so their counts add up.
    """
    keyed = rollup.members.withColumn("key", F.lit(0) if key is None else key)
    merged = keyed.groupBy("key", "kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    return merged.groupBy("key").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in KINDS])


def _per(rollup: Rollup, name: str, key: Column, units: str) -> DataFrame:
    sums = rollup.measures.groupBy(key.alias("key")).agg(
        money(F.sum("revenue")).alias("revenue"), zero_if_null(F.sum(f"{units}_units")).alias("units_sold"))
    both = sums.join(member_counts(rollup, key), "key", "left").na.fill(0, ["invoices", "customers"])
    return both.filter("key is not null").select(
        F.col("key").alias(name), "revenue", F.col("invoices").alias("orders"), "customers", "units_sold",
        ratio(F.col("revenue"), F.col("invoices")).alias("aov"))


def daily_from(rollup: Rollup, units: str = "net") -> DataFrame:
    """``daily_metrics`` of the rollup's transactions."""
    return _per(rollup, "date", F.col("date"), units)


def monthly_from(rollup: Rollup, units: str = "sold") -> DataFrame:
    """``monthly_metrics`` of the rollup's transactions."""
    return with_growth(_per(rollup, "month", month_of(F.col("date")), units))


def summary_from(rollup: Rollup, units: str = "net") -> DataFrame:
    """``dataset_summary`` of the rollup's transactions, or of the days that ``within`` left."""
    sums = rollup.measures.agg(
        money(F.sum("revenue")).alias("revenue"), zero_if_null(F.sum(f"{units}_units")).alias("units"))
    one = sums.crossJoin(member_counts_or_none(rollup))  # one row each
    return one.select(
        F.col("revenue").alias("total_revenue"), F.col("invoices").alias("total_orders"), F.col("customers").alias("total_customers"),
        F.col("units").alias("total_units_sold"), ratio_or_zero(F.col("revenue"), F.col("invoices")).alias("average_order_value"),
        ratio_or_zero(F.col("revenue"), F.col("customers")).alias("average_revenue_per_customer"))


def member_counts_or_none(rollup: Rollup) -> DataFrame:
    """``member_counts`` of all days, one row of zeros for no member at all."""
    return member_counts(rollup).agg(*[F.coalesce(F.max(k), F.lit(0)).alias(k) for k in KINDS])


def cardinality_from(rollup: Rollup, columns: int) -> DataFrame:
    """``cardinality`` of the lines of the rollup, which have ``columns`` columns."""
    rows = rollup.measures.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return rows.crossJoin(member_counts_or_none(rollup)).select("rows", F.lit(columns).alias("columns"), *KINDS)  # one row each


def day_sketches(tx: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """HyperLogLog sketches of the members of every kind per day, from one combined pass over the lines.

    They merge like the bitmaps, in 2**lg bytes or less each, at a relative standard error of about 1.04 / sqrt(2**lg), 1.6 percent at the default.
    """
    return tx.groupBy(day_of(F.col("invoice_ts")).alias("date")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.hll_sketch_agg(F.col(column).cast("string"), F.lit(lg)).alias(kind) for kind, column in KINDS.items()])


def approximate_cardinality(sketches: DataFrame, columns: int) -> DataFrame:
    """``cardinality`` with estimated counts, from the sketches of any days."""
    counts = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(kind)), F.lit(0)).alias(kind) for kind in KINDS]
    return sketches.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.lit(columns).alias("columns"), *counts)
