"""One-sample t-test of a day's revenue against the calendar days before it, without leaving the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwright.functions.scalar import ratio, true_or_false


def student_t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom.

    For integer v the distribution function is a finite sum in theta = atan(|t| / sqrt(v)), whose terms follow
    from each other by a simple factor, so one fold over their indices gives it exactly. Cancellation limits
    tiny values to about 1e-15.
    """
    v = dof.cast("double")
    theta = F.atan(F.abs(t) / F.sqrt(v))
    cos_sq, sin = F.cos(theta) * F.cos(theta), F.sin(theta)
    odd = dof % 2 == 1
    # Index of the last term after the leading one.
    last = F.when(odd, (dof - 3) / 2).otherwise((dof - 2) / 2).cast("int")
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))

    def add_term(state: Column, k: Column) -> Column:
        factor = F.when(odd, (k * 2) / (k * 2 + 1)).otherwise((k * 2 - 1) / (k * 2)).cast("double")
        term = state["term"] * factor * cos_sq
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(
        steps, F.struct(first.alias("term"), first.alias("total")), add_term, lambda state: state["total"]
    )
    odd_area = (theta + F.when(dof >= 3, sin * series).otherwise(F.lit(0.0))) * (2 / math.pi)
    inside = F.when(odd, odd_area).otherwise(sin * series)
    return F.greatest(F.lit(0.0), F.lit(1.0) - inside)


def compare_anomaly_period(
    daily: DataFrame, dates: DataFrame, baseline_days: int = 30, alpha: float = 0.05, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Test each date's revenue (0 if absent) against the present days among the ``baseline_days`` before it.

    ``daily`` has date and revenue (and ``keys``), ``dates`` the dates to test (and ``keys``). The statistic is
    (baseline mean - day) / standard error, so a spike gives a negative t. Without baseline days everything is
    null; with one, or with a constant baseline equal to the day, the p-value is null; none of these is significant.
    A constant baseline that differs from the day has p = 0.

    Each tested date is expanded to the days before it, which turns the range condition into an equality join.
    """
    series = daily.select(*keys, F.col("date").alias("_day"), F.col("revenue").alias("_revenue"))
    targets = dates.select(*keys, "date").distinct()
    lags = F.sequence(F.lit(1), F.lit(baseline_days))
    own = targets.withColumn("_lag", F.lit(0))
    wanted = targets.withColumn("_lag", F.explode(lags)).unionByName(own)
    wanted = wanted.withColumn("_day", F.date_sub("date", F.col("_lag")))
    before = F.when(F.col("_lag") > 0, F.col("_revenue"))
    facts = (
        wanted.join(series, [*keys, "_day"], "left")
        .groupBy(*keys, "date")
        .agg(
            F.coalesce(F.max(F.when(F.col("_lag") == 0, F.col("_revenue"))), F.lit(0.0)).alias("anomaly_revenue"),
            F.count(before).alias("baseline_days"),
            F.avg(before).alias("baseline_mean"),
            F.stddev_samp(before).alias("baseline_std"),
        )
    )
    gap = F.col("baseline_mean") - F.col("anomaly_revenue")
    flat = F.col("baseline_std") == 0
    infinite = F.when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf")))
    standard_error = F.col("baseline_std") / F.sqrt("baseline_days")
    tested = facts.withColumn("t_statistic", F.when(flat, infinite).otherwise(ratio(gap, standard_error)))
    p = F.when(flat & (gap != 0), F.lit(0.0)).when(
        ~flat, student_t_two_sided_p(F.col("t_statistic"), F.col("baseline_days") - 1)
    )
    return tested.withColumn("p_value", p).withColumn("is_significant", true_or_false(F.col("p_value") < alpha))
