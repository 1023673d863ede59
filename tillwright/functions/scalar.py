"""Null-safe arithmetic and the row-level rules used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_if_null(value: Column) -> Column:
    """Sums of nothing are 0 here, not null."""
    return F.coalesce(value, F.lit(0))


def money(value: Column) -> Column:
    """An aggregated amount as DOUBLE; amounts stay exact decimals up to this point."""
    return zero_if_null(value).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def percent_of(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0 when the whole is zero or missing."""
    return F.coalesce(ratio(part, whole) * 100, F.lit(0.0))


def growth_pct(current: Column, previous: Column) -> Column:
    """Percentage growth against the signed previous value; null when that is zero or missing."""
    return ratio(current - previous, previous) * 100


def change_pct(current: Column, previous: Column) -> Column:
    """Percentage change against the size of the previous value; null when that is zero or missing."""
    return ratio(current - previous, F.abs(previous)) * 100


def positive(quantity: Column) -> Column:
    """The quantity of a sale line, null for returns, so that summing gives units sold gross of returns."""
    return F.when(quantity > 0, quantity)


def true_or_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def amount_text(value: Column) -> Column:
    """Thousands separators and two decimals."""
    return F.format_string("%,.2f", value.cast("double"))


def percent_text(value: Column) -> Column:
    return F.format_string("%.2f", value.cast("double"))


def clock_hour(hour: Column) -> Column:
    """9 -> '09:00'."""
    return F.format_string("%02d:00", hour.cast("int"))


def day_of(timestamp: Column) -> Column:
    return F.to_date(timestamp)


def month_of(timestamp: Column) -> Column:
    """Month label yyyy-MM."""
    return F.date_format(timestamp, "yyyy-MM")
