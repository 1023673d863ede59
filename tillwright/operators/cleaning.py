"""Cleaning rules for transaction lines and the report about their effect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType

from tillwright.functions.scalar import money, true_or_false

# Every character of the whitespace class that can surround a description.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
BAD_DEBT_TEXT = "adjust bad debt"


# Types of parsed text, wide enough for fractional quantities and prices finer than a penny.
QUANTITY, PRICE = "decimal(18,4)", "decimal(18,6)"
# Tried in order after ISO dates; month first where day and month could be confused.
DATE_FORMATS = ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "d.M.yyyy H:mm", "d.M.yyyy", "d-MMM-yyyy")


def coerce_types(
    df: DataFrame, quantity_type: str = QUANTITY, price_type: str = PRICE, date_formats: Sequence[str] = DATE_FORMATS
) -> DataFrame:
    """Parse text dates, quantities, prices and customer ids; what cannot be parsed becomes null.

    Columns that already have a type are left alone, and absent columns are skipped.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    number = {"quantity": quantity_type, "price": price_type, "customer_id": "bigint"}
    typed = {}
    for name, target in number.items():
        if name in text:
            # "13085.0" is a whole number in exported files, so whole types go through DECIMAL;
            # a fraction that the target type cannot hold is unparseable, not truncated.
            parsed = F.trim(name).try_cast("double" if target == "double" else "decimal(38,6)")
            typed[name] = F.when(parsed == parsed.try_cast(target), parsed.try_cast(target))
    if "invoice_ts" in text:
        moment = F.trim("invoice_ts")
        parsed = [F.try_to_timestamp(moment, F.lit(pattern)) for pattern in date_formats]
        typed["invoice_ts"] = F.coalesce(moment.try_cast("timestamp"), *parsed)
    return df.withColumns(typed) if typed else df


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows over all columns, nulls equal. Copies collapse inside each task before the shuffle."""
    return df.dropDuplicates()


def cancelled(invoice: Column) -> Column:
    """The invoice number starts with a capital C."""
    return true_or_false(invoice.startswith("C"))


def bad_debt(description: Column) -> Column:
    """The description, ignoring case and surrounding whitespace, is the accounting adjustment text."""
    text = F.lower(description)
    # Trimming the full whitespace class is dear, so only the few candidates are trimmed.
    return true_or_false(text.contains(BAD_DEBT_TEXT) & (F.trim(text, F.lit(WHITESPACE)) == BAD_DEBT_TEXT))


def line_revenue(df: DataFrame) -> Column:
    """quantity x price; decimal prices give an exact amount that still fits a 64-bit decimal."""
    amount = F.col("quantity") * F.col("price")
    price_type = df.schema["price"].dataType
    if isinstance(price_type, DecimalType):
        return amount.cast(DecimalType(18, price_type.scale))
    return amount


def flag_cancelled(df: DataFrame) -> DataFrame:
    return df.withColumn("is_cancelled", cancelled(F.col("invoice")))


def flag_return(df: DataFrame) -> DataFrame:
    """Negative quantity on a line that is not cancelled."""
    return df.withColumn(
        "is_return", true_or_false(F.col("quantity") < 0) & ~cancelled(F.col("invoice"))
    )


def flag_zero_price(df: DataFrame) -> DataFrame:
    return df.withColumn("is_zero_price", true_or_false(F.col("price") == 0))


def flag_bad_debt(df: DataFrame) -> DataFrame:
    return df.withColumn("is_bad_debt", bad_debt(F.col("description")))


def drop_cancelled_and_bad_debt(df: DataFrame) -> DataFrame:
    """Remove cancelled and accounting lines; returns and zero-price lines stay."""
    return df.filter(~cancelled(F.col("invoice")) & ~bad_debt(F.col("description")))


def add_revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue", line_revenue(df))


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Coerce, de-duplicate, flag, drop cancelled and accounting lines, add revenue. One shuffle.

    The drop depends only on the row's own values, so it is written before the de-duplication: fewer rows
    are shuffled, with the same result.
    """
    rows = drop_exact_duplicates(drop_cancelled_and_bad_debt(coerce_types(raw)))
    for rule in (flag_cancelled, flag_return, flag_zero_price, flag_bad_debt, add_revenue):
        rows = rule(rows)
    return rows


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Long metric/value table: what the raw rows contained and what the clean rows contain.

    Both sides come from one grouping by the full row, so raw data is shuffled once.
    """
    typed = coerce_types(raw)
    copies = typed.groupBy(*typed.columns).agg(F.count(F.lit(1)).alias("_copies"))
    lines = flag_zero_price(flag_return(flag_bad_debt(flag_cancelled(add_revenue(copies)))))
    kept = ~F.col("is_cancelled") & ~F.col("is_bad_debt")

    def raw_rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_copies"))), F.lit(0))

    def clean_rows(condition: Column) -> Column:
        return F.count_if(kept & true_or_false(condition))

    amount = F.col("revenue")
    metrics = {
        "raw_rows": raw_rows(F.lit(True)),
        "raw_duplicate_rows": F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)),
        "raw_cancelled_rows": raw_rows(F.col("is_cancelled")),
        "raw_bad_debt_rows": raw_rows(F.col("is_bad_debt")),
        "clean_rows": F.count_if(kept),
        "returns_retained": clean_rows(F.col("is_return")),
        "zero_price_retained": clean_rows(F.col("is_zero_price")),
        "bad_debt_remaining": clean_rows(F.col("is_bad_debt")),
        "missing_customers": clean_rows(F.col("customer_id").isNull()),
        "missing_descriptions": clean_rows(F.col("description").isNull()),
        "positive_revenue_rows": clean_rows(amount > 0),
        "negative_revenue_rows": clean_rows(amount < 0),
        "zero_revenue_rows": clean_rows(amount == 0),
        "total_revenue": money(F.sum(F.when(kept, amount))),
    }
    row = lines.agg(*[value.cast("double").alias(name) for name, value in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")
