"""Exact global order without sending a whole table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.plans.staging import stage

# Up to this many rows a single ordered window is cheaper than a range-partitioned pass.
SINGLE_WINDOW_ROWS = 1_000_000
SLICE_ROWS = 500_000
# Slices are also the rows of the offset table; beyond this many they grow instead.
MAX_SLICES = 20_000


def running_total(
    df: DataFrame,
    order: list[Column],
    name: str,
    weight: Column | None = None,
    rows: int | None = None,
    single_window_rows: int = SINGLE_WINDOW_ROWS,
) -> DataFrame:
    """Add ``name``: the sum of ``weight`` (default 1) over all rows up to and including this one.

    ``order`` must be a total order. With weight 1 the result is the global row number.
    Small inputs use one ordered window. Larger ones are range-partitioned into slices that are
    staged (so that the slice of a row is fixed), totalled per slice, and numbered per slice;
    the slice offsets are one row per slice.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    rows = df.count() if rows is None else rows
    if rows <= single_window_rows:
        frame = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.sum(weight).over(frame))

    slices = min(MAX_SLICES, max(2, -(-rows // min(SLICE_ROWS, max(1, single_window_rows)))))
    sliced = stage(
        df.withColumn("_weight", weight)
        .repartitionByRange(slices, *order)
        .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_slice")
        .agg(F.sum("_weight").alias("_slice_weight"))
        .withColumn("_offset", F.coalesce(F.sum("_slice_weight").over(before), F.lit(0)))
        .select("_slice", "_offset")
    )
    inside = (
        Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # One offset row per slice, at most MAX_SLICES.
    return (
        sliced.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.sum("_weight").over(inside) + F.col("_offset"))
        .drop("_slice", "_offset", "_weight")
    )
