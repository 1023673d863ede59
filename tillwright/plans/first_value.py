"""First value of each key by time, without sorting the lines.

Taking the value with the least (time, tie breakers) in one aggregate keeps text in the aggregation buffer, which makes
Spark sort its input. Here the earliest time of each (key, value) is a hash aggregate with one number per pair, combined
in the tasks. Where a key has several values at its earliest time, and only there, the lines of that time are looked at
again and the tie breakers decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.plans.staging import broadcast_if_small, stage


def first_values(lines: DataFrame, key: str, value: str, time: str, ties: Sequence[str]) -> DataFrame:
    """(key, value): ``value`` of the line with the least ``time`` of each key, equal times by ``ties`` and the value.

    Missing times and tie breakers come first, like in an ascending order. Lines without the key or the value are left
    out, so fill in ``value`` before if a missing one counts.
    """
    # A missing time is before every time.
    start = F.lit("0001-01-01").cast(lines.schema[time].dataType)
    known = lines.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).withColumn("_time", F.coalesce(time, start))
    firsts = stage(known.groupBy(key, value).agg(F.min("_time").alias("_time")), "first-times")
    earliest = firsts.groupBy(key).agg(F.min("_time").alias("_time"))
    reached = stage(firsts.join(earliest, [key, "_time"]), "first-values")
    several = stage(reached.groupBy(key, "_time").agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_only")), "first-counts")
    found = several.filter("_n = 1").select(key, F.col("_only").alias(value))
    tied = stage(several.filter("_n > 1").select(key, "_time"), "tied-keys")
    if tied.isEmpty():
        return found
    order = F.struct(*[F.col(c) for c in ties], F.col(value))
    decided = known.join(broadcast_if_small(tied), [key, "_time"], "left_semi").groupBy(key).agg(F.min_by(value, order).alias(value))
    return found.unionByName(decided)
