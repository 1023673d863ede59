"""Per-day stratified sampling to an exact number of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.functions.scalar import day_of
from tillwright.plans.staging import stage

COPY_CHUNK = 1_000
HASH_BUCKET_BITS = 16
# Rows of one group that are ranked in a task at most (but for draws that are equal in all their 64 bits).
BOUNDARY_ROWS = 100_000
# Largest rank limit that Spark applies inside tasks by default.
GROUP_LIMIT = 1_000


def _draws(seed: int, place: list[str]) -> Column:
    """A 128-bit seeded random order key of a line."""
    return F.struct(F.xxhash64(F.lit(seed), *place).alias("a"), F.xxhash64(F.lit(seed + 1), *place).alias("b"))


def _numbered_lines(tx: DataFrame, seed: int, distinct: bool) -> DataFrame:
    """Lines with their day and a seeded random order key that differs between copies of the same line.

    Lines known to be distinct need no shuffle. Otherwise copies are counted first (combined before the shuffle)
    and re-created in chunks, so that every copy draws its own place in the random order.
    """
    columns = tx.columns
    dated = tx.filter(F.col("invoice_ts").isNotNull())
    if distinct:
        return dated.select(*columns, day_of(F.col("invoice_ts")).alias("_date"), _draws(seed, columns).alias("_draw"))
    copies = dated.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    last_chunk = ((F.col("_copies") - 1) / COPY_CHUNK).cast("bigint")
    chunk_size = F.least(F.col("_copies") - F.col("_chunk") * COPY_CHUNK, F.lit(COPY_CHUNK))
    chunks = copies.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
    lines = chunks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), chunk_size)))
    place = [*columns, "_chunk", "_copy"]
    return lines.select(
        *columns,
        day_of(F.col("invoice_ts")).alias("_date"),
        _draws(seed, place).alias("_draw"),
    )


def _first_by_draw(lines: DataFrame, wanted: int, group: str, boundary_rows: int | None = None) -> DataFrame:
    """Exactly the ``wanted`` rows of each group with the smallest draw, without ranking whole groups.

    A histogram over the leading bits of the draw (a fixed number of buckets per group) finds the bucket in which a
    group reaches the wanted count. Earlier buckets are taken whole; the rows of the boundary bucket are staged and
    looked at by the next bits, until no group has more than ``boundary_rows`` of them left, and only those are ranked.
    ``group`` has at most one value per calendar day, so the boundaries can be broadcast.
    """
    most = BOUNDARY_ROWS if boundary_rows is None else boundary_rows
    left, taken = lines.withColumn("_need", F.lit(wanted).cast("bigint")), []
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    for used in range(0, 64, HASH_BUCKET_BITS):
        # The first bits keep the sign, by which draws are ordered; the bits behind them have none.
        shift = F.shiftright if used == 0 else F.shiftrightunsigned
        bucketed = left.withColumn("_bucket", shift(F.shiftleft(F.col("_draw.a"), used), 64 - HASH_BUCKET_BITS))
        boundary = stage(
            bucketed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"), F.max("_need").alias("_wanted"))
            .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
            .filter(F.col("_before") < F.col("_wanted"))
            .groupBy(group)
            .agg(F.max("_bucket").alias("_edge"), F.max("_before").alias("_before"), F.max_by("_rows", "_bucket").alias("_there")),
            "boundary",
        )
        near = bucketed.join(F.broadcast(boundary), group).filter(F.col("_bucket") <= F.col("_edge"))
        taken.append(near.filter(F.col("_bucket") < F.col("_edge")).select(*lines.columns))
        left = near.filter(F.col("_bucket") == F.col("_edge")).select(*lines.columns, (F.col("_need") - F.col("_before")).alias("_need"))
        if (boundary.select(F.max("_there")).first()[0] or 0) <= most:
            break
        left = stage(left, "boundary-rows")
    place = F.row_number().over(Window.partitionBy(group).orderBy("_draw"))
    taken.append(left.withColumn("_place", place).filter(F.col("_place") <= F.col("_need")).select(*lines.columns))
    return reduce(lambda a, b: a.unionByName(b), taken)


def stratified_day_sample(tx: DataFrame, target_rows: int, seed: int = 42, distinct: bool = False) -> DataFrame:
    """``max(1, target // days)`` random lines per day (all of a smaller day), then random others up to the target.

    The same seed and data give the same sample whatever the partitioning. The result is ordered by time.
    Set ``distinct`` for input without repeated lines, such as a stored clean set: the sample is then drawn by
    narrow scans of it.
    """
    lines = _numbered_lines(tx, seed, distinct)
    days = tx.select(F.count_distinct(day_of(F.col("invoice_ts")))).first()[0]
    if days == 0:
        return tx.limit(0)
    quota = max(1, target_rows // days)
    if quota <= GROUP_LIMIT:
        # A constant rank limit lets Spark cut each day to the quota inside every task before the shuffle.
        rank = F.row_number().over(Window.partitionBy("_date").orderBy("_draw"))
        chosen = lines.withColumn("_rank", rank).filter(F.col("_rank") <= quota).drop("_rank")
    else:
        chosen = _first_by_draw(lines, quota, "_date")

    per_day = chosen.groupBy("_date").agg(F.count(F.lit(1)).alias("_taken"), F.max("_draw").alias("_last"))
    missing = target_rows - per_day.agg(F.coalesce(F.sum("_taken"), F.lit(0))).first()[0]
    if missing > 0:
        # One row per calendar day; everything after a day's last chosen draw was not chosen.
        cut = F.broadcast(per_day.select("_date", "_last"))
        rest = lines.join(cut, "_date").filter(F.col("_draw") > F.col("_last")).select(*lines.columns)
        one = rest.withColumn("_all", F.lit(0))
        chosen = chosen.unionByName(_first_by_draw(one, missing, "_all").drop("_all"))
    return chosen.select(*tx.columns).orderBy("invoice_ts", "invoice", "stock_code")
