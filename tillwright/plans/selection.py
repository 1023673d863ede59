"""Exact values at given ranks, for many ranks and fields at once, without sorting a table.

Each round counts the values between a known minimum and maximum in buckets, and keeps for every wanted rank the one
bucket that holds it, with that bucket's own minimum and maximum. Counts combine inside the tasks, so a round shuffles
a few rows per task and the driver sees at most ``BUCKETS`` rows per wanted rank. Rounds end when a bucket has one
value, or when the buckets left hold so few values that these are fetched. Every size takes the same path.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

BUCKETS = 1_024
# Rows in the buckets left that may be fetched, as values with their counts, instead of being counted once more.
FETCHED = 20_000


@dataclass
class _Span:
    """``rows`` values of a field from ``low`` to ``high``, with ``below`` rows before them."""

    field: str
    low: object
    high: object
    rows: int
    below: int
    ranks: list[int]


@dataclass(frozen=True)
class Selected:
    """The value at a rank, and how many rows have smaller ones."""

    value: object
    below: int


def _same(a: object, b: object) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def _scaled(value: Column, integral: bool, even: bool) -> Column:
    """A number that does not fall as the value grows: every second round logarithmic, for values of many magnitudes."""
    if integral:
        return value.cast("decimal(20,0)")
    return value if even else F.signum(value) * F.log1p(F.abs(value))


def select_ranks(
    rows: DataFrame, wanted: dict[str, Iterable[int]], buckets: int = BUCKETS, fetched: int = FETCHED
) -> dict[tuple[str, int], Selected]:
    """The values at 1-based ``wanted`` ranks of each field of ``rows`` (columns ``field`` and ``value``, a number).

    Nulls are left out; NaN is the largest value, as in ``ORDER BY``. Ranks beyond a field's rows have no entry. ``rows``
    is scanned once per round: stage it if it is dear to compute.
    """
    spark, kind = rows.sparkSession, rows.schema["value"].dataType
    integral = isinstance(kind, IntegralType)
    known = rows.select("field", "value").filter(F.col("value").isNotNull())
    ends = known.groupBy("field").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    spans = []
    for end in ends.filter(F.col("field").isin(list(wanted))).collect():
        ranks = sorted({r for r in wanted[end["field"]] if 1 <= r <= end["n"]})
        spans += [_Span(end["field"], end["low"], end["high"], end["n"], 0, ranks)] if ranks else []
    found: dict[tuple[str, int], Selected] = {}
    even = True
    while True:
        found |= {(s.field, r): Selected(s.low, s.below) for s in spans if _same(s.low, s.high) for r in s.ranks}
        spans = [s for s in spans if not _same(s.low, s.high)]
        if not spans:
            return found
        # At most one row per wanted rank.
        local = spark.createDataFrame(
            [(i, s.field, s.low, s.high) for i, s in enumerate(spans)], f"span int, field string, low {kind.simpleString()}, high {kind.simpleString()}")
        inside = known.join(F.broadcast(local), "field").filter(F.col("value").between(F.col("low"), F.col("high")))
        if sum(s.rows for s in spans) <= fetched:
            values = inside.groupBy("span", "value").agg(F.count(F.lit(1)).alias("n")).collect()
            for i, s in enumerate(spans):
                own = sorted(((r["value"], r["n"]) for r in values if r["span"] == i), key=lambda x: (x[0] != x[0], x[0]))
                _walk(s, [(value, value, n) for value, n in own], found)
            return found
        place = lambda c: _scaled(F.col(c), integral, even)
        share = (place("value") - place("low")).cast("double") / F.nullif((place("high") - place("low")).cast("double"), F.lit(0.0))
        # The ends have buckets of their own, so that each round parts something whatever the arithmetic does.
        middle = F.greatest(F.lit(1), F.least(F.lit(buckets), F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * buckets))
        bucket = F.when(F.col("value") == F.col("low"), 0).when(F.col("value") == F.col("high"), buckets + 1).otherwise(F.floor(middle))
        counted = inside.groupBy("span", bucket.alias("bucket")).agg(
            F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        following: list[_Span] = []
        for i, s in enumerate(spans):
            parts = sorted((r["bucket"], r["low"], r["high"], r["n"]) for r in counted if r["span"] == i)
            following += _walk(s, [part[1:] for part in parts], found)
        spans, even = following, not even


def _walk(span: _Span, parts: list[tuple], found: dict) -> list[_Span]:
    """Which ascending parts (low, high, rows) of a span hold its ranks: single values are found, others returned."""
    below, left = span.below, []
    for low, high, n in parts:
        ranks = [r for r in span.ranks if below < r <= below + n]
        if ranks and _same(low, high):
            found.update({(span.field, r): Selected(low, below) for r in ranks})
        elif ranks:
            left.append(_Span(span.field, low, high, n, below, ranks))
        below += n
    return left
