"""Recency, frequency and monetary value per customer; scores, segments and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.functions.scalar import money, percent_of
from tillwright.plans.selection import FETCHED, select_ranks
from tillwright.plans.staging import stage


def rfm(tx: DataFrame) -> DataFrame:
    """Whole 24-hour periods since the last purchase, distinct invoices and revenue per known customer."""
    known = tx.filter(F.col("customer_id").isNotNull())
    per_customer = known.groupBy("customer_id").agg(
        F.max("invoice_ts").alias("last_purchase_ts"),
        F.count_distinct("invoice").alias("frequency"),
        money(F.sum("revenue")).alias("monetary"),
    )
    # The last purchase of all is the latest of the customers' own, so the lines are read once.
    per_customer = stage(per_customer, "customers")
    reference = per_customer.select(F.max("last_purchase_ts")).scalar()
    elapsed = reference - F.col("last_purchase_ts")
    return per_customer.select(
        "customer_id", F.extract(F.lit("DAY"), elapsed).cast("int").alias("recency"),
        "frequency", "monetary", "last_purchase_ts",
    )


METRICS = ("recency", "frequency", "monetary")
BINS = 5


def score_bounds(scored: DataFrame, rows: int, fetched: int = FETCHED) -> dict[str, list[tuple[float, int]]]:
    """Per metric the last (value, customer id) of each bin but the highest, in the order of value and id.

    Bins are those of linear quantile edges over 1-based ranks, right-closed. Two selections over all metrics at once:
    the values at the edges, and the ids at which equal values are parted.
    """
    edges = [1 + b * (rows - 1) // BINS for b in range(1, BINS)]
    values = [F.coalesce(F.col(m).cast("double"), F.lit(float("-inf"))).alias(m) for m in METRICS]  # nulls come first
    long = scored.select("customer_id", *values).unpivot(["customer_id"], list(METRICS), "metric", "number")
    at = select_ranks(long.select(F.col("metric").alias("field"), F.col("number").alias("value")), {m: edges for m in METRICS}, fetched=fetched)
    tied = {(m, at[m, r].value): at[m, r].below for m in METRICS for r in edges}
    # At most four values per metric.
    local = scored.sparkSession.createDataFrame([(f"{m}/{v!r}", m, v) for m, v in tied], "field string, metric string, number double")
    among = long.join(F.broadcast(local), ["metric", "number"]).select("field", F.col("customer_id").alias("value"))
    wanted: dict[str, list[int]] = {}
    for m in METRICS:
        for r in edges:
            wanted.setdefault(f"{m}/{at[m, r].value!r}", []).append(r - at[m, r].below)
    ids = select_ranks(among, wanted, fetched=fetched)
    return {m: [(at[m, r].value, ids[f"{m}/{at[m, r].value!r}", r - at[m, r].below].value) for r in edges] for m in METRICS}


def rfm_scores(scored: DataFrame, fetched: int = FETCHED) -> DataFrame:
    """Quintile scores of first-come ranks, customer id breaking ties; low recency scores high. A single customer has none.

    No global order is built: the customers at the edges of the bins are selected by counts (``plans.selection``), and
    each row is compared with them where it is.
    """
    staged = stage(scored, "rfm")
    rows = staged.count()
    if rows < 2:
        return staged.withColumns({f"{m[0]}_score": F.lit(None).cast("int") for m in METRICS})
    bounds = score_bounds(staged, rows, fetched)

    def bin_of(metric: str) -> Column:
        own = F.struct(F.coalesce(F.col(metric).cast("double"), F.lit(float("-inf"))).alias("v"), F.col("customer_id").cast("bigint").alias("i"))
        past = [F.when(own > F.struct(F.lit(v).alias("v"), F.lit(i).cast("bigint").alias("i")), 1).otherwise(0) for v, i in bounds[metric]]
        return (F.lit(1) + past[0] + past[1] + past[2] + past[3]).cast("int")

    return staged.withColumns({
        "r_score": (F.lit(BINS + 1) - bin_of("recency")).cast("int"), "f_score": bin_of("frequency"), "m_score": bin_of("monetary"),
    })


def rfm_combined(scores: DataFrame) -> DataFrame:
    """The three digits as text, and their sum."""
    parts = ("r_score", "f_score", "m_score")
    return scores.withColumns({
        "rfm_score": F.concat(*[F.col(p).cast("string") for p in parts]),
        "rfm_total": F.col("r_score") + F.col("f_score") + F.col("m_score"),
    })


# Segments in order of precedence, with the scores (lowest, highest) each asks for.
SEGMENTS = {
    "Champions": {"r": (4, 5), "f": (4, 5), "m": (4, 5)},
    "Loyal Customers": {"r": (3, 5), "f": (4, 5)},
    "Big Spenders": {"r": (3, 5), "m": (4, 5)},
    "New Customers": {"r": (4, 5), "f": (1, 2)},
    "At Risk": {"r": (1, 2), "f": (3, 5), "m": (3, 5)},
    "Hibernating": {"r": (1, 2), "f": (1, 2)},
    "Potential Loyalists": {"r": (3, 5), "f": (3, 5)},
}
OTHER_SEGMENT = "Others"


def segment() -> Column:
    """Segment of the row's scores: the first entry of SEGMENTS whose ranges hold."""
    matches = []
    for label, ranges in SEGMENTS.items():
        holds = F.lit(True)
        for score, (lowest, highest) in ranges.items():
            holds = holds & F.col(f"{score}_score").between(lowest, highest)
        matches.append(F.when(holds, F.lit(label)))
    return F.coalesce(*matches, F.lit(OTHER_SEGMENT))


def rfm_segment(scores: DataFrame) -> DataFrame:
    return scores.withColumn("segment", segment())


def rfm_table(tx: DataFrame) -> DataFrame:
    """Metrics, scores, combined score and segment per known customer."""
    return rfm_segment(rfm_combined(rfm_scores(rfm(tx))))


def segment_summary(segments: DataFrame) -> DataFrame:
    """Customers, revenue, mean metrics and shares per segment, by revenue descending."""
    everything = Window.partitionBy()  # at most one row per segment
    return (
        segments.groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("revenue"),
            F.avg("recency").alias("avg_recency"), F.avg("frequency").alias("avg_frequency"),
            F.avg("monetary").alias("avg_monetary"),
        )
        .withColumn("customer_share_pct", percent_of(F.col("customers"), F.sum("customers").over(everything)))
        .withColumn("revenue_share_pct", percent_of(F.col("revenue"), F.sum("revenue").over(everything)))
        .orderBy(F.desc("revenue"), "segment")
    )


def top_customers(table: DataFrame, by: str = "monetary", n: int = 20, segment: str | None = None) -> DataFrame:
    """Leading customers by monetary value or frequency (largest first) or recency (smallest first)."""
    rows = table if segment is None else table.filter(F.col("segment") == segment)
    order = F.asc(by) if by == "recency" else F.desc(by)
    return rows.orderBy(order, "customer_id").limit(n)
