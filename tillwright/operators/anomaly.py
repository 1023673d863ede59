"""Rolling-baseline anomaly detection on a daily series.

Input is one row per day (and per series when ``keys`` are given), so ordered windows see at most one row per
calendar day of a series. They must not be applied to transaction lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwright.functions.scalar import ratio, true_or_false
from tillwright.operators.kpi import daily_metrics, daily_revenue

Keys = tuple[str, ...]

# Severities from least to most severe, and the absolute z-score at which each of the last three starts.
SEVERITIES = ["NORMAL", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_STARTS = {"MEDIUM": 2.0, "HIGH": 3.0, "CRITICAL": 4.0}


def baseline(daily: DataFrame, window: int = 30, keys: Keys = ()) -> DataFrame:
    """Mean and sample deviation of the previous ``window`` present days, and the z-score against them.

    Both are null until the window is full. With zero deviation the z-score is infinite if the day differs
    and null if it does not, so NaN (which Spark would sort above every number) never arises.
    """
    before = Window.partitionBy(*keys).orderBy("date").rowsBetween(-window, -1)
    full = F.count("revenue").over(before) == window
    with_base = daily.withColumns({
        "rolling_mean_30": F.when(full, F.avg("revenue").over(before)),
        "rolling_std_30": F.when(full, F.stddev_samp("revenue").over(before)),
    })
    return with_z_score(with_base)


def with_z_score(base: DataFrame) -> DataFrame:
    deviation = F.col("revenue") - F.col("rolling_mean_30")
    flat = F.col("rolling_std_30") == 0
    infinite = F.when(deviation > 0, F.lit(float("inf"))).when(deviation < 0, F.lit(float("-inf")))
    return base.withColumn("z_score", F.when(flat, infinite).otherwise(ratio(deviation, F.col("rolling_std_30"))))


def flag(scored: DataFrame, z_threshold: float = 3.0) -> DataFrame:
    """is_anomaly: the absolute z-score reaches the threshold; undefined scores are not anomalies."""
    return scored.withColumn("is_anomaly", true_or_false(F.abs("z_score") >= z_threshold))


def severity(scored: DataFrame) -> DataFrame:
    """NORMAL below 2, MEDIUM below 3, HIGH below 4, CRITICAL from 4; undefined scores are NORMAL."""
    size = F.abs("z_score")
    level = F.when(size.isNull() | (size < SEVERITY_STARTS["MEDIUM"]), "NORMAL")
    level = level.when(size < SEVERITY_STARTS["HIGH"], "MEDIUM").when(size < SEVERITY_STARTS["CRITICAL"], "HIGH")
    return scored.withColumn("severity", level.otherwise("CRITICAL"))


def impact(scored: DataFrame) -> DataFrame:
    """Deviation from the baseline mean, absolute and in percent of it."""
    deviation = F.col("revenue") - F.col("rolling_mean_30")
    return scored.withColumns({
        "revenue_deviation": deviation,
        "revenue_deviation_pct": ratio(deviation, F.col("rolling_mean_30")) * 100,
    })


def detect(daily: DataFrame, window: int = 30, z_threshold: float = 3.0, keys: Keys = ()) -> DataFrame:
    """Baseline, flag, severity and impact for every day."""
    return impact(severity(flag(baseline(daily, window, keys), z_threshold)))


def detect_from_transactions(
    tx: DataFrame, window: int = 30, z_threshold: float = 3.0, keys: Keys = ()
) -> DataFrame:
    """The whole detector as one job from clean transactions."""
    return detect(daily_metrics(tx, keys), window, z_threshold, keys)


def detect_from_revenue(
    tx: DataFrame, window: int = 30, z_threshold: float = 3.0, keys: Keys = ()
) -> DataFrame:
    """The detector on revenue alone, which is all that it judges: orders and customers are not counted."""
    return detect(daily_revenue(tx, keys), window, z_threshold, keys)


def combine(statistical: DataFrame, multivariate: DataFrame, keys: Keys = ()) -> DataFrame:
    """Statistical results with the multivariate flag and score beside them; final_anomaly if either flags.

    Days the multivariate detector did not see keep the statistical verdict.
    """
    other = multivariate.select(*keys, "date", "is_multivariate_anomaly", "isolation_score")
    own = [
        *keys, "date", "revenue", "rolling_mean_30", "rolling_std_30", "z_score", "is_anomaly", "severity",
        "revenue_deviation", "revenue_deviation_pct",
    ]
    return (
        statistical.select(*own)
        .join(other, [*keys, "date"], "left")
        .withColumn(
            "final_anomaly",
            true_or_false(F.col("is_anomaly")) | true_or_false(F.col("is_multivariate_anomaly")),
        )
    )


def severity_rank(column: str = "severity"):
    levels = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.array_position(levels, F.upper(column))


def list_anomalies(detected: DataFrame, severity: str | None = None, order: str = "date") -> DataFrame:
    """Flagged days, optionally of one severity, by date or by severity (most severe first, then latest)."""
    rows = detected.filter("is_anomaly")
    if severity is not None:
        rows = rows.filter(F.col("severity") == severity)
    if order == "severity":
        return rows.orderBy(severity_rank().desc(), F.desc("date"))
    if order == "date":
        return rows.orderBy("date")
    raise ValueError("order must be 'date' or 'severity'")


def severity_counts(detected: DataFrame) -> DataFrame:
    """Number of flagged days per severity."""
    return detected.filter("is_anomaly").groupBy("severity").agg(F.count(F.lit(1)).alias("days"))


def most_critical_day(detected: DataFrame) -> DataFrame:
    """The CRITICAL day with the largest absolute z-score (earliest on ties); no row if there is none."""
    return (
        detected.filter(F.col("is_anomaly") & (F.col("severity") == "CRITICAL"))
        .orderBy(F.abs("z_score").desc(), "date")
        .limit(1)
    )
