"""The complete investigation of every anomalous day in one run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date as Date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.operators import contribution as c
from tillwright.operators import evidence as e
from tillwright.operators.anomaly import detect
from tillwright.operators.kpi import daily_metrics
from tillwright.operators.significance import compare_anomaly_period
from tillwright.plans.staging import stage


@dataclass(frozen=True)
class Investigation:
    """Results for all investigated days; each is keyed by ``date``."""

    anomalies: DataFrame
    contributions: DataFrame
    causes: DataFrame
    intersections: DataFrame
    summary: DataFrame
    evidence: DataFrame
    report: DataFrame

    @property
    def context(self) -> DataFrame:
        return e.explanation_context(self.report)

    @property
    def prompts(self) -> DataFrame:
        return e.explanation_prompts(self.context)

    @property
    def lines(self) -> DataFrame:
        return e.report_lines(self.report)


def flagged_days(tx: DataFrame, dates: DataFrame | None = None, window: int = 30, z_threshold: float = 3.0) -> DataFrame:
    """Detected anomalies, restricted to ``dates`` if given; other dates are dropped."""
    found = detect(daily_metrics(tx), window, z_threshold).filter("is_anomaly")
    return found if dates is None else found.join(dates.select("date").distinct(), "date", "left_semi")


def investigate(
    tx: DataFrame,
    dates: DataFrame | None = None,
    window: int = 30,
    z_threshold: float = 3.0,
    top_n: int = 10,
    significance: bool = False,
    signed: bool = False,
) -> Investigation:
    """Investigate every flagged day (or the flagged ones among ``dates``).

    Transactions are read twice: once for the daily series, once, filtered by the flagged days at the scan, for
    their lines. That slice is staged with only the columns the four dimensions need; everything after the
    contribution lists handles a few rows per day.
    """
    daily = daily_metrics(tx)
    if significance:  # the tests read the series again
        daily = stage(daily, "daily")
    anomalies = detect(daily, window, z_threshold).filter("is_anomaly")
    if dates is not None:
        anomalies = anomalies.join(dates.select("date").distinct(), "date", "left_semi")
    anomalies = stage(anomalies, "anomalies")
    lines = stage(c.lines_on(tx, anomalies), "lines")
    contributions = stage(c.all_contributions(lines, top_n), "contributions")
    members = c.top_members(contributions)
    together = c.intersections(lines, members)
    summary = e.investigation_summary(anomalies, members, together)
    if significance:
        summary = e.with_significance(summary, compare_anomaly_period(daily, anomalies))
    summary = stage(summary, "summary")
    ranked = e.rank_evidence(e.build_evidence(summary, signed))
    return Investigation(
        anomalies, contributions, c.rank_root_causes(contributions, top_n), together, summary, ranked,
        e.build_report(summary, ranked),
    )


def investigate_date(tx: DataFrame, day: Date | str, **options) -> Investigation:
    """Investigate one date; raises ValueError when it is not an anomaly."""
    wanted = tx.sparkSession.range(1).select(F.lit(str(day)).cast("date").alias("date"))
    result = investigate(tx, wanted, **options)
    if result.anomalies.isEmpty():
        raise ValueError(f"No anomaly found for date: {day}")
    return result
