"""From numbers to findings: summaries, evidence rows, ranked evidence, nested reports and their text forms.

Everything here works on one row per anomalous day or on a handful of rows per day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tillwright.functions.json_safe import safe_value
from tillwright.functions.scalar import amount_text, clock_hour, percent_text

# The wording and strength of findings.
REVENUE_FINDING = "Revenue was £%s, against an expected £%s."
REVENUE_IMPACT = "%s%% above expected revenue."
MEMBER_FINDING = "%s generated £%s."
DAY_IMPACT = "%s%% of anomaly-day revenue."
CUSTOMER_IMPACT = "%s%% of identified-customer revenue."
TOGETHER_FINDING = "Multiple investigation dimensions co-occurred in the same transaction subset."
TOGETHER_IMPACT = "Intersection revenue: £%s."
STRENGTHS = {"critical": 4, "high": 3, "medium": 2, "low": 1}

UNNAMED_PRODUCT = "Unknown product"

INSTRUCTIONS = """\
Explain one revenue anomaly to a business reader, using nothing but the evidence below.

Keep to these rules: state no figure, cause or event that the evidence does not contain; say which statements are
observed and which are inferred; start from the strongest evidence; where the evidence cannot support a cause, say
that it is insufficient. Write briefly and plainly.

Answer in six parts: executive summary; what happened; evidence; likely root cause; business impact; recommended
next steps.
"""


def investigation_summary(anomalies: DataFrame, members: DataFrame, together: DataFrame) -> DataFrame:
    """Anomaly measures, top member per dimension and the members' intersection, one row per anomalous day."""
    joint = together.select(
        "date", F.struct("revenue", "units_sold", "orders", "transaction_rows").alias("intersection")
    )
    measures = anomalies.select(
        "date",
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("anomaly_date"),
        F.col("revenue").alias("actual_revenue"),
        F.col("rolling_mean_30").alias("expected_revenue"),
        "z_score", "severity", "revenue_deviation", "revenue_deviation_pct",
    )
    return measures.join(members, "date", "left").join(joint, "date", "left")


def with_significance(summary: DataFrame, tests: DataFrame) -> DataFrame:
    """Add the t-test against the preceding calendar days as further columns."""
    added = ("baseline_mean", "baseline_std", "t_statistic", "p_value", "is_significant")
    return summary.join(tests.select("date", *added), "date", "left")


def build_evidence(summary: DataFrame, signed: bool = False) -> DataFrame:
    """Up to six findings per day; ``ordinal`` fixes their order.

    The impact of the anomaly itself always reads 'above expected' unless ``signed`` is set, which says
    'below expected' for dips and drops the minus sign.
    """

    def row(ordinal: int, kind: str, dimension: str, identifier: Column, finding: Column, impact: Column,
            strength: str = "high") -> Column:
        return F.struct(
            F.lit(ordinal).alias("ordinal"), F.lit(kind).alias("evidence_type"), F.lit(dimension).alias("dimension"),
            identifier.cast("string").alias("identifier"), finding.alias("finding"), impact.alias("impact"),
            F.lit(strength).alias("strength"),
        )

    def member(ordinal: int, dimension: str, top: str, identifier: str, name: Column, impact: str = DAY_IMPACT) -> Column:
        finding = F.format_string(MEMBER_FINDING, name, amount_text(F.col(f"{top}.revenue")))
        share = F.format_string(impact, percent_text(F.col(f"{top}.contribution_pct")))
        made = row(ordinal, "contribution", dimension, F.col(f"{top}.{identifier}"), finding, share)
        return F.when(F.col(top).isNotNull(), made)

    none = F.lit(None)
    percent = F.col("revenue_deviation_pct")
    impact = F.format_string(REVENUE_IMPACT, percent_text(percent))
    if signed:
        size = F.format_string(REVENUE_IMPACT, percent_text(F.abs(percent)))
        impact = F.when(percent < 0, F.replace(size, F.lit("above"), F.lit("below"))).otherwise(size)
    revenue = F.format_string(
        REVENUE_FINDING, amount_text(F.col("actual_revenue")), amount_text(F.col("expected_revenue"))
    )
    together = F.col("intersection.revenue")
    findings = F.array(
        row(1, "anomaly", "revenue", none, revenue, impact),
        member(2, "product", "top_product", "stock_code",
               F.coalesce("top_product.description", F.lit(UNNAMED_PRODUCT))),
        member(3, "customer", "top_customer", "customer_id",
               F.concat(F.lit("Customer "), F.col("top_customer.customer_id").cast("string")), CUSTOMER_IMPACT),
        member(4, "country", "top_country", "country", F.coalesce("top_country.country", F.lit("Unspecified"))),
        member(5, "time", "top_hour", "hour",
               F.concat(F.lit("The "), clock_hour(F.col("top_hour.hour")), F.lit(" hour"))),
        F.when(together > 0, row(6, "intersection", "multi_dimension", none, F.lit(TOGETHER_FINDING),
                                 F.format_string(TOGETHER_IMPACT, amount_text(together)), "critical")),
    )
    return summary.select("date", F.inline(F.filter(findings, lambda item: item.isNotNull())))


def rank_evidence(evidence: DataFrame) -> DataFrame:
    """Score by strength (ignoring case, 0 if unknown) and number the findings of a day from the strongest."""
    strength = F.lower("strength")
    score = reduce(lambda chain, s: chain.when(strength == s, STRENGTHS[s]), list(STRENGTHS)[1:],
                   F.when(strength == "critical", STRENGTHS["critical"])).otherwise(0)
    order = Window.partitionBy("date").orderBy(F.desc("strength_score"), "evidence_type", "ordinal")
    return evidence.withColumn("strength_score", score).withColumn("evidence_rank", F.row_number().over(order))


def build_report(summary: DataFrame, ranked: DataFrame) -> DataFrame:
    """One nested report per day: investigation, root_causes, intersection, evidence[] (at most six findings)."""
    fields = ("evidence_rank", "evidence_type", "dimension", "identifier", "finding", "impact", "strength", "strength_score")
    lists = ranked.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("evidence"))
    return summary.join(lists, "date", "left").select(
        "date",
        F.struct("anomaly_date", "severity", "actual_revenue", "expected_revenue", "revenue_deviation",
                 "revenue_deviation_pct", "z_score").alias("investigation"),
        F.struct(F.col("top_product").alias("product"), F.col("top_customer").alias("customer"),
                 F.col("top_country").alias("country"), F.col("top_hour").alias("time")).alias("root_causes"),
        "intersection",
        "evidence",
    )


def explanation_context(report: DataFrame) -> DataFrame:
    """The four report sections as indented JSON: computed findings only, no transaction lines."""
    sections = ("investigation", "root_causes", "intersection", "evidence")
    safe = [safe_value(F.col(s), report.schema[s].dataType).alias(s) for s in sections]
    text = F.to_json(F.struct(*safe), {"ignoreNullFields": "false", "pretty": "true"})
    return report.select("date", text.alias("context"))


def explanation_prompts(context: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """Instructions and context joined into one text per anomaly, for a separate batch job to send."""
    prompt = F.concat(F.lit(instructions + "\nEvidence:\n"), F.col("context"))
    return context.select("date", prompt.alias("prompt"))


def _lines(value: Column, kind: DataType, depth: int, limit: int | None) -> Column:
    """Array of (depth, label, value) for a nested value; headings have no value."""

    def entry(label: Column, text: Column) -> Column:
        return F.struct(F.lit(depth).alias("depth"), label.alias("label"), text.cast("string").alias("value"))

    def labelled(label: Column, item: Column, item_kind: DataType) -> Column:
        if isinstance(item_kind, (StructType, ArrayType)):
            heading = F.array(entry(label, F.lit(None)))
            inner = F.concat(heading, _lines(item, item_kind, depth + 1, limit))
            return F.when(item.isNotNull(), inner).otherwise(F.array(entry(label, F.lit("None"))))
        return F.array(entry(label, F.coalesce(item.cast("string"), F.lit("None"))))

    if isinstance(kind, StructType):
        names = {f.name: F.lit(f.name.replace("_", " ").title()) for f in kind.fields}
        return F.concat(*[labelled(names[f.name], value.getField(f.name), f.dataType) for f in kind.fields])
    items = value if limit is None else F.slice(value, 1, limit)
    element = kind.elementType
    if isinstance(element, (StructType, ArrayType)):
        return F.flatten(F.transform(
            items, lambda item, i: labelled(F.concat(F.lit("Item "), (i + 1).cast("string")), item, element)
        ))
    return F.transform(items, lambda item: entry(F.lit("-"), item))


def report_lines(report: DataFrame, list_limit: int | None = None) -> DataFrame:
    """Reports as ordered (line, depth, label, value) rows; lists show all items, or the first ``list_limit``."""
    sections = [f for f in report.schema.fields if f.name != "date"]
    body = F.struct(*[F.col(f.name) for f in sections])
    lines = _lines(body, StructType(sections), 0, list_limit)
    return report.select("date", F.posexplode(lines).alias("line", "entry")).select("date", "line", "entry.*")
