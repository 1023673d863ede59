"""Back-testing the detector and the root-cause ranking with injected, known truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.functions.scalar import day_of, money, ratio_or_zero
from tillwright.operators.contribution import (
    MEMBER_TYPES, dimension_totals, member_lists, member_measures, rank_root_causes, with_shares,
)
from tillwright.plans.staging import bounded_side, broadcast_if_small, stage

# The injected amount, the hours it is spread over, and the names that carry it otherwise.
SHOCK = 100_000.0
SHOCK_FACTOR = 3.0
SHOCK_HOURS = list(range(8, 22))
CONTROL_CODE = "CONTROL-"
CONTROL_DESCRIPTION = "Controlled Evaluation Transaction"
# Reserved identities: customers are positive and invoices start with a digit or a C and digits, however large the data.
CONTROL_CUSTOMER = -999_999
CONTROL_COUNTRY = "Controlled Evaluation Country"
CONTROL_INVOICE = "CONTROL-"
SCENARIOS = ["country", "product", "customer"]


def detection_metrics(truth: DataFrame, detected: DataFrame, universe: DataFrame) -> DataFrame:
    """Confusion counts over dates, and precision, recall and false positive rate (0 for empty denominators).

    Each input has a ``date`` column. Negatives are the universe without the truth.
    """
    marks = (
        truth.select("date", F.lit(1).alias("t"), F.lit(0).alias("d"), F.lit(0).alias("u"))
        .unionByName(detected.select("date", F.lit(0).alias("t"), F.lit(1).alias("d"), F.lit(0).alias("u")))
        .unionByName(universe.select("date", F.lit(0).alias("t"), F.lit(0).alias("d"), F.lit(1).alias("u")))
    )
    days = marks.filter(F.col("date").isNotNull()).groupBy("date").agg(*[(F.max(c) == 1).alias(c) for c in "tdu"])
    t, d, normal = F.col("t"), F.col("d"), F.col("u") & ~F.col("t")
    counts = days.agg(
        F.count_if(t & d).alias("true_positive"), F.count_if(d & normal).alias("false_positive"),
        F.count_if(t & ~d).alias("false_negative"), F.count_if(normal & ~d).alias("true_negative"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    return counts.withColumns({
        "precision": ratio_or_zero(tp, tp + fp), "recall": ratio_or_zero(tp, tp + fn),
        "false_positive_rate": ratio_or_zero(fp, fp + tn),
    })


def pick_target_date(daily: DataFrame, skip_first: int = 40, skip_last: int = 10) -> DataFrame:
    """The middle of the days left after dropping the first 40 and last 10; no row when none are left."""
    everything = Window.partitionBy()  # one row per calendar day
    eligible = F.col("_days") - skip_first - skip_last
    middle = F.floor(eligible / 2) + skip_first + 1
    return (
        daily.withColumn("_place", F.row_number().over(Window.orderBy("date")))
        .withColumn("_days", F.count(F.lit(1)).over(everything))
        .filter((eligible > 0) & (F.col("_place") == middle))
        .drop("_place", "_days")
    )


def inject_uniform_shock(tx: DataFrame, dates: DataFrame) -> DataFrame:
    """Spread max(100000, 3 x |day revenue|) evenly over the lines of each given date; other lines are unchanged.

    The per-line amount comes from an aggregate per date, staged and broadcast within the counted bound, rather than
    from a window that would gather all lines of a day.
    """
    wanted = bounded_side(dates.select("date").distinct(), "dates")
    stamped = tx.withColumn("_date", day_of(F.col("invoice_ts")))
    on_days = stamped.join(wanted.withColumnRenamed("date", "_date"), "_date", "left_semi")
    amount = F.greatest(F.lit(SHOCK), F.abs(money(F.sum("revenue"))) * SHOCK_FACTOR) / F.count(F.lit(1))
    extra = bounded_side(on_days.groupBy("_date").agg(amount.alias("_extra")), "shocks")
    shocked = F.col("revenue").cast("double") + F.coalesce("_extra", F.lit(0.0))
    return stamped.join(extra, "_date", "left").withColumn("revenue", shocked).select(*tx.columns)


def select_targets(lines: DataFrame) -> DataFrame:
    """Per date one target per scenario: the top country, and the top product and customer with two or more lines.

    ``lines`` come from ``lines_on``. A scenario without a suitable member has no row.
    """
    return targets_from(member_measures(lines))


def targets_from(measures: DataFrame) -> DataFrame:
    """``select_targets`` of stored member measures: the lines are not read again."""
    suitable = (
        (F.col("dimension") == "product") & (F.col("lines") >= 2)
        | (F.col("dimension") == "customer") & (F.col("lines") >= 2)
        | (F.col("dimension") == "country") & F.col("country").isNotNull()
    )
    named = ("stock_code", "description", "customer_id", "country")
    first = F.struct(-F.col("revenue"), *[F.coalesce(F.col(m).cast("string"), F.lit("")) for m in named])
    best = measures.filter(suitable).groupBy("date", F.col("dimension").alias("scenario")).agg(F.min_by(F.struct(*named), first).alias("_m"))
    return best.select("date", "scenario", "_m.*")


def require_targets(targets: DataFrame) -> DataFrame:
    """Raise ValueError unless every scenario found a target."""
    present = {row["scenario"] for row in targets.select("scenario").distinct().collect()}
    missing = sorted(set(SCENARIOS) - present)
    if missing:
        raise ValueError(f"No suitable target for: {', '.join(missing)}")
    return targets


def inject_member_rows(targets: DataFrame) -> DataFrame:
    """Fourteen lines per target, one per hour 8..21, sharing the injected revenue.

    The scenario's own dimension names the target; the others name control members, so only one dimension gains.
    """

    def member(scenario: str, column: str, control: Column) -> Column:
        return F.when(F.col("scenario") == scenario, F.col(column)).otherwise(control)

    share = F.lit(SHOCK / len(SHOCK_HOURS))
    hours = F.posexplode(F.array(*[F.lit(h) for h in SHOCK_HOURS])).alias("_i", "hour")
    return targets.select("*", hours).select(
        "date", "scenario", "hour",
        F.concat(F.lit(CONTROL_INVOICE), F.col("_i").cast("string")).alias("invoice"),
        member("product", "stock_code", F.concat(F.lit(CONTROL_CODE), F.upper("scenario"))).alias("stock_code"),
        member("product", "description", F.lit(CONTROL_DESCRIPTION)).alias("description"),
        F.lit(1).cast("bigint").alias("quantity"),
        member("customer", "customer_id", F.lit(CONTROL_CUSTOMER)).cast("bigint").alias("customer_id"),
        member("country", "country", F.lit(CONTROL_COUNTRY)).alias("country"),
        share.alias("revenue"),
    )


def scenario_lines(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Every scenario's day: its own lines plus the injected ones. ``ranked_from`` does without them."""
    injected = inject_member_rows(targets)
    scenarios = F.explode(F.array(*[F.lit(s) for s in SCENARIOS])).alias("scenario")
    original = lines.select("*", scenarios).withColumn("revenue", F.col("revenue").cast("double"))
    return original.select(*injected.columns).unionByName(injected)


def scenario_deltas(targets: DataFrame) -> DataFrame:
    """What the injected lines of each scenario add to each member: a few rows per date, staged."""
    return member_measures(inject_member_rows(targets), ("date", "scenario"))


def ranked_scenarios(lines: DataFrame, targets: DataFrame, top_n: int = 10) -> DataFrame:
    """Ranked causes per date and scenario; the hour list may hold 20 entries, the others ``top_n``."""
    return ranked_from(member_measures(lines), targets, top_n)


def ranked_from(measures: DataFrame, targets: DataFrame, top_n: int = 10, hour_top_n: int = 20) -> DataFrame:
    """``ranked_scenarios`` of stored member measures and the deltas of the scenarios.

    A scenario changes one member per dimension (and fourteen hours), all upwards. Its lists are therefore among the
    members the lists had before and those that changed; injected invoices occur nowhere else, so orders add up. The
    lines are neither read again nor repeated per scenario.
    """
    by = ("date", "scenario")
    added = scenario_deltas(targets)
    deltas = broadcast_if_small(added)
    trials = broadcast_if_small(stage(targets.select(*by).distinct(), "trials"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        matched = (a["date"] == b["date"]) & (a["dimension"] == b["dimension"])
        for m in MEMBER_TYPES:
            matched = matched & a[m].eqNullSafe(b[m])
        return matched

    sums = ("_exact", "revenue", "units_sold", "orders")
    met = measures.join(deltas, same(measures, deltas)).select(
        *[deltas[c] for c in (*by, "dimension", *MEMBER_TYPES)],
        *[(measures[c].cast(deltas.schema[c].dataType) + deltas[c]).alias(c) for c in sums])
    met = stage(met, "met-members")
    new = deltas.join(met, (deltas["scenario"] == met["scenario"]) & same(deltas, met), "left_anti").select(met.columns)
    before = stage(member_lists(measures, top_n, hour_top_n), "lists").join(trials, "date").select(
        *by, "dimension", *MEMBER_TYPES, *[F.col(c).cast(met.schema[c].dataType).alias(c) for c in sums])
    unchanged = before.join(deltas, (before["scenario"] == deltas["scenario"]) & same(before, deltas), "left_anti")
    lists = member_lists(met.unionByName(new).unionByName(unchanged), top_n, hour_top_n, by)
    whole = dimension_totals(measures).join(trials, "date").unionByName(dimension_totals(added, by))
    totals = whole.groupBy(*by, "dimension").agg(F.sum("_whole").alias("_whole"))
    heads = with_shares(lists, totals, by).filter(F.col("rank") <= top_n)
    return rank_root_causes(heads, top_n, by)


def target_rank(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Position of each target among the ranked causes of its date and scenario, null if it is not there."""
    named = targets.select(
        "date", "scenario", member_label_of_target().alias("expected_target")
    )
    own = F.when(
        (F.col("dimension") == F.col("scenario")) & F.col("cause").eqNullSafe(F.col("expected_target")), F.col("cause_rank")
    )
    joined = named.join(ranked, ["date", "scenario"], "left")
    return joined.groupBy("date", "scenario", "expected_target").agg(F.min(own).alias("target_rank"))


def member_label_of_target() -> Column:
    return (
        F.when(F.col("scenario") == "product", F.col("description"))
        .when(F.col("scenario") == "customer", F.col("customer_id").cast("string"))
        .otherwise(F.col("country"))
    )


def scenario_eval(lines: DataFrame, targets: DataFrame, top_n: int = 10) -> DataFrame:
    """Per date and scenario: the target's rank, top-1/top-3 hits, the predicted dimension and the first five causes."""
    return scenario_eval_from(member_measures(lines), targets, top_n)


def scenario_eval_from(measures: DataFrame, targets: DataFrame, top_n: int = 10) -> DataFrame:
    """``scenario_eval`` of stored member measures."""
    ranked = stage(ranked_from(measures, targets, top_n), "ranked")
    entry = F.struct("cause_rank", "dimension", "cause", "revenue", "contribution_pct")
    heads = ranked.groupBy("date", "scenario").agg(
        F.min_by("dimension", "cause_rank").alias("predicted_top_1"),
        F.array_sort(F.collect_list(F.when(F.col("cause_rank") <= 5, entry))).alias("top_5"),
    )
    found = F.col("target_rank").isNotNull()
    return (
        target_rank(ranked, targets)
        .join(heads, ["date", "scenario"], "left")
        .withColumn("expected_dimension", F.col("scenario"))
        .withColumn("synthetic_revenue", F.lit(SHOCK))
        .withColumn("top_1_correct", found & (F.coalesce("target_rank", F.lit(0)) == 1))
        .withColumn("top_3_correct", found & (F.coalesce("target_rank", F.lit(99)) <= 3))
    )


def dimension_eval(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether the expected dimension of a date is among its first one or three ranked causes.

    ``expected`` has scenario, date and expected_dimension. Dates without causes are incorrect.
    """
    first3 = ranked.filter(F.col("cause_rank") <= 3)
    heads = first3.groupBy("date").agg(
        F.min_by("dimension", "cause_rank").alias("predicted_top_1"),
        F.transform(F.array_sort(F.collect_list(F.struct("cause_rank", "dimension"))), lambda x: x["dimension"])
        .alias("top_3_dimensions"),
    )
    joined = expected.join(heads, "date", "left")
    return joined.withColumns({
        "top_1_correct": F.coalesce(F.col("predicted_top_1") == F.col("expected_dimension"), F.lit(False)),
        "top_3_correct": F.coalesce(F.array_contains("top_3_dimensions", F.col("expected_dimension")), F.lit(False)),
    })


def accuracy(results: DataFrame) -> DataFrame:
    """Number of scenarios, correct ones and their rate (0 without scenarios)."""
    total = F.count(F.lit(1))
    top1, top3 = F.count_if("top_1_correct"), F.count_if("top_3_correct")
    return results.agg(
        total.alias("scenario_count"), top1.alias("top_1_correct"), top3.alias("top_3_correct"),
        ratio_or_zero(top1, total).alias("top_1_accuracy"), ratio_or_zero(top3, total).alias("top_3_accuracy"),
    )
