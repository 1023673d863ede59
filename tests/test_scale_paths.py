"""The code paths that only large inputs take, forced on small ones and compared with the simple answer."""

from __future__ import annotations

import math
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tillwright.catalog import load
from tillwright.operators import profile, rfm
from tillwright.operators.cleaning import clean_transactions
from tillwright.operators.sampling import _first_by_draw, stratified_day_sample
from tillwright.plans.first_value import first_values
from tillwright.plans.ordered import running_total
from tillwright.plans.selection import select_ranks
from tillwright.plans.skew import join_key_facts
from tillwright.plans.staging import bounded_side, broadcast_if_small, drop_staged, shared_root, stage


def test_sliced_running_total_equals_the_single_window(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000 % 13).alias("v"), "id", (F.col("id") % 3).alias("w")).repartition(6)
    order = [F.col("v"), F.col("id")]
    whole = {r["id"]: r["n"] for r in running_total(df, order, "n", F.col("w")).collect()}
    sliced = {r["id"]: r["n"] for r in running_total(df, order, "n", F.col("w"), single_window_rows=300).collect()}
    assert whole == sliced and max(whole.values()) == sum(i % 3 for i in range(5000))


@pytest.mark.parametrize("n", [1, 5, 6, 7, 13, 101])
def test_quintiles_match_linear_quantile_bins(spark, n):
    rows = spark.range(n).select(
        F.col("id").alias("customer_id"), F.lit(3).alias("recency"), (F.col("id") % 2).alias("frequency"),
        (-F.col("id")).cast("double").alias("monetary"),
    )
    got = {r["customer_id"]: r for r in rfm.rfm_scores(rows).collect()}
    if n == 1:
        assert got[0]["r_score"] is None and got[0]["m_score"] is None
        return
    edges = [1 + q * (n - 1) / 5 for q in range(6)]
    for i in range(n):
        rank = i + 1
        bin_ = next(b for b in range(1, 6) if rank <= edges[b] + 1e-9)
        assert got[i]["r_score"] == 6 - bin_
        assert got[i]["m_score"] == next(b for b in range(1, 6) if n - i <= edges[b] + 1e-9)
    sliced = {r["customer_id"]: r for r in rfm.rfm_scores(rows, fetched=0).collect()}
    assert sliced == got


def test_recency_counts_whole_periods(make_raw):
    tx = clean_transactions(make_raw([
        ("1", "A", "a", 1, "2011-01-01 23:00", 1.0, 1, "UK"), ("2", "A", "a", 1, "2011-01-02 12:00", 1.0, 2, "UK"),
        ("3", "A", "a", 1, "2010-12-31 12:00", 1.0, 3, "UK"),
    ]))
    assert {r["customer_id"]: r["recency"] for r in rfm.rfm(tx).collect()} == {1: 0, 2: 0, 3: 2}


def test_segments_cover_every_score(spark):
    one = spark.range(1, 6)
    grid = one.select(F.col("id").alias("r_score")).crossJoin(one.select(F.col("id").alias("f_score"))).crossJoin(
        one.select(F.col("id").alias("m_score"))
    )
    got = {(r["r_score"], r["f_score"], r["m_score"]): r["segment"] for r in rfm.rfm_segment(grid).collect()}
    assert got[5, 5, 5] == "Champions" and got[3, 4, 1] == "Loyal Customers" and got[3, 1, 5] == "Big Spenders"
    assert got[4, 2, 1] == "New Customers" and got[1, 3, 3] == "At Risk" and got[2, 2, 5] == "Hibernating"
    assert got[3, 3, 3] == "Potential Loyalists" and got[3, 2, 1] == "Others" and got[1, 3, 1] == "Others"


def test_hot_key_join(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, 1).when(F.col("id") < 1300, 2).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    facts = rows.groupBy("k").agg(F.min("v").alias("first"), F.count(F.lit(1)).alias("n"))
    for hot in (2, 10, 100_000):
        joined = join_key_facts(rows, facts, "k", "n", hot_fraction=hot)
        assert joined.count() == 3000 and joined.columns == ["k", "v", "first"]
        assert joined.filter("k = 1 and first = 0").count() == 1000
        assert joined.filter("first is null").count() == 0


def test_exact_quartiles(spark):
    values = [(float((i * 37) % 101) + (i % 4) / 4,) for i in range(403)]
    df = spark.createDataFrame(values, "x double").withColumn("y", F.when(F.col("x") > 50, F.col("x")))
    got = {r["field"]: r for r in profile.describe_numbers(df, ["x", "y"]).collect()}
    numbers = sorted(v for v, in values)
    q = statistics.quantiles(numbers, n=4, method="inclusive")
    assert [got["x"][c] for c in ("q25", "q50", "q75")] == pytest.approx(q)
    kept = [v for v in numbers if v > 50]
    assert got["y"]["count"] == len(kept) and got["y"]["q50"] == pytest.approx(statistics.median(kept))


@pytest.mark.parametrize("buckets, fetched", [(16, 0), (1_024, 0), (5, 60)])
def test_selected_ranks_are_those_of_a_sort(spark, buckets, fetched):
    """Ties, many magnitudes, both signs, infinities and NaN, neighbours of a float, one value, nulls, and no value."""
    close = [1.0 + k * 2.0**-52 for k in range(12)]
    fields = {
        "ties": [float(k % 4) for k in range(300)], "wide": [(-1.0) ** k * 10.0 ** (k * 7 % 300 - 150) for k in range(60)],
        "odd": [math.inf, -math.inf, 0.0, math.nan, math.nan, 1e308, -1e308, 5e-324], "close": close[::-1], "one": [3.5] * 9, "none": [],
    }
    rows = [(f, v) for f, values in fields.items() for v in [*values, None]]
    df = spark.createDataFrame(rows, "field string, value double")
    wanted = {f: [1, 2, len(v) // 3, len(v) // 2, len(v), len(v) + 1] for f, v in fields.items()}
    got = select_ranks(df, wanted, buckets, fetched)
    for f, values in fields.items():
        ordered = sorted(values, key=lambda v: (math.isnan(v), v))
        for r in wanted[f]:
            if not 1 <= r <= len(ordered):
                assert (f, r) not in got
                continue
            value, below = ordered[r - 1], got[f, r].below
            assert repr(got[f, r].value) == repr(value)
            assert below == sum(v < value or (math.isnan(value) and not math.isnan(v)) for v in values)
    large = spark.range(500).selectExpr("'i' as field", f"{2**62} + id * id - 9000000000000000000 * (id % 2) as value")
    numbers = sorted(r["value"] for r in large.collect())
    assert {r: s.value for (_, r), s in select_ranks(large, {"i": [1, 77, 250, 500]}, buckets, fetched).items()} == {r: numbers[r - 1] for r in (1, 77, 250, 500)}


def test_quartiles_and_scores_sort_no_table(spark):
    rows = spark.range(400).select(
        F.col("id").alias("customer_id"), (F.col("id") % 3).cast("int").alias("recency"), (F.col("id") % 7).alias("frequency"),
        F.when(F.col("id") % 9 != 0, F.col("id") * 1.5).alias("monetary"))
    forced, usual = (rfm.rfm_scores(rows, fetched=n) for n in (0, 20_000))
    assert sorted(forced.collect()) == sorted(usual.collect())
    for df in (forced, profile.describe_numbers(rows, ["recency", "monetary"], fetched=0)):
        plan = df._jdf.queryExecution().toString()
        assert "Window" not in plan and "Sort" not in plan and "rangepartitioning" not in plan
    assert profile.describe_numbers(rows.limit(0), ["recency"]).count() == 0


def test_first_values_are_those_of_a_sort(spark):
    """Ties in time and invoice, missing times, values and keys, a key with a third of all lines."""
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 31 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("key"),
        F.when(F.col("id") % 5 != 2, F.concat(F.lit("v"), (F.col("id") * 7 % 11).cast("string"))).alias("value"),
        F.when(F.col("id") % 97 != 4, F.timestamp_add("day", (F.col("id") * 13 % 9).cast("int"), F.lit("2011-01-01").cast("timestamp"))).alias("time"),
        (F.col("id") * 31 % 6).cast("string").alias("invoice"),
    )
    got = {r["key"]: r["value"] for r in first_values(rows, "key", "value", "time", ["invoice"]).collect()}
    kept = [r for r in rows.collect() if r["key"] is not None and r["value"] is not None]
    order = lambda r: (r["time"] is not None, r["time"] or datetime.min, r["invoice"], r["value"])
    want: dict = {}
    for r in sorted(kept, key=order):
        want.setdefault(r["key"], r["value"])
    assert got == want and len(got) > 10


def test_dimensions_sort_no_lines(spark, make_raw):
    from tillwright.operators.segments import product_profile
    from tillwright.sources import star

    tx = clean_transactions(make_raw([("1", "A", "a", 1, "2011-01-01 09:00", 1.0, 1, "UK"), ("2", "A", "b", 1, "2011-01-02 09:00", 1.0, 1, "DE")]))
    for made in (star.customers_dim(tx), star.products_dim(tx), product_profile(tx)):
        assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    assert star.products_dim(tx).first()["description"] == "a" and star.customers_dim(tx).first()["country"] == "UK"


@pytest.fixture(scope="module")
def uneven(make_raw):
    """30 days of two lines, one day of 400 lines, with copies kept (no de-duplication)."""
    rows = [(f"{d}-{k}", "A", "a", 1, f"2011-01-{d:02d} 09:00", 1.0, 1, "UK") for d in range(1, 31) for k in range(2)]
    rows += [(f"x{k % 40}", "B", "b", 1, "2011-02-01 09:00", 1.0, 1, "UK") for k in range(400)]
    return make_raw(rows)


@pytest.mark.parametrize("target", [10, 31, 100, 200, 459, 460, 1000])
def test_stratified_sample_sizes(uneven, target):
    sample = stratified_day_sample(uneven, target)
    per_day = {str(r["d"]): r["n"] for r in sample.groupBy(F.to_date("invoice_ts").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = max(1, target // 31)
    assert len(per_day) == 31 and all(n >= min(2, quota) for n in per_day.values())
    assert sum(per_day.values()) == min(460, max(target, 31))


@pytest.mark.parametrize("target", [40, 100, 460])
def test_large_quota_path_draws_the_same_sample(uneven, monkeypatch, target):
    def drawn():
        return sorted(map(str, stratified_day_sample(uneven, target).collect()))

    ranked = drawn()
    monkeypatch.setattr("tillwright.operators.sampling.GROUP_LIMIT", 0)
    assert drawn() == ranked


def test_crowded_boundaries_are_refined(spark, uneven, monkeypatch):
    def drawn():
        return sorted(map(str, stratified_day_sample(uneven, 100).collect()))

    usual = drawn()
    monkeypatch.setattr("tillwright.operators.sampling.GROUP_LIMIT", 0)
    monkeypatch.setattr("tillwright.operators.sampling.BOUNDARY_ROWS", 0)
    monkeypatch.setattr("tillwright.operators.sampling.HASH_BUCKET_BITS", 32)
    assert drawn() == usual
    # Draws that agree in their first bits, and some in all of them.
    draws = [(1, k // 3 - 20, k) for k in range(90)] + [(2, -(1 << 62) + k * k, k) for k in range(40)]
    lines = spark.createDataFrame(draws, "g int, a bigint, b bigint").select("g", F.struct("a", "b").alias("_draw"))
    got = sorted((r["g"], *r["_draw"]) for r in _first_by_draw(lines, 25, "g", 0).collect())
    assert got == sorted(sorted(d for d in draws if d[0] == 1)[:25] + sorted(d for d in draws if d[0] == 2)[:25])


def test_sample_of_distinct_lines(uneven):
    assert stratified_day_sample(uneven.dropDuplicates(), 80, distinct=True).count() == 80


def test_sample_is_reproducible(uneven):
    def drawn(df, seed):
        return sorted(r["invoice"] for r in stratified_day_sample(df, 120, seed).collect())

    assert drawn(uneven, 1) == drawn(uneven.repartition(9), 1)
    assert drawn(uneven, 1) != drawn(uneven, 2)


def test_staging_and_bounded_broadcast(spark):
    small = stage(spark.range(10), "numbers")
    assert small.count() == 10

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(broadcast_if_small(small)) and not hinted(broadcast_if_small(small, max_rows=9))
    assert bounded_side(spark.range(3), "n").count() == 3
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_drop_staged(spark):
    stage(spark.range(3), "gone")
    drop_staged(spark)
    assert stage(spark.range(3), "again").count() == 3


def test_damaged_files_are_written_by_all_tasks(spark):
    """A fixed number of writing tasks would have each of them hold a share of the lines that grows with the input."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "7"}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        paths = load._damaged_files(spark, "/root/testdata/sf0.001")
        files = [spark.read.text(path).select("_metadata.file_path").distinct().count() for path in paths[:2]]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert files == [7, 7]
