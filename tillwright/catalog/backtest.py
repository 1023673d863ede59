"""Back-testing queries."""

from pyspark.sql import functions as F

from tillwright.catalog.base import daily, register, stored
from tillwright.catalog.investigation import LEADERS, LINES
from tillwright.operators import backtest as b
from tillwright.operators.anomaly import detect, detect_from_revenue
from tillwright.operators.contribution import all_contributions, lines_on, member_measures, rank_root_causes
from tillwright.operators.kpi import daily_revenue
from tillwright.plans.investigate import flagged_days
from tillwright.plans.staging import stage

TARGET = """target AS (
 SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM daily)
 WHERE n > 50 AND rn = 41 + (n - 50) // 2)"""


def _metrics(spark, folder):
    """Known truth: the days whose revenue is at least twice the mean of the 30 days before."""
    days = stage(detect(daily(spark, folder)), "detected")
    truth = days.filter(F.col("revenue") >= F.col("rolling_mean_30") * 2)
    return b.detection_metrics(truth, days.filter("is_anomaly"), days)


CONFUSION = (
    "true_positive:n false_positive:n false_negative:n true_negative:n precision:f recall:f false_positive_rate:f"
)
CONFUSION_SQL = """SELECT *, coalesce(true_positive / nullif(true_positive + false_positive, 0), 0) AS precision,
 coalesce(true_positive / nullif(true_positive + false_negative, 0), 0) AS recall,
 coalesce(false_positive / nullif(false_positive + true_negative, 0), 0) AS false_positive_rate FROM (
 SELECT count(*) FILTER (WHERE t AND a) AS true_positive, count(*) FILTER (WHERE NOT t AND a) AS false_positive,
  count(*) FILTER (WHERE t AND NOT a) AS false_negative, count(*) FILTER (WHERE NOT t AND NOT a) AS true_negative FROM marks)"""
register(
    "detection_metrics", CONFUSION, _metrics, CONFUSION_SQL, views="scored",
    helpers="marks AS (SELECT coalesce(revenue >= rolling_mean_30 * 2, false) AS t, is_anomaly AS a FROM scored)",
)
register(
    "pick_target_date", "date:d revenue:m", lambda spark, folder: b.pick_target_date(daily(spark, folder)),
    "SELECT date, revenue FROM daily JOIN target USING (date)", views="daily", helpers=TARGET,
)


def _target(spark, tx):
    return stage(b.pick_target_date(daily_revenue(tx)), "target")


def _shocked(spark, folder):
    tx = stored(spark, folder)
    return b.inject_uniform_shock(tx, _target(spark, tx))


SHOCKED = TARGET + """,
shocked AS (
 SELECT c.* REPLACE (cast(revenue AS DOUBLE) + coalesce(extra, 0) AS revenue)
 FROM clean c LEFT JOIN (SELECT cast(invoice_ts AS DATE) AS day,
  greatest(100000.0, abs(cast(sum(revenue) AS DOUBLE)) * 3) / count(*) AS extra FROM clean GROUP BY 1) x
  ON x.day = cast(c.invoice_ts AS DATE) AND x.day IN (SELECT date FROM target))"""
register(
    "inject_uniform_shock", "invoice:s stock_code:s quantity:n invoice_ts:t revenue:c", _shocked,
    "SELECT * FROM shocked", views="daily", helpers=SHOCKED,
)
REDETECTED = SHOCKED + """,
again AS (
 SELECT date, revenue, CASE WHEN n = 30 THEN m END AS rolling_mean_30, (revenue - m) / nullif(CASE WHEN n = 30 THEN s END, 0) AS z_score
 FROM (SELECT date, revenue, avg(revenue) OVER w AS m, stddev_samp(revenue) OVER w AS s, count(*) OVER w AS n
  FROM (SELECT cast(invoice_ts AS DATE) AS date, sum(revenue) AS revenue FROM shocked GROUP BY 1)
  WINDOW w AS (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)))"""
register(
    "detect_after_shock", "date:d revenue:c rolling_mean_30:f z_score:f is_anomaly:b",
    lambda spark, folder: detect_from_revenue(_shocked(spark, folder)),
    "SELECT *, coalesce(abs(z_score) >= 3, false) AS is_anomaly FROM again", views="daily", helpers=REDETECTED,
)


def _shock_metrics(spark, folder):
    tx = stored(spark, folder)
    target = _target(spark, tx)
    days = stage(detect_from_revenue(b.inject_uniform_shock(tx, target)), "detected")
    return b.detection_metrics(target, days.filter("is_anomaly"), days)


register(
    "shock_detection_metrics", CONFUSION, _shock_metrics, CONFUSION_SQL, views="daily",
    helpers=REDETECTED + """,
marks AS (SELECT date IN (SELECT date FROM target) AS t, coalesce(abs(z_score) >= 3, false) AS a FROM again)""",
)


def _days(spark, folder):
    """Member measures and targets of every flagged day, from one pass over their lines."""
    tx = stored(spark, folder)
    measures = member_measures(lines_on(tx, flagged_days(tx)))
    return measures, stage(b.targets_from(measures), "targets")


TRIALS = LINES + """,
targets AS (
 SELECT date, scenario, stock_code, description, customer_id, country FROM (
  SELECT *, row_number() OVER (PARTITION BY date, scenario ORDER BY r DESC, coalesce(stock_code, ''), coalesce(description, ''),
   cast(customer_id AS VARCHAR), country) AS rn FROM (
   SELECT date, 'country' AS scenario, NULL AS stock_code, NULL AS description, NULL AS customer_id, country, sum(revenue) AS r
    FROM lines WHERE country IS NOT NULL GROUP BY date, country
   UNION ALL SELECT date, 'product', stock_code, description, NULL, NULL, sum(revenue) FROM lines GROUP BY date, stock_code, description
    HAVING count(*) >= 2
   UNION ALL SELECT date, 'customer', NULL, NULL, customer_id, NULL, sum(revenue) FROM lines WHERE customer_id IS NOT NULL
    GROUP BY date, customer_id HAVING count(*) >= 2)) WHERE rn = 1),
injected AS (
 SELECT date, scenario, hour, 'CONTROL-' || cast(hour - 8 AS VARCHAR) AS invoice,
  CASE WHEN scenario = 'product' THEN stock_code ELSE 'CONTROL-' || upper(scenario) END AS stock_code,
  CASE WHEN scenario = 'product' THEN description ELSE 'Controlled Evaluation Transaction' END AS description,
  1 AS quantity, CASE WHEN scenario = 'customer' THEN customer_id ELSE -999999 END AS customer_id,
  CASE WHEN scenario = 'country' THEN country ELSE 'Controlled Evaluation Country' END AS country, 100000.0::DOUBLE / 14 AS revenue
 FROM targets, (SELECT unnest(range(8, 22)) AS hour)),
trial AS (
 SELECT date, scenario, hour, invoice, stock_code, description, quantity, customer_id, country, cast(revenue AS DOUBLE) AS revenue
 FROM lines, (SELECT unnest(['country', 'product', 'customer']) AS scenario)
 UNION ALL SELECT date, scenario, hour, invoice, stock_code, description, quantity, customer_id, country, revenue FROM injected),
listed AS (
 SELECT *, coalesce(revenue / nullif(sum(revenue) OVER (PARTITION BY date, scenario, dimension), 0) * 100, 0) AS pct,
  row_number() OVER (PARTITION BY date, scenario, dimension ORDER BY revenue DESC, k1 NULLS LAST, k2 NULLS LAST) AS rank
 FROM (SELECT date, scenario, 'product' AS dimension, description AS cause, stock_code AS k1, description AS k2, sum(revenue) AS revenue FROM trial GROUP BY ALL
  UNION ALL SELECT date, scenario, 'customer', cast(customer_id AS VARCHAR), lpad(cast(customer_id AS VARCHAR), 20, '0'), NULL, sum(revenue) FROM trial
   WHERE customer_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT date, scenario, 'country', country, country, NULL, sum(revenue) FROM trial GROUP BY ALL
  UNION ALL SELECT date, scenario, 'hour', printf('%02d:00', hour), printf('%02d', hour), NULL, sum(revenue) FROM trial GROUP BY ALL)),
scenario_causes AS (
 SELECT *, row_number() OVER (PARTITION BY date, scenario ORDER BY round(pct, 9) DESC, round(revenue, 4) DESC, dimension, rank) AS cause_rank
 FROM listed WHERE rank <= 10),
positions AS (
 SELECT t.scenario, t.date, coalesce(t.country, t.description, cast(t.customer_id AS VARCHAR)) AS expected_target,
  (SELECT min(cause_rank) FROM scenario_causes c WHERE c.date = t.date AND c.scenario = t.scenario AND c.dimension = t.scenario AND c.cause_rank <= 10
   AND c.cause IS NOT DISTINCT FROM coalesce(t.country, t.description, cast(t.customer_id AS VARCHAR))) AS target_rank
 FROM targets t)"""
register(
    "select_targets", "date:d scenario:s stock_code:s description:s customer_id:n country:s",
    lambda spark, folder: _days(spark, folder)[1], "SELECT * FROM targets", views="scored", helpers=TRIALS,
)
register(
    "inject_member_rows",
    "date:d scenario:s hour:n invoice:s stock_code:s description:s quantity:n customer_id:n country:s revenue:f",
    lambda spark, folder: b.inject_member_rows(_days(spark, folder)[1]), "SELECT * FROM injected", views="scored", helpers=TRIALS,
)


def _ranks(spark, folder):
    measures, targets = _days(spark, folder)
    return b.target_rank(b.ranked_from(measures, targets), targets)


register(
    "target_rank", "date:d scenario:s expected_target:s target_rank:n", _ranks, "SELECT * FROM positions",
    views="scored", helpers=TRIALS,
)


def _scenarios(spark, folder):
    found = b.scenario_eval_from(*_days(spark, folder))
    second = F.get("top_5", F.lit(1))
    return found.withColumns({"causes": F.size("top_5"), "second": F.concat_ws(" ", second["dimension"], second["cause"])})


RESULT = (
    "date:d scenario:s expected_dimension:s expected_target:s synthetic_revenue:m target_rank:n top_1_correct:b "
    "top_3_correct:b predicted_top_1:s"
)
RESULT_SQL = """SELECT p.*, scenario AS expected_dimension, 100000 AS synthetic_revenue, coalesce(target_rank = 1, false) AS top_1_correct,
 coalesce(target_rank <= 3, false) AS top_3_correct,
 (SELECT dimension FROM scenario_causes c WHERE c.date = p.date AND c.scenario = p.scenario AND cause_rank = 1) AS predicted_top_1,
 (SELECT count(*) FROM scenario_causes c WHERE c.date = p.date AND c.scenario = p.scenario AND cause_rank <= 5) AS causes,
 (SELECT concat_ws(' ', dimension, cause) FROM scenario_causes c WHERE c.date = p.date AND c.scenario = p.scenario AND cause_rank = 2) AS second FROM positions p"""
register("scenario_eval", f"{RESULT} causes:n second:s", _scenarios, RESULT_SQL, views="scored", helpers=TRIALS)
ACCURACY = "scenario_count:n top_1_correct:n top_3_correct:n top_1_accuracy:f top_3_accuracy:f"
ACCURACY_SQL = """SELECT count(*) AS scenario_count, count(*) FILTER (WHERE top_1_correct) AS top_1_correct,
 count(*) FILTER (WHERE top_3_correct) AS top_3_correct, avg(cast(top_1_correct AS INT)) AS top_1_accuracy,
 avg(cast(top_3_correct AS INT)) AS top_3_accuracy FROM ({results})"""
register(
    "accuracy", ACCURACY, lambda spark, folder: b.accuracy(b.scenario_eval_from(*_days(spark, folder))),
    ACCURACY_SQL.format(results=RESULT_SQL), views="scored", helpers=TRIALS,
)


def _dimensions(spark, folder):
    """Expected dimension by rule: country for dips, product for spikes."""
    tx = stored(spark, folder)
    days = stage(flagged_days(tx), "flagged")
    ranked = rank_root_causes(all_contributions(stage(lines_on(tx, days), "lines")))
    rule = F.when(F.col("z_score") < 0, "country").otherwise("product")
    expected = days.select("date", F.concat(F.lit("day "), F.col("date").cast("string")).alias("scenario"), rule.alias("expected_dimension"))
    return b.dimension_eval(ranked, expected).withColumn("third", F.get("top_3_dimensions", F.lit(2)))


register(
    "dimension_eval", "date:d scenario:s expected_dimension:s predicted_top_1:s third:s top_1_correct:b top_3_correct:b", _dimensions,
    """SELECT date, 'day ' || cast(date AS VARCHAR) AS scenario, expected_dimension, predicted_top_1, third,
 coalesce(predicted_top_1 = expected_dimension, false) AS top_1_correct,
 coalesce(list_contains(tops, expected_dimension), false) AS top_3_correct
FROM (SELECT s.date, CASE WHEN z_score < 0 THEN 'country' ELSE 'product' END AS expected_dimension FROM scored s WHERE is_anomaly) e
 LEFT JOIN (SELECT date, min(dimension) FILTER (WHERE cause_rank = 1) AS predicted_top_1, min(dimension) FILTER (WHERE cause_rank = 3) AS third,
  list(dimension) AS tops FROM causes WHERE cause_rank <= 3 GROUP BY 1) r USING (date)""",
    views="scored", helpers=LEADERS,
)
