"""Forecast feature, model and explanation queries."""

from pyspark.sql import functions as F

from tillwright.catalog.base import clean, daily, register, stored
from tillwright.operators import forecast as f
from tillwright.operators import series_forecast as series
from tillwright.operators import treeshap
from tillwright.operators.kpi import daily_metrics, daily_revenue
from tillwright.plans.staging import once, stage

DENSE = """filled AS (
 SELECT cast(day AS DATE) AS date, coalesce(revenue, 0) AS revenue, coalesce(orders, 0) AS orders, coalesce(customers, 0) AS customers,
  coalesce(units_sold, 0) AS units_sold, coalesce(aov, 0) AS aov
 FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM daily)
 LEFT JOIN daily ON cast(day AS DATE) = date),
rates AS (
 SELECT date, count(*) FILTER (WHERE n > 1) * 100.0 / count(*) AS repeat_customer_rate
 FROM (SELECT cast(invoice_ts AS DATE) AS date, customer_id, count(DISTINCT invoice) AS n FROM clean
  WHERE customer_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
features AS (
 SELECT f.*, coalesce(repeat_customer_rate, 0) AS repeat_customer_rate, isodow(f.date) - 1 AS day_of_week, day(f.date) AS day_of_month,
  month(f.date) AS month, year(f.date) AS year,
  lag(revenue, 1) OVER o AS revenue_lag_1, lag(revenue, 7) OVER o AS revenue_lag_7, lag(revenue, 14) OVER o AS revenue_lag_14,
  CASE WHEN row_number() OVER o > 7 THEN avg(revenue) OVER (ORDER BY f.date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS revenue_rolling_7,
  CASE WHEN row_number() OVER o > 30 THEN avg(revenue) OVER (ORDER BY f.date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) END AS revenue_rolling_30,
  CASE WHEN row_number() OVER (ORDER BY f.date DESC) > 7 THEN sum(revenue) OVER (ORDER BY f.date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) END
   AS next_7_days_revenue
 FROM filled f LEFT JOIN rates r ON r.date = f.date WINDOW o AS (ORDER BY f.date)),
training AS (SELECT * FROM features WHERE revenue_rolling_30 IS NOT NULL AND next_7_days_revenue IS NOT NULL),
split AS (
 SELECT *, row_number() OVER (ORDER BY date) <= 4 * count(*) OVER () // 5 AS is_train, revenue_rolling_7 * 7 AS prediction FROM training)"""
DAY = "date:d revenue:m orders:n customers:n units_sold:n aov:f"
HISTORY = "revenue_lag_1:m revenue_lag_7:m revenue_lag_14:m revenue_rolling_7:f revenue_rolling_30:f"
CALENDAR = "day_of_week:n day_of_month:n month:n year:n"


def _filled(spark, folder):
    return f.zero_fill(f.densify(daily(spark, folder)))


def _gaps(spark, folder):
    """A daily series with calendar gaps: days with few orders are left out."""
    return daily(spark, folder).filter(F.col("orders") % 3 != 0)


register(
    "densify", "date:d revenue:m orders:n", lambda spark, folder: f.densify(_gaps(spark, folder)),
    """SELECT cast(day AS DATE) AS date, revenue, orders
FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM gaps)
 LEFT JOIN gaps ON cast(day AS DATE) = date""",
    views="daily", helpers="gaps AS (SELECT * FROM daily WHERE orders % 3 <> 0)",
)
register("zero_fill", DAY, _filled, "SELECT * FROM filled", views="daily", helpers=DENSE)
register(
    "daily_repeat_rate", "date:d repeat_customer_rate:f", lambda spark, folder: f.daily_repeat_rate(clean(spark, folder)),
    "SELECT * FROM rates", views="daily", helpers=DENSE,
)
register(
    "calendar_features", f"date:d {CALENDAR}", lambda spark, folder: f.calendar_features(_filled(spark, folder)),
    "SELECT * FROM features", views="daily", helpers=DENSE,
)
register(
    "lags", "date:d revenue_lag_1:m revenue_lag_7:m revenue_lag_14:m", lambda spark, folder: f.lags(_filled(spark, folder)),
    "SELECT * FROM features", views="daily", helpers=DENSE,
)
register(
    "rolling_means", "date:d revenue_rolling_7:f revenue_rolling_30:f",
    lambda spark, folder: f.rolling_means(_filled(spark, folder)), "SELECT * FROM features", views="daily", helpers=DENSE,
)
register(
    "forward_target", "date:d next_7_days_revenue:c", lambda spark, folder: f.forward_target(_filled(spark, folder)),
    "SELECT * FROM features", views="daily", helpers=DENSE,
)


def _features(spark, folder):
    tx = stored(spark, folder)
    return f.feature_rows(daily_metrics(tx), tx)


ROW = f"{DAY} repeat_customer_rate:f {CALENDAR} {HISTORY} next_7_days_revenue:c"
register("feature_rows", ROW, _features, "SELECT * FROM features", views="daily", helpers=DENSE)
register(
    "training_rows", ROW, lambda spark, folder: f.require_history(f.training_rows(stage(_features(spark, folder), "features"))),
    "SELECT * FROM training", views="daily", helpers=DENSE,
)


def _split(spark, folder):
    return f.chrono_split(f.training_rows(_features(spark, folder)))


register(
    "chrono_split", "date:d is_train:b", _split, "SELECT * FROM split", views="daily", helpers=DENSE
)
METRICS = "train_rows:n test_rows:n mae:r rmse:r mape:f"
SCORES_SQL = """count(*) FILTER (WHERE is_train) AS train_rows, count(*) FILTER (WHERE NOT is_train) AS test_rows,
 avg(abs(prediction - next_7_days_revenue)) FILTER (WHERE NOT is_train) AS mae,
 sqrt(avg(pow(prediction - next_7_days_revenue, 2)) FILTER (WHERE NOT is_train)) AS rmse,
 avg(abs((prediction - next_7_days_revenue) / nullif(next_7_days_revenue, 0))) FILTER (WHERE NOT is_train) * 100 AS mape"""
register(
    "evaluate", METRICS, lambda spark, folder: f.evaluate(f.naive_forecast(_split(spark, folder))),
    f"SELECT {SCORES_SQL} FROM split", views="daily", helpers=DENSE,
)
register(
    "prediction_history", "date:d actual:c predicted:r",
    lambda spark, folder: f.prediction_history(f.naive_forecast(_split(spark, folder))),
    """SELECT date, next_7_days_revenue AS actual, prediction AS predicted FROM split WHERE NOT is_train
ORDER BY date DESC LIMIT 60""",
    views="daily", helpers=DENSE,
)


def _artifact(spark, folder):
    tx = stored(spark, folder)
    rows = stage(f.training_rows(f.feature_rows(daily_metrics(tx), tx)), "features")
    return f.evaluation_artifact(tx, rows, f.naive_forecast(f.chrono_split(rows)))


register(
    "forecast_evaluation", f"transaction_rows:n daily_rows:n feature_rows:n first_date:d last_date:d {METRICS}", _artifact,
    f"""SELECT (SELECT count(*) FROM clean) AS transaction_rows, (SELECT count(*) FROM daily) AS daily_rows, count(*) AS feature_rows,
 min(date) AS first_date, max(date) AS last_date, {SCORES_SQL} FROM split""",
    views="daily", helpers=DENSE,
)


def _flow(spark, folder) -> dict:
    """The forecast flow with the operators' own parameters, run once per folder and application and kept as tables.

    Features, split, evaluation model and its predictions, final model on all rows, both forecasts, and the
    attributions of every row; the queries below read them.
    """

    def run() -> dict:
        tx = stored(spark, folder)
        everything = f.staged_features(tx)
        rows, predictions, final, reference = f.forecast_run(tx, everything=everything)
        future = f.forecast(final, everything, "future")
        forecasts = reference.withColumn("mode", F.lit("reference")).unionByName(future.withColumn("mode", F.lit("future")))
        scored = stage(predictions, "predictions")
        explained = treeshap.tree_shap(final, scored).join(f.predict(final, rows).select("date", "prediction"), "date")
        return {
            "predictions": scored, "forecasts": stage(forecasts, "forecasts"), "explained": stage(explained, "attributions"),
        }

    return once(spark, ("forecast-flow", folder), run)


def _within(value, predictions):
    """Boosted trees average targets, so a prediction stays near the range of the targets they were fitted on."""
    low, high = predictions.agg(F.min(f.TARGET), F.max(f.TARGET)).first()
    slack = (high - low) / 4 + 1
    return (value > low - slack) & (value < high + slack)


def _trained(spark, folder):
    predictions = _flow(spark, folder)["predictions"]
    own, naive = f.evaluate(predictions), f.evaluate(f.naive_forecast(predictions.drop("prediction")))
    errors = own.join(naive.select(F.col("mae").alias("naive_mae")))
    return errors.select("train_rows", "test_rows", (F.col("rmse") >= F.col("mae")).alias("ordered_errors"),
                         (F.col("mae") < F.col("naive_mae")).alias("beats_naive"))


SIZES_SQL = "count(*) FILTER (WHERE is_train) AS train_rows, count(*) FILTER (WHERE NOT is_train) AS test_rows"
register(
    "train", "train_rows:n test_rows:n ordered_errors:b beats_naive:b", _trained,
    f"SELECT {SIZES_SQL}, true AS ordered_errors, true AS beats_naive FROM split", views="daily", helpers=DENSE,
)


def _forecasts(spark, folder):
    flow = _flow(spark, folder)
    value = F.col("next_7_days_revenue")
    return flow["forecasts"].select("mode", "based_on_date", _within(value, flow["predictions"]).alias("in_range"))


register(
    "forecast", "mode:s based_on_date:d in_range:b", _forecasts,
    """SELECT 'reference' AS mode, max(date) AS based_on_date, true AS in_range FROM split
UNION ALL SELECT 'future', max(date), true FROM filled""",
    views="daily", helpers=DENSE,
)


def _history_of_model(spark, folder):
    predictions = _flow(spark, folder)["predictions"]
    history = f.prediction_history(predictions)
    return history.select("date", "actual", _within(F.col("predicted"), predictions).alias("in_range"))


register(
    "prediction_history_of_model", "date:d actual:c in_range:b", _history_of_model,
    """SELECT date, next_7_days_revenue AS actual, true AS in_range FROM split WHERE NOT is_train ORDER BY date DESC LIMIT 60""",
    views="daily", helpers=DENSE,
)


def _additive(explained):
    total = F.col("base_value")
    for feature in f.FEATURES:
        total = total + F.col(feature)
    return F.abs(total - F.col("prediction")) < 1e-6 * F.greatest(F.abs(F.col("prediction")), F.lit(1.0)) + 1e-3


def _attributed(spark, folder):
    explained = _flow(spark, folder)["explained"]
    return explained.select("date", _additive(explained).alias("additive"))


register(
    "tree_shap", "date:d additive:b", _attributed, "SELECT date, true AS additive FROM split", views="daily", helpers=DENSE
)


def _model_checks(spark, folder):
    """Properties of the whole flow in one row: sizes, a lower error than repeating last week, additive attributions."""
    flow = _flow(spark, folder)
    explained = flow["explained"]
    sums = explained.agg(F.count(F.lit(1)).alias("explained_rows"), F.every(_additive(explained)).alias("additive"))
    dates = flow["forecasts"].groupBy().pivot("mode", ["reference", "future"]).agg(F.max("based_on_date"))
    return _trained(spark, folder).drop("ordered_errors").join(sums).join(
        dates.withColumnsRenamed({"reference": "reference_date", "future": "future_date"})
    )


register(
    "model_checks",
    "train_rows:n test_rows:n beats_naive:b explained_rows:n additive:b reference_date:d future_date:d", _model_checks,
    f"""SELECT {SIZES_SQL}, true AS beats_naive, count(*) AS explained_rows, true AS additive, max(date) AS reference_date,
 (SELECT max(date) FROM filled) AS future_date FROM split""",
    views="daily", helpers=DENSE,
)


def _model_importance(spark, folder):
    """The importance list of the model: its length and order, and that no attribution of it is negative."""
    flow = _flow(spark, folder)
    recent = treeshap.recent_rows(flow["predictions"]).select("date")
    top = stage(treeshap.shap_importance(flow["explained"].join(recent, "date", "left_semi")), "importance")
    return top.agg(
        F.count(F.lit(1)).alias("features"), F.count_distinct("feature").alias("distinct_features"),
        F.every(F.col("importance") >= 0).alias("no_negative"), (F.max("importance") > 0).alias("some_positive"),
    )


register(
    "shap_importance_of_model", "features:n distinct_features:n no_negative:b some_positive:b", _model_importance,
    "SELECT 10 AS features, 10 AS distinct_features, true AS no_negative, count(*) > 0 AS some_positive FROM split",
    views="daily", helpers=DENSE,
)
register(
    "shap_importance", "feature:s importance:r",
    lambda spark, folder: treeshap.shap_importance(treeshap.recent_rows(_split(spark, folder))),
    "SELECT * FROM (\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs({c})) AS importance FROM recent" for c in f.FEATURES
    ) + ") ORDER BY importance DESC, feature LIMIT 10",
    views="daily", helpers=DENSE + ",\nrecent AS (SELECT * FROM split WHERE NOT is_train ORDER BY date DESC LIMIT 100)",
)


# --- many series by one model -----------------------------------------------------------------------------------------
COUNTRY = ("country",)


def _series_flow(spark, folder) -> dict:
    """Rows per country, their split, the predictions of the pooled model and the forecasts of every country, run once.

    The pooled model takes revenues and dates only, so orders and customers are not counted.
    """

    def run() -> dict:
        tx = stored(spark, folder)
        rows = stage(f.feature_rows(stage(daily_revenue(tx, COUNTRY), "daily-by-country"), keys=COUNTRY), "features-by-country")
        split = stage(series.split_series(f.training_rows(rows), COUNTRY), "split-by-country")
        model = series.train_pooled(split, COUNTRY)
        return {
            "split": split, "predictions": stage(series.predict_series(model, split), "predictions-by-country"),
            "future": stage(series.forecast_series(model, rows, "future"), "forecasts-by-country"),
            "levels": model.levels,
        }

    return once(spark, ("series-flow", folder), run)


BY_COUNTRY = """days AS (
 SELECT country, cast(invoice_ts AS DATE) AS date, cast(sum(revenue) AS DOUBLE) AS revenue FROM clean WHERE country IS NOT NULL GROUP BY 1, 2),
ends AS (SELECT country, min(date) AS a, max(date) AS b FROM days GROUP BY 1),
calendar AS (SELECT country, cast(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM ends),
dense AS (SELECT c.country, c.date, coalesce(revenue, 0) AS revenue FROM calendar c LEFT JOIN days d ON d.country = c.country AND d.date = c.date),
placed AS (
 SELECT country, date, row_number() OVER (PARTITION BY country ORDER BY date) AS nth, count(*) OVER (PARTITION BY country) AS n,
  sum(revenue) OVER (PARTITION BY country ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS target FROM dense),
usable AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date) AS place, count(*) OVER (PARTITION BY country) AS size
 FROM placed WHERE nth > 30 AND nth <= n - 7),
marked AS (SELECT *, place <= 8 * size // 10 AS is_train FROM usable)"""
register(
    "series_levels", "country:s days:n level:r", lambda spark, folder: _series_flow(spark, folder)["levels"],
    "SELECT country, count(*) AS days, avg(target) AS level FROM marked WHERE is_train GROUP BY 1 HAVING count(*) >= 20 AND avg(target) > 0",
    helpers=BY_COUNTRY,
)
register(
    "series_evaluation", "country:s train_rows:n test_rows:n ordered_errors:b near_naive_or_better:b",
    lambda spark, folder: series.evaluate_series(_series_flow(spark, folder)["predictions"], COUNTRY).withColumns({
        "ordered_errors": F.col("rmse") >= F.col("mae"), "near_naive_or_better": F.col("rmse") < 1.1 * F.col("naive_rmse")}),
    """SELECT country, count(*) FILTER (WHERE is_train) AS train_rows, count(*) FILTER (WHERE NOT is_train) AS test_rows,
 true AS ordered_errors, true AS near_naive_or_better FROM marked GROUP BY 1""",
    helpers=BY_COUNTRY,
)


def _series_forecasts(spark, folder):
    """Forecasts of the last day of each country, near the range of its targets."""
    flow = _series_flow(spark, folder)
    ranges = flow["split"].groupBy(*COUNTRY).agg(F.min(f.TARGET).alias("low"), F.max(f.TARGET).alias("high"))
    slack = (F.col("high") - F.col("low")) / 4 + 1
    inside = F.col(f.TARGET).between(F.col("low") - slack, F.col("high") + slack)
    return flow["future"].join(ranges, list(COUNTRY), "left").select("country", "based_on_date", inside.alias("in_range"))


register(
    "series_forecast", "country:s based_on_date:d in_range:b", _series_forecasts,
    "SELECT country, max(date) AS based_on_date, true AS in_range FROM dense GROUP BY 1 HAVING count(*) > 30", helpers=BY_COUNTRY,
)
register(
    "series_history", "country:s date:d actual:c",
    lambda spark, folder: series.history_of_series(_series_flow(spark, folder)["predictions"], COUNTRY, 10),
    """SELECT country, date, target AS actual FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date DESC) AS back
 FROM marked WHERE NOT is_train) WHERE back <= 10""",
    helpers=BY_COUNTRY,
)
