"""Next-week revenue: calendar features over the daily series, boosted trees, evaluation and forecasts.

The feature operators take one row per calendar day (and series), so their ordered windows stay small.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwright.functions.scalar import day_of, percent_of, ratio, ratio_or_zero
from tillwright.operators.kpi import daily_metrics
from tillwright.plans.staging import shared_root, stage

Keys = tuple[str, ...]

TARGET = "next_7_days_revenue"
LAGS = (1, 7, 14)
ROLLING = (7, 30)
HORIZON = 7
HISTORY = [f"revenue_lag_{n}" for n in LAGS] + [f"revenue_rolling_{n}" for n in ROLLING]
# Model inputs in order.
FEATURES = [
    "day_of_week", "day_of_month", "month", "year",
    "revenue_lag_1", "revenue_lag_7", "revenue_lag_14", "revenue_rolling_7", "revenue_rolling_30",
    "orders", "customers", "aov", "repeat_customer_rate",
]
MINIMUM_ROWS = 20
ROWS_PER_TRAINING_TASK = 20_000


def densify(daily: DataFrame, keys: Keys = ()) -> DataFrame:
    """Every calendar day from the first to the last of a series; days without data have null measures."""
    bounds = daily.filter(F.col("date").isNotNull()).groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    calendar = bounds.filter(F.col("a").isNotNull()).select(
        *keys, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date")
    )
    return calendar.join(daily, [*keys, "date"], "left")


def zero_fill(dense: DataFrame) -> DataFrame:
    """Days without data have zero revenue, orders, customers and units; order value is 0 without orders.

    Measures that the series does not have are left out.
    """
    filled = dense.fillna(0, [c for c in ("revenue", "orders", "customers", "units_sold") if c in dense.columns])
    if "orders" not in filled.columns:
        return filled
    return filled.withColumn("aov", F.when(F.col("orders") > 0, ratio_or_zero(F.col("revenue"), F.col("orders"))).otherwise(0.0))


def daily_repeat_rate(tx: DataFrame, keys: Keys = ()) -> DataFrame:
    """Percentage of a day's known customers with more than one invoice that day."""
    orders = (
        tx.filter(F.col("customer_id").isNotNull() & F.col("invoice_ts").isNotNull())
        .groupBy(*keys, day_of(F.col("invoice_ts")).alias("date"), "customer_id")
        .agg(F.count_distinct("invoice").alias("_orders"))
    )
    rate = percent_of(F.count_if(F.col("_orders") > 1), F.count(F.lit(1)))
    return orders.groupBy(*keys, "date").agg(rate.alias("repeat_customer_rate"))


def with_repeat_rate(dense: DataFrame, rates: DataFrame | None, keys: Keys = ()) -> DataFrame:
    """Join the daily repeat rate; days without it, or without transactions at all, have 0."""
    if rates is None:
        return dense.withColumn("repeat_customer_rate", F.lit(0.0))
    return dense.join(rates, [*keys, "date"], "left").fillna(0.0, ["repeat_customer_rate"])


def calendar_features(dense: DataFrame) -> DataFrame:
    """Day of week (Monday 0), day of month, month and year."""
    return dense.withColumns({
        "day_of_week": F.weekday("date"), "day_of_month": F.dayofmonth("date"),
        "month": F.month("date"), "year": F.year("date"),
    })


def lags(dense: DataFrame, keys: Keys = ()) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("date")
    return dense.withColumns({f"revenue_lag_{n}": F.lag("revenue", n).over(order) for n in LAGS})


def rolling_means(dense: DataFrame, keys: Keys = ()) -> DataFrame:
    """Mean revenue of the previous 7 and 30 days, null until that many days exist."""
    order = Window.partitionBy(*keys).orderBy("date")

    def mean(n: int):
        frame = order.rowsBetween(-n, -1)
        return F.when(F.count("revenue").over(frame) == n, F.avg("revenue").over(frame))

    return dense.withColumns({f"revenue_rolling_{n}": mean(n) for n in ROLLING})


def forward_target(dense: DataFrame, keys: Keys = ()) -> DataFrame:
    """Revenue of the next seven days, null unless all seven exist."""
    frame = Window.partitionBy(*keys).orderBy("date").rowsBetween(1, HORIZON)
    complete = F.count("revenue").over(frame) == HORIZON
    return dense.withColumn(TARGET, F.when(complete, F.sum("revenue").over(frame)))


def feature_rows(daily: DataFrame, tx: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    """All features and the target for every calendar day, incomplete ones included."""
    rates = None if tx is None else daily_repeat_rate(tx, keys)
    dense = with_repeat_rate(zero_fill(densify(daily, keys)), rates, keys)
    return forward_target(rolling_means(lags(calendar_features(dense), keys), keys), keys)


def training_rows(rows: DataFrame) -> DataFrame:
    """Rows with complete history and target."""
    return rows.dropna(subset=[*HISTORY, TARGET])


def forecasting_data(daily: DataFrame, tx: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    return training_rows(feature_rows(daily, tx, keys))


def require_history(rows: DataFrame, minimum: int = MINIMUM_ROWS) -> DataFrame:
    """Raise ValueError below ``minimum`` training rows."""
    if rows.limit(minimum).count() < minimum:
        raise ValueError(f"A forecast needs at least {minimum} days with complete history")
    return rows


def chrono_split(rows: DataFrame, train_tenths: int = 8, keys: Keys = ()) -> DataFrame:
    """Add is_train: the first ``train_tenths`` tenths of the rows by date (rounded down)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("is_train", place * 10 <= size * train_tenths - (size * train_tenths) % 10)


def train(rows: DataFrame, rounds: int = 300, seed: int = 42) -> PipelineModel:
    """Fit boosted regression trees: depth 6, rate 0.05, 0.8 of rows per tree and of features per split.

    Boosting keeps a growing lineage of residuals, which is cut every ten rounds in the checkpoint folder. Every
    round runs several small jobs, so rows are packed into few partitions, ordered by date: this also makes the
    sampled rows, and with them the model, independent of how the input was partitioned.
    """
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    packed = rows.repartitionByRange(max(1, rows.count() // ROWS_PER_TRAINING_TASK), "date").sortWithinPartitions("date")
    trees = GBTRegressor(
        featuresCol="features", labelCol=TARGET, predictionCol="prediction", maxIter=rounds, maxDepth=6, stepSize=0.05,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", lossType="squared", checkpointInterval=10, seed=seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(packed)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).drop("features")


def evaluate(predictions: DataFrame) -> DataFrame:
    """Train and test sizes, and MAE, RMSE and MAPE (over non-zero actuals) of the test rows.

    ``predictions`` has is_train, the target and prediction.
    """
    actual, test = F.col(TARGET), ~F.col("is_train")
    error = F.col("prediction") - actual
    return predictions.agg(
        F.count_if(F.col("is_train")).alias("train_rows"),
        F.count_if(test).alias("test_rows"),
        F.avg(F.when(test, F.abs(error))).alias("mae"),
        F.sqrt(F.avg(F.when(test, error * error))).alias("rmse"),
        (F.avg(F.when(test & (actual != 0), F.abs(ratio(error, actual)))) * 100).alias("mape"),
    )


def forecast(model: PipelineModel, rows: DataFrame, mode: str = "reference") -> DataFrame:
    """The forecast of one row: the date it is based on and the predicted revenue of the next seven days.

    ``mode="reference"`` uses the last row whose following week is already known; ``mode="future"`` the last
    row with complete features, which predicts days that have not happened.
    """
    needed = {"reference": [*HISTORY, TARGET], "future": HISTORY}
    if mode not in needed:
        raise ValueError("mode must be 'reference' or 'future'")
    latest = rows.dropna(subset=needed[mode]).orderBy(F.desc("date")).limit(1)
    return predict(model, latest).select(F.col("date").alias("based_on_date"), F.col("prediction").alias(TARGET))


def prediction_history(predictions: DataFrame, n: int = 60) -> DataFrame:
    """The last ``n`` test rows with actual and predicted values, ascending."""
    test = predictions.filter(~F.col("is_train")).orderBy(F.desc("date")).limit(n)
    return test.select("date", F.col(TARGET).alias("actual"), F.col("prediction").alias("predicted")).orderBy("date")


def naive_forecast(rows: DataFrame) -> DataFrame:
    """Yardstick: the next week repeats the previous one."""
    return rows.withColumn("prediction", F.col("revenue_rolling_7") * HORIZON)


def evaluation_artifact(tx: DataFrame, rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row about an evaluation run: input sizes, feature date range and the metrics.

    ``rows`` are the training rows and ``predictions`` their split and scored form.
    """
    parts = [
        tx.agg(F.count(F.lit(1)).alias("transaction_rows"), F.count_distinct(day_of(F.col("invoice_ts"))).alias("daily_rows")),
        rows.agg(F.count(F.lit(1)).alias("feature_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")),
        evaluate(predictions),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def staged_features(tx: DataFrame) -> DataFrame:
    """``feature_rows`` of clean transactions, written once: one row per day, however many lines."""
    return stage(feature_rows(stage(daily_metrics(tx), "daily"), tx), "features")


def forecast_run(
    tx: DataFrame, rounds: int = 300, seed: int = 42, mode: str = "reference", everything: DataFrame | None = None
):
    """Features, split, evaluation model, final model and forecast from clean transactions.

    ``everything`` are the ``staged_features`` of the transactions, if the caller has them; the lines are not read then.
    """
    everything = staged_features(tx) if everything is None else everything
    rows = require_history(training_rows(everything))
    split = chrono_split(rows)
    evaluation_model = train(split.filter("is_train"), rounds, seed)
    predictions = predict(evaluation_model, split)
    final_model = train(rows, rounds, seed)
    return rows, predictions, final_model, forecast(final_model, everything, mode)
