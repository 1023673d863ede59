"""Next-week revenue of many series (countries, products) by one pooled model.

A model per series would be fitted as often as there are series. Here all series share one boosted model over relative
features: revenues are divided by the series' own level, the mean next-week revenue of its training days. Levels come
from the training part alone (the first eight tenths of each series by date), so no test day reaches its own encoding.
Series with too few training days have no level and are forecast by the naive rule.

The fit is dealt out by series and date, the rest works per series: nothing collects a series or the list of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.functions.scalar import ratio
from tillwright.operators.forecast import HISTORY, HORIZON, ROWS_PER_TRAINING_TASK, TARGET, Keys, chrono_split
from tillwright.plans.staging import bounded_side, shared_root, stage

# Training days that a series needs for a level of its own.
LEAST_DAYS = 20
RELATIVE = [f"relative_{name}" for name in HISTORY]
INPUTS = ["day_of_week", "day_of_month", "month", "year", *RELATIVE, "trend"]


@dataclass(frozen=True)
class PooledModel:
    """A model of relative revenue and the levels (keys, level, days) that scale it; ``keys`` name the series."""

    trees: PipelineModel
    levels: DataFrame
    keys: Keys


def series_levels(split: DataFrame, keys: Keys, least_days: int = LEAST_DAYS) -> DataFrame:
    """(keys, level, days): mean target of the training rows of each series that has enough of them; staged."""
    known = split.filter(F.col("is_train") & F.col(TARGET).isNotNull())
    levels = known.groupBy(*keys).agg(F.avg(TARGET).alias("level"), F.count(F.lit(1)).alias("days"))
    return stage(levels.filter((F.col("days") >= least_days) & (F.col("level") > 0)), "levels")


def with_levels(rows: DataFrame, levels: DataFrame, keys: Keys) -> DataFrame:
    """Add level (null where a series has none) and the relative features. Levels are broadcast within a counted bound."""
    joined = rows.join(bounded_side(levels.select(*keys, "level"), "levels"), list(keys), "left")
    weekly: Column = F.col("level") / HORIZON
    relative = {f"relative_{name}": ratio(F.col(name), weekly) for name in HISTORY}
    return joined.withColumns({**relative, "trend": F.col("revenue_rolling_7") / F.nullif(F.col("revenue_rolling_30"), F.lit(0.0))}).fillna(1.0, ["trend"])


def train_pooled(split: DataFrame, keys: Keys, rounds: int = 60, depth: int = 5, step: float = 0.1, seed: int = 42) -> PooledModel:
    """Fit on the training rows of ``split`` (see ``split_series``), in partitions by series and date."""
    spark = split.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    levels = series_levels(split, keys)
    known = with_levels(split.filter("is_train"), levels, keys).filter("level is not null")
    known = stage(known.withColumn("relative_target", F.col(TARGET) / F.col("level")), "pooled-rows")
    tasks = max(1, known.count() // ROWS_PER_TRAINING_TASK)
    packed = known.repartitionByRange(tasks, *keys, "date").sortWithinPartitions(*keys, "date")
    trees = GBTRegressor(
        featuresCol="features", labelCol="relative_target", predictionCol="relative_prediction", maxIter=rounds, maxDepth=depth, stepSize=step,
        subsamplingRate=0.8, lossType="squared", checkpointInterval=10, seed=seed,
    )
    return PooledModel(Pipeline(stages=[VectorAssembler(inputCols=INPUTS, outputCol="features"), trees]).fit(packed), levels, keys)


def split_series(rows: DataFrame, keys: Keys, train_tenths: int = 8) -> DataFrame:
    """``chrono_split`` of each series; a series is one row per day, so its window stays small."""
    return chrono_split(rows, train_tenths, keys)


def predict_series(model: PooledModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction``: by the pooled model, or naively (next week repeats the last) for a series without level."""
    leveled = with_levels(rows, model.levels, model.keys)
    scored = model.trees.transform(leveled.fillna(0.0, RELATIVE)).drop("features")
    pooled = F.greatest(F.lit(0.0), F.col("relative_prediction")) * F.col("level")
    return scored.withColumn("prediction", F.coalesce(pooled, F.col("revenue_rolling_7") * HORIZON)).drop(*RELATIVE, "trend", "relative_prediction")


def evaluate_series(predictions: DataFrame, keys: Keys) -> DataFrame:
    """Per series: train and test rows, MAE and RMSE of the test rows, and those of the naive rule on the same rows."""
    actual, test = F.col(TARGET), ~F.col("is_train")
    error, naive = F.col("prediction") - actual, F.col("revenue_rolling_7") * HORIZON - actual
    return predictions.groupBy(*keys).agg(
        F.count_if(F.col("is_train")).alias("train_rows"), F.count_if(test).alias("test_rows"),
        F.avg(F.when(test, F.abs(error))).alias("mae"), F.sqrt(F.avg(F.when(test, error * error))).alias("rmse"),
        F.avg(F.when(test, F.abs(naive))).alias("naive_mae"), F.sqrt(F.avg(F.when(test, naive * naive))).alias("naive_rmse"),
    )


def forecast_series(model: PooledModel, rows: DataFrame, mode: str = "reference") -> DataFrame:
    """Per series: the date its forecast is based on and the predicted revenue of the next seven days.

    Modes as in ``forecast``. The last row of a series is found by an aggregate over dates, not by ordering its rows.
    """
    needed = {"reference": [*HISTORY, TARGET], "future": HISTORY}
    if mode not in needed:
        raise ValueError("mode must be 'reference' or 'future'")
    complete = rows.dropna(subset=needed[mode])
    last = complete.groupBy(*model.keys).agg(F.max("date").alias("date"))
    latest = complete.join(last, [*model.keys, "date"], "left_semi")
    return predict_series(model, latest).select(*model.keys, F.col("date").alias("based_on_date"), F.col("prediction").alias(TARGET))


def history_of_series(predictions: DataFrame, keys: Keys, n: int = 60) -> DataFrame:
    """The last ``n`` test rows of each series with actual and predicted values."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    latest = predictions.filter(~F.col("is_train")).withColumn("_place", place).filter(F.col("_place") <= n)
    return latest.select(*keys, "date", F.col(TARGET).alias("actual"), F.col("prediction").alias("predicted"))
