"""Additive feature attributions for boosted trees (path-dependent TreeSHAP; Lundberg et al., 2018 and 2020).

A leaf contributes its value only where all features on its path say so. Treating absent features as taking each
branch in proportion to the training rows that did, a leaf's value splits into per-feature Shapley shares that depend
only on the features of its path. Sums over leaves and trees give the attribution; rows are vectorised and distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tillwright.operators.forecast import FEATURES
from tillwright.plans.staging import shared_path

# Rows that one task explains at least.
ROWS_PER_TASK = 256
# Comparisons of rows with path features made at once.
CELLS_AT_ONCE = 1 << 21


@dataclass(frozen=True)
class Leaf:
    """Leaf value (tree weight included) and, per distinct path feature, its interval and share of training rows."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    cover: list[float]


def model_leaves(model: PipelineModel) -> list[Leaf]:
    """Leaves of all trees, read from the saved model: at most rounds x 2^depth, whatever the data size."""
    trees = model.stages[-1]
    spark = SparkSession.active()
    path = shared_path(spark, "trees")
    trees.save(path)
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["prediction"].alias("prediction"), node["rawCount"].alias("rows"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    )
    leaves: list[Leaf] = []
    for tree, table in nodes.toPandas().groupby("treeID"):
        leaves += tree_leaves(table.set_index("id"), trees.treeWeights[int(tree)])
    return leaves


def tree_leaves(table: pd.DataFrame, weight: float) -> list[Leaf]:
    rows = table.to_dict("index")
    found: list[Leaf] = []
    pending: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while pending:
        node, path = pending.pop()
        here = rows[node]
        if here["left"] < 0:
            found.append(Leaf(
                weight * here["prediction"], list(path), [p[0] for p in path.values()],
                [p[1] for p in path.values()], [p[2] for p in path.values()],
            ))
            continue
        feature, threshold = int(here["feature"]), float(here["threshold"])
        low, high, cover = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in (
            (here["left"], (low, min(high, threshold))), (here["right"], (max(low, threshold), high))
        ):
            share = rows[child]["rows"] / here["rows"] if here["rows"] else 0.0
            pending.append((child, {**path, feature: (*bounds, cover * share)}))
    return found


def base_value(leaves: list[Leaf]) -> float:
    """Prediction with every feature absent."""
    return float(sum(leaf.value * np.prod(leaf.cover) for leaf in leaves))


def attributions(values: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Attribution per row and feature, leaf by leaf: the definition that ``LeafTables`` holds ready.

    For a path feature i, the coalition sum over the other path features is the polynomial product of
    (cover_j + follows_j * x); its coefficient of x^s is the weight of coalitions of size s.
    """
    out = np.zeros_like(values, dtype=float)
    for leaf in leaves:
        size = len(leaf.features)
        if size == 0:
            continue
        columns = values[:, leaf.features]
        follows = ((columns > leaf.low) & (columns <= leaf.high)).astype(float)
        shares = _shares(follows, np.array(leaf.cover)[None, :], np.array([leaf.value]))
        for i, feature in enumerate(leaf.features):
            out[:, feature] += shares[:, i]
    return out


def _shares(follows: np.ndarray, cover: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What a leaf gives to each of its path features, for many patterns of which of them a row follows."""
    size = follows.shape[1]
    weights = np.array([factorial(s) * factorial(size - 1 - s) / factorial(size) for s in range(size)])
    out = np.empty(np.broadcast_shapes(follows.shape, cover.shape))
    for i in range(size):
        poly = np.zeros((size, len(out)))
        poly[0] = 1.0
        for count, j in enumerate(k for k in range(size) if k != i):
            grown = poly * cover[:, j]
            grown[1 : count + 2] += poly[: count + 1] * follows[:, j]
            poly = grown
        out[:, i] = value * (follows[:, i] - cover[:, i]) * (weights @ poly)
    return out


class LeafTables:
    """Attributions of a model, looked up.

    Which of its at most six path features a row follows is a bit pattern per leaf. A leaf's shares for every pattern
    are computed once per model; a row is then as many comparisons as its leaves have features, one lookup per leaf,
    and sums. Leaves of equal size are handled together.
    """

    def __init__(self, leaves: list[Leaf], features: int):
        self.features, self.groups = features, []
        for size in sorted({len(leaf.features) for leaf in leaves} - {0}):
            own = [leaf for leaf in leaves if len(leaf.features) == size]
            patterns = (np.arange(1 << size)[:, None] >> np.arange(size)) & 1
            cover = np.repeat(np.array([leaf.cover for leaf in own]), len(patterns), axis=0)
            value = np.repeat([leaf.value for leaf in own], len(patterns))
            shares = _shares(np.tile(patterns, (len(own), 1)).astype(float), cover, value)
            self.groups.append((
                np.array([leaf.features for leaf in own]), np.array([leaf.low for leaf in own]), np.array([leaf.high for leaf in own]),
                shares, np.arange(len(own)) * len(patterns), 1 << np.arange(size),
            ))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), self.features))
        for columns, low, high, shares, offset, bit in self.groups:
            rows = max(1, CELLS_AT_ONCE // columns.size)
            for at in range(0, len(values), rows):
                part = values[at : at + rows][:, columns]
                pattern = ((part > low) & (part <= high)) @ bit
                given = shares[pattern + offset]
                place = np.arange(len(part))[:, None, None] * self.features + columns
                out[at : at + rows] += np.bincount(place.ravel(), given.ravel(), len(part) * self.features).reshape(-1, self.features)
        return out


def tree_shap(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """date, base_value and one attribution column per feature; they add up to the model's prediction.

    The leaves are sent once to each executor; a task builds their tables once for all its rows.
    """
    leaves = model_leaves(model)
    start = base_value(leaves)
    shared = rows.sparkSession.sparkContext.broadcast(leaves)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = LeafTables(shared.value, len(FEATURES))
        for batch in batches:
            found = pd.DataFrame(tables(batch[FEATURES].to_numpy(dtype=float)), columns=FEATURES)
            found.insert(0, "base_value", start)
            found.insert(0, "date", batch["date"].to_numpy())
            yield found

    numbers = [StructField(c, DoubleType()) for c in ["base_value", *FEATURES]]
    schema = StructType([rows.schema["date"], *numbers])
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_PER_TASK))
    return rows.select("date", *FEATURES).repartition(tasks).mapInPandas(explain, schema)


def recent_rows(split: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` test rows, or the last ``n`` rows when there are no test rows."""
    latest = split.orderBy(F.col("is_train").asc(), F.desc("date")).limit(n)
    # Test rows sort first, so training rows may stay only if there is no test row among these n.
    any_test = F.max((~F.col("is_train")).cast("int")).over(Window.partitionBy())
    marked = latest.withColumn("_any_test", any_test == 1)
    return marked.filter(~F.col("is_train") | ~F.col("_any_test")).drop("_any_test")


def shap_importance(attributed: DataFrame, top_n: int = 10) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    row = attributed.agg(*[F.avg(F.abs(c)).alias(c) for c in FEATURES])
    return row.unpivot([], FEATURES, "feature", "importance").orderBy(F.desc("importance"), "feature").limit(top_n)
