"""Isolation forest (Liu, Ting and Zhou, 2008) over daily measures, grown and scored on the executors.

Each tree sees at most 256 days, so growing a tree is one small group; trees (and series) are the parallelism.
Rows are drawn by a seeded hash of the day, which makes the forest independent of partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

FEATURES = ["revenue", "orders", "aov", "customers", "units_sold"]
TREES = 100
SAMPLE = 256
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double, sample int"


def expected_path(rows: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree over ``rows`` keys."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1) + np.euler_gamma) - 2.0 * (rows - 1) / rows


def grow_tree(values: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random axis-parallel splits down to single rows or the depth limit; node rows as in NODE_SCHEMA."""
    limit = math.ceil(math.log2(max(len(values), 2)))
    nodes: list[tuple] = [()]
    pending = [(0, values, 0)]
    while pending:
        node, part, depth = pending.pop()
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes[node] = (node, -1, 0.0, -1, -1, depth + expected_path(len(part)))
            continue
        feature = int(rng.choice(spread))
        column = part[:, feature]
        threshold = float(rng.uniform(column.min(), column.max()))
        goes_left = column <= threshold
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[node] = (node, feature, threshold, left, right, 0.0)
        pending += [(left, part[goes_left], depth + 1), (right, part[~goes_left], depth + 1)]
    return nodes


def isolation_scores(values: np.ndarray, forest: pd.DataFrame) -> np.ndarray:
    """-2^(-mean path / expected path) per row: close to -1 for rows that are isolated quickly."""
    depths = np.zeros(len(values))
    trees = 0
    for _, tree in forest.sort_values(["tree", "node"]).groupby("tree"):
        feature, threshold = tree["feature"].to_numpy(), tree["threshold"].to_numpy()
        left, right, path = tree["left"].to_numpy(), tree["right"].to_numpy(), tree["path"].to_numpy()
        at = np.zeros(len(values), dtype=int)
        inner = feature[at] >= 0
        while inner.any():
            rows = np.flatnonzero(inner)
            here = at[rows]
            goes_left = values[rows, feature[here]] <= threshold[here]
            at[rows] = np.where(goes_left, left[here], right[here])
            inner = feature[at] >= 0
        depths += path[at]
        trees += 1
    scale = max(expected_path(int(forest["sample"].max())), 1e-12)
    return -np.power(2.0, -(depths / trees) / scale)


def draw_samples(daily: DataFrame, seed: int, keys: tuple[str, ...], trees: int, sample: int) -> DataFrame:
    """Up to ``sample`` distinct days for each tree and series.

    A day's row decides for itself, by hash, which trees might take it (about twice as many as needed); only
    those pairs are expanded, and an exact rank trims each tree to its sample size.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / size)
    place = [F.col(k) for k in keys] + [F.col("date")]

    def draw(tree):
        return F.xxhash64(F.lit(seed), tree, *place)

    def candidate(tree):
        return F.pmod(draw(tree), F.lit(1_000_000)) < F.col("_share") * 1_000_000

    candidates = daily.withColumn("_share", share).select(
        *keys, *[F.col(f).cast("double").alias(f) for f in FEATURES], "date",
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), candidate)).alias("tree"),
    )
    order = Window.partitionBy(*keys, "tree").orderBy(draw(F.col("tree")), "date")
    return candidates.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= sample).drop("_rank")


def grow_forest(
    daily: DataFrame, seed: int = 42, keys: tuple[str, ...] = (), trees: int = TREES, sample: int = SAMPLE
) -> DataFrame:
    """Node rows of all trees of all series."""
    samples = draw_samples(daily, seed, keys, trees, sample)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        values = pdf.sort_values("date")[FEATURES].to_numpy(dtype=float)
        nodes = grow_tree(values, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "path"])
        out.insert(0, "tree", tree)
        out["sample"] = len(values)
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out

    schema = NODE_SCHEMA + "".join(f", {k} {daily.schema[k].dataType.simpleString()}" for k in keys)
    return samples.groupBy(*keys, "tree").applyInPandas(build, schema)


def multivariate_anomalies(
    daily: DataFrame,
    contamination: float = 0.02,
    seed: int = 42,
    keys: tuple[str, ...] = (),
    trees: int = TREES,
    sample: int = SAMPLE,
) -> DataFrame:
    """Add isolation_score (negative for outliers) and is_multivariate_anomaly to daily measures.

    The score is shifted by the exact ``contamination`` percentile of its series, as one cut per series.
    """
    forest = grow_forest(daily, seed, keys, trees, sample)
    schema = StructType([*daily.schema.fields, StructField("_score", DoubleType())])
    if keys:
        # One forest per series: its nodes meet its days in one group, both bounded (trees x nodes, calendar days).
        def score_group(days: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            return days.assign(_score=isolation_scores(days[FEATURES].to_numpy(dtype=float), nodes))

        scored = daily.groupBy(*keys).cogroup(forest.groupBy(*keys)).applyInPandas(score_group, schema)
    else:
        # A single forest has at most trees x (2 x sample - 1) nodes whatever the data size.
        nodes = forest.toPandas()

        def score_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for days in batches:
                yield days.assign(_score=isolation_scores(days[FEATURES].to_numpy(dtype=float), nodes))

        scored = daily.mapInPandas(score_batches, schema)
    cut = F.percentile("_score", F.lit(contamination)).over(Window.partitionBy(*keys))
    return (
        scored.withColumn("isolation_score", F.col("_score") - cut)
        .withColumn("is_multivariate_anomaly", F.col("isolation_score") < 0)
        .drop("_score")
    )
