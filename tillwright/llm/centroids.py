"""Centroid clustering of integer vectors with ns-bounds (Newling and Fleuret, 2016).

Each vector keeps, per centroid, a lower bound of their distance and the round in which it was evaluated. The centroids
of all rounds are retained, so a bound is loosened by the norm of the centroid's total displacement since that round,
which is never more than the sum of its drifts from round to round. The distance to the own centroid is bounded from
above in the same way. A centroid whose lower bound exceeds the upper one can't be nearer; for the others, and only
for these, the squared distance is evaluated exactly in integers. Bounds are rounded to the safe side, so assignments
are those of a full scan, ties included (the smaller number wins).

A round is one pass over the staged vectors with their bounds, which writes the next table (the one before is dropped
when its successor is complete). Sums of centroids change by the vectors that moved only; the driver sees one row per
centroid.

A vector counts if it has exactly the asked number of components, none of them null, NaN or infinite. Components are
scaled, floored and held within +-2**27, so that a squared distance fits a long (longer vectors than 64 are refused).
Null ids are kept; they come last in the order that picks the first centroids. Repeated rows are vectors of their own.
Fewer vectors than centroids give as many centroids as vectors; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import stage_compressed_at, unstage

COMPONENTS = 64
SCALE = 256
LARGEST = 1 << 27
# Relative room for the rounding of square roots, norms and stored bounds (floats of 24 bits).
ROOM = 2.0**-20
# Vectors evaluated at once.
AT_ONCE = 4_096

_STATE = (
    "vec_id bigint, v array<int>, before int, cluster int, distance bigint, own_round tinyint, "
    "bounds array<float>, rounds array<tinyint>"
)
_SCHEMA = pa.schema([
    ("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("before", pa.int32()), ("cluster", pa.int32()),
    ("distance", pa.int64()), ("own_round", pa.int8()), ("bounds", pa.list_(pa.float32())), ("rounds", pa.list_(pa.int8())),
])


@dataclass(frozen=True)
class Clusters:
    """``assigned`` has vec_id, cluster and (squared) distance of every vector."""

    assigned: DataFrame
    centroids: list[list[int]]


def integer_vectors(vectors: DataFrame, column: str, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``, the scaled and floored components, of the vectors that count."""
    if components > COMPONENTS:
        raise ValueError(f"at most {COMPONENTS} components")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    held = lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    return vectors.filter((F.size(column) == components) & F.forall(column, finite)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(column, held).alias("v")
    )


def first_centroids(points: DataFrame, key: Column, k: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest keys; equal keys by their components."""
    return [list(r["v"]) for r in points.select(key.alias("_key"), "v").orderBy(F.asc_nulls_last("_key"), "v").limit(k).collect()]


def _squared(vectors: np.ndarray, centroids: np.ndarray, row: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs."""
    out = np.empty(len(row), np.int64)
    for at in range(0, len(row), 16 * AT_ONCE):
        part = slice(at, at + 16 * AT_ONCE)
        apart = vectors[row[part]] - centroids[which[part]]
        out[part] = np.einsum("ij,ij->i", apart, apart)
    return out


def assign(vectors, history, cluster, distance, own_round, bounds, rounds) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroids of one block of vectors after the last update of ``history`` (rounds, k, components).

    The state (arrays over vectors; bounds and rounds over centroids too) is brought up to date. Returns clusters,
    squared distances (as of ``own_round``) and how many distances were evaluated.
    """
    now = len(history) - 1
    centroids = history[now]
    # How far each centroid is now from where it was in each round.
    moved = np.sqrt(((history - centroids).astype(np.float64) ** 2).sum(axis=2)) * (1 + ROOM)
    every = np.arange(len(vectors))
    if now == 0:
        distances = np.stack([_squared(vectors, centroids, every, np.full(len(every), j)) for j in range(len(centroids))], axis=1)
        cluster[:] = distances.argmin(axis=1)
        distance[:] = distances[every, cluster]
        bounds[:] = np.sqrt(distances) * (1 - ROOM)
        rounds[:], own_round[:] = 0, 0
        return cluster, distance, distances.size
    lower = bounds - moved[rounds, np.arange(len(centroids))]
    upper = np.sqrt(distance) * (1 + ROOM) + moved[own_round, cluster]
    open_pairs = lower <= upper[:, None]
    open_pairs[every, cluster] = False
    doubtful = np.flatnonzero(open_pairs.any(axis=1))
    # The own distance first: it may settle the others.
    distance[doubtful] = _squared(vectors, centroids, doubtful, cluster[doubtful])
    own_round[doubtful] = now
    own = np.sqrt(distance[doubtful])
    bounds[doubtful, cluster[doubtful]], rounds[doubtful, cluster[doubtful]] = own * (1 - ROOM), now
    open_pairs[doubtful] &= lower[doubtful] <= (own * (1 + ROOM))[:, None]
    row, which = np.nonzero(open_pairs)
    exact = _squared(vectors, centroids, row, which)
    bounds[row, which], rounds[row, which] = np.sqrt(exact) * (1 - ROOM), now
    best = np.full((len(vectors), len(centroids)), np.iinfo(np.int64).max)
    best[doubtful, cluster[doubtful]] = distance[doubtful]
    best[row, which] = exact
    cluster[doubtful] = best[doubtful].argmin(axis=1)
    distance[doubtful] = best[doubtful, cluster[doubtful]]
    return cluster, distance, len(doubtful) + len(row)


def _matrix(batch: pa.RecordBatch, name: str, kind: type, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    offsets = pa.array(np.arange(rows + 1) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))


def _round(state: DataFrame, history: np.ndarray, exact: bool) -> DataFrame:
    """One assignment; with ``exact`` every distance is of this round."""
    shared = state.sparkSession.sparkContext.broadcast(history)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = shared.value
        now, k, width = len(history) - 1, history.shape[1], history.shape[2]
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                vectors = _matrix(batch, "v", np.int64, width)
                size = len(vectors)
                if now:
                    before = batch.column("cluster").to_numpy().copy()
                    distance, own_round = (batch.column(n).to_numpy().copy() for n in ("distance", "own_round"))
                    bounds, rounds = _matrix(batch, "bounds", np.float64, k), _matrix(batch, "rounds", np.int8, k)
                else:
                    before, distance, own_round = np.full(size, -1, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int8)
                    bounds, rounds = np.zeros((size, k)), np.zeros((size, k), np.int8)
                cluster = before.copy()
                assign(vectors, history, cluster, distance, own_round, bounds, rounds)
                if exact:
                    old = np.flatnonzero(own_round < now)
                    distance[old] = _squared(vectors, history[now], old, cluster[old])
                    own_round[old] = now
                columns = [
                    batch.column("vec_id"), _lists(vectors.astype(np.int32), pa.int32()), before, cluster, distance, own_round,
                    _lists(bounds.astype(np.float32), pa.float32()), _lists(rounds, pa.int8()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA
                )

    return state.mapInArrow(take, _STATE)


def _changes(state: DataFrame, k: int, width: int) -> list[tuple[int, int, list[int]]]:
    """(centroid, vectors more, sums more) of the centroids that vectors left or joined in the last round."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors = _matrix(batch, "v", np.int64, width)
            for name, sign in (("cluster", 1), ("before", -1)):
                own = batch.column(name).to_numpy()
                for j in np.unique(own[own >= 0]).tolist():
                    sums[j] += sign * vectors[own == j].sum(axis=0)
                    n[j] += sign * int((own == j).sum())
        touched = np.flatnonzero((n != 0) | (sums != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(touched.astype(np.int32)), pa.array(n[touched]), _lists(sums[touched], pa.int64())], schema=schema
        )

    moved = state.filter("before <> cluster").select("v", "before", "cluster")
    parts = moved.mapInArrow(take, "cluster int, n bigint, sums array<bigint>")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()
    return [(r["cluster"], r["n"], [int(r[f"s{i}"]) for i in range(width)]) for r in rows]


def cluster_vectors(points: DataFrame, start: list[list[int]], rounds: int) -> Clusters:
    """``rounds`` times: assign every vector of ``points`` (vec_id, v), then move each centroid that has vectors to the
    floor of their mean; then assign once more."""
    spark = points.sparkSession
    if not start:
        return Clusters(points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).filter("false"), [])
    k, width = len(start), len(start[0])
    history = [start]
    counts, sums = [0] * k, [[0] * width for _ in range(k)]
    state, path = points, None
    for now in range(rounds + 1):
        following, written = stage_compressed_at(_round(state, np.array(history, np.int64), now == rounds), f"clusters-{now}")
        if path:
            unstage(spark, path)
        state, path = following, written
        if now == rounds:
            break
        for j, n, more in _changes(state, k, width):
            counts[j] += n
            sums[j] = [a + b for a, b in zip(sums[j], more, strict=True)]
        last = history[-1]
        history.append([[s // counts[j] for s in sums[j]] if counts[j] else last[j] for j in range(k)])
    return Clusters(state.select("vec_id", "cluster", "distance"), history[-1])
