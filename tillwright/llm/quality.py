"""Quality selection by ordinal regression with a cumulative logit link (McCullagh, 1980).

Labels give three grades: toxic (0), poor (1), good (2). One set of weights over hashed features of the whole text is
shared by ordered thresholds: P(grade <= k) = logistic(threshold_k - score). Expected grade and tail probabilities
follow; a document is selected if P(grade >= 2) is at least ``SELECT``.

Features are hashed to 32 bits, each counted once per document: words, their first characters, runs of symbols, and
coarse shapes of the text (share of distinct words, of letters). The weights are fitted by proximal gradient steps
with an L1 penalty, on a sample of labelled documents that is bounded by ``TRAIN_ROWS`` and drawn by a hash of the id;
few weights remain, so any text is scored by looking up its words.

Null texts are empty texts. Labels with a null are ignored; without labels nothing is known and all is selected.
Rows with null or repeated ids are scored like any other. An empty table gives no rows. Other columns are ignored
(``select_good`` returns them).

Very long texts are scored whole, by their different words. Labels that tie for the sample are drawn by a hash, then by id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tillwright.llm.common import texts_of, whole_text

GRADES = 3
SELECT = 0.5
# Labelled documents that the weights are fitted on, at most.
TRAIN_ROWS = 8_000
# Features in fewer or in more of the training documents carry no weight.
LEAST_DOCS, MOST_SHARE = 5, 0.5
PENALTY, STEPS = 2e-4, 400
# Grades seen before any label: good documents prevail.
PRIOR = (0.5, 0.5, 2.0)
PREFIXES = (4, 5)
REMEMBERED_WORDS = 150_000

WORD = re.compile(r"\w+")
SYMBOLS = re.compile(r"[^\w\s]+")


def _hash(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}{value}".encode("utf-8", "replace"))


def word_features(word: str) -> list[int]:
    return [_hash("w", word), *(_hash(f"p{k}", word[:k]) for k in PREFIXES if len(word) > k)]


def shape_features(text: str, words: list[str], distinct: set[str]) -> set[int]:
    """Runs of symbols, and coarse shares that tell lists, noise and repetition from prose."""
    found = {_hash("s", run[:8]) for run in set(SYMBOLS.findall(text))}
    if words:
        found.add(_hash("n", str(min(12, len(words).bit_length()))))
        share = len(distinct) / len(words)
        found.add(_hash("d", f"{min(len(words).bit_length(), 9)}:{int(share * 10)}"))
        letters = sum(map(len, words)) / max(1, len(text))
        found.add(_hash("l", str(int(letters * 20))))
        marks = len(SYMBOLS.findall(text)) / len(words)
        found.add(_hash("m", str(int(min(marks, 2) * 10))))
    return found


def features(text: str) -> set[int]:
    words = WORD.findall(text.casefold())
    distinct = set(words)
    found = shape_features(text, words, distinct)
    for word in distinct:
        found.update(word_features(word))
    return found


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of the hashed features and ascending thresholds between the grades."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, .. per score."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - scores[:, None], -500, 500)))


class Scorer:
    """Scores of texts; remembers which words carry weight."""

    def __init__(self, model: OrdinalModel):
        self.weights, self.words = model.weights, {}

    def _known(self, word: str) -> tuple[int, ...]:
        if (known := self.words.get(word)) is None:
            known = tuple(f for f in word_features(word) if f in self.weights)
            if len(self.words) < REMEMBERED_WORDS:
                self.words[word] = known
        return known

    def score(self, text: str) -> float:
        words = WORD.findall(text.casefold())
        distinct = set(words)
        found = {f for f in shape_features(text, words, distinct) if f in self.weights}
        for word in distinct:
            if known := self._known(word):
                found.update(known)
        return float(sum(self.weights[f] for f in sorted(found)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _numbers(ids: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Places in the ascending ``ids`` of those features of a document that are among them."""
    place = np.minimum(np.searchsorted(ids, document), len(ids) - 1)
    return place[ids[place] == document]


# How much a step may raise the loss; momentum raises it a little at times.
TOLERANCE = 1e-3


def fit(documents: list[np.ndarray], grades: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> OrdinalModel:
    """Proximal gradient with momentum on the mean negative log likelihood plus ``penalty`` times the L1 norm.

    Weights and thresholds move together; a step that makes the loss worse is taken back and halved, and the best point
    met is returned.
    """
    counts = np.bincount(grades, minlength=GRADES)[:GRADES] + np.array(PRIOR)
    below = np.cumsum(counts)[:-1] / counts.sum()
    thresholds = np.log(below / (1 - below))
    if not len(documents):
        return OrdinalModel({}, tuple(thresholds.tolist()))
    ids, seen = np.unique(np.concatenate(documents), return_counts=True)
    kept = (seen >= LEAST_DOCS) & (seen <= MOST_SHARE * len(documents))
    ids, seen = ids[kept], seen[kept]
    if not len(ids):
        return OrdinalModel({}, tuple(thresholds.tolist()))
    # Numbered document by document: an inverse of all entries at once takes several times their memory on the driver.
    numbered = [_numbers(ids, d) for d in documents]
    rows, column = np.repeat(np.arange(len(documents)), [len(d) for d in numbered]), np.concatenate(numbered)
    del numbered
    # Rare features get larger steps; the curvature of a feature grows with its number of documents.
    width = np.bincount(rows, minlength=len(documents)).max()
    rate = 4.0 * len(documents) / np.sqrt(seen * float(seen.max())) / max(1.0, np.sqrt(width))
    n = len(documents)
    at = np.arange(n)
    ahead, ahead_edges, momentum, size = np.zeros(len(ids)), thresholds, 1.0, 1.0
    best, best_edges = ahead, ahead_edges
    weights, edges, least = ahead, ahead_edges, np.inf
    for _ in range(steps):
        scores = np.bincount(rows, weights=ahead[column], minlength=n)
        upto = np.concatenate([np.zeros((n, 1)), _logistic(ahead_edges[None, :] - scores[:, None]), np.ones((n, 1))], axis=1)
        slope = upto * (1 - upto)
        chance = np.maximum(upto[at, grades + 1] - upto[at, grades], 1e-12)
        loss = -np.log(chance).mean() + penalty * np.abs(ahead).sum()
        if loss > least + TOLERANCE:
            # Too far: go on from the best point with half the step and no momentum.
            ahead, ahead_edges, momentum, size = best, best_edges, 1.0, size / 2
            weights, edges, least = ahead, ahead_edges, np.inf
            continue
        if loss < least:
            best, best_edges, least = ahead, ahead_edges, loss
        by_score = (slope[at, grades + 1] - slope[at, grades]) / chance / n
        gradient = np.bincount(column, weights=by_score[rows], minlength=len(ids))
        moved = ahead - size * rate * gradient
        following = np.sign(moved) * np.maximum(np.abs(moved) - size * rate * penalty, 0)
        pull = [np.sum(slope[:, k + 1] * ((grades == k) - 1.0 * (grades == k + 1)) / chance) / n for k in range(GRADES - 1)]
        following_edges = np.sort(ahead_edges + size * np.array(pull))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        if np.dot(ahead - following, following - weights) > 0:
            faster, momentum = 1.0, 1.0
        share = (momentum - 1) / faster
        ahead, weights = following + share * (following - weights), following
        ahead_edges, edges = np.sort(following_edges + share * (following_edges - edges)), following_edges
        momentum = faster
    weights, thresholds = best, best_edges
    used = np.flatnonzero(weights)
    return OrdinalModel(dict(zip(ids[used].tolist(), weights[used].tolist(), strict=True)), tuple(thresholds.tolist()))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(grade, features) of at most ``most`` labelled documents, drawn by a hash of their id.

    Labels that repeat an id count once, with the worst grade; of documents that repeat it the greatest text is taken.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    drawn = (
        labels.filter("doc_id is not null and quality is not null and toxic is not null")
        .select(F.col("doc_id").cast("bigint").alias("id"), grade.alias("grade"))
        .groupBy("id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(most)
    )
    schema = pa.schema([("grade", pa.int32()), ("features", pa.list_(pa.int64()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(text)) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    # The drawn ids are bounded by ``most``.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), whole_text().alias("text"))
    joined = texts.join(F.broadcast(drawn), "id").groupBy("id", "grade").agg(F.max("text").alias("text")).select("grade", "text")
    return joined.mapInArrow(extract, "grade int, features array<bigint>")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on the bounded sample, which is brought to the driver as feature numbers."""
    rows = training_rows(docs, labels, most).toArrow()
    # Chunk by chunk: the features are views of what arrived, not copies of it.
    documents = [values.values.to_numpy() for chunk in rows.column("features").chunks for values in chunk]
    grades = rows.column("grade").to_numpy().astype(np.int64)
    order = np.lexsort(([int(d.sum()) for d in documents], grades)) if documents else []
    return fit([documents[i] for i in order], grades[order] if documents else grades)


def grade_columns(docs: DataFrame, model: OrdinalModel, text: Column) -> Column:
    """expected_grade, p_at_least_1 and p_at_least_2 of a text, as a struct."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            tails = shared.value.tails(np.array([scorer.score(t) for t in texts], float))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_at_least_1": tails[:, 0], "p_at_least_2": tails[:, 1]})

    names = ("expected_grade", "p_at_least_1", "p_at_least_2")
    schema = StructType([StructField(name, DoubleType()) for name in names])
    return F.pandas_udf(score, schema)(text)


def grade_documents(docs: DataFrame, model: OrdinalModel, select: float = SELECT) -> DataFrame:
    """Per row: doc_id, expected grade, tail probabilities and whether it is selected."""
    graded = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), grade_columns(docs, model, whole_text()).alias("g"))
    return graded.select("doc_id", "g.*", (F.col("g.p_at_least_2") >= select).alias("selected"))


def select_good(docs: DataFrame, model: OrdinalModel, select: float = SELECT) -> DataFrame:
    """The selected rows, all columns; rows are judged where they lie."""
    return docs.filter(grade_columns(docs, model, whole_text())["p_at_least_2"] >= select)
