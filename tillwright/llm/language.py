"""Language identification by error-correcting output codes (Dietterich and Bakiri, 1995).

Every language gets a codeword; one logistic classifier per bit separates the languages with a 1 from those with a 0,
on hashed byte n-grams of the whole text. Decoding weighs each bit by its logistic loss and takes the language with
the smallest total (Allwein, Schapire and Singer, 2000). The score is the share of that language when losses are read
as log likelihoods; a small lead over the second marks the text as ambiguous.

The classifiers are fitted on at most ``TRAIN_PER_LANGUAGE`` documents of each language, drawn by a hash of the id
from documents with a language whose crc32(id) mod 4 is not 2; those others are held out. Only the text is an input of
a prediction. Null texts and texts without a letter are ``und`` with score 0, as is every text when nothing was
learned. Rows with null ids are predicted and neither held out nor learned from. An empty table gives no rows. Other
columns are ignored (``keep_known`` returns them).

Very long texts are profiled whole, in pieces of bounded size. Languages with equal loss go to the first by name.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

UNKNOWN = "und"
BUCKETS = 4_096
TRAIN_PER_LANGUAGE = 800
# Lead of the best language over the second, in mean loss per bit, below which a text counts as ambiguous.
AMBIGUOUS = 0.02
# Above this many languages the code is drawn instead of listing every split of them.
ALL_SPLITS = 6
PENALTY, STEPS = 1e-3, 60
BYTES_AT_ONCE = 1 << 20
# Lower case makes letters equal; runs of anything else become one blank.
NO_LETTERS = re.compile(r"[\W\d_]+")
# Numbers that are no decimal digits (fractions, superscripts, Roman and circled numerals): word characters for the
# pattern above, but no letters. Looked up per text, as a pattern that lists them takes ten times as long.
NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


def letters_of(text: str) -> bytes:
    """Words of letters between single blanks, in lower case; empty if there is no letter."""
    words = NO_LETTERS.sub(" ", text.lower()).strip()
    if not words.isascii() and (found := NUMERALS.intersection(words)):
        words = " ".join(words.translate(dict.fromkeys(map(ord, found), " ")).split())
    return f" {words} ".encode("utf-8", "replace") if words else b""


def ngram_profile(letters: bytes) -> np.ndarray:
    """Root of the counts of hashed 2- to 4-grams of bytes, scaled to length 1."""
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(letters, np.uint8)
    for at in range(0, len(raw), BYTES_AT_ONCE):
        values = raw[max(0, at - 3) : at + BYTES_AT_ONCE].astype(np.uint32)
        rolled = values[:-1] * np.uint32(0x01000193) ^ values[1:]
        counts += np.bincount((rolled * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=BUCKETS)
        for width in (2, 3):
            rolled = rolled[:-1] * np.uint32(0x01000193) ^ values[width:]
            counts += np.bincount((rolled * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=BUCKETS)
    profile = np.sqrt(counts).astype(np.float32)
    return profile / max(1e-9, float(np.linalg.norm(profile)))


def codewords(languages: int) -> np.ndarray:
    """One row of +1/-1 bits per language: every split into two for a few languages, else the best of drawn codes."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= ALL_SPLITS:
        splits = [[1 if language == 0 or mask >> (language - 1) & 1 else -1 for language in range(languages)]
                  for mask in range((1 << (languages - 1)) - 1)]
        return np.array(splits, np.int8).T
    rng, best, distance = np.random.default_rng(0), None, -1
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        agree = code.astype(np.int64) @ code.T
        least = (code.shape[1] - (agree - np.diag(np.diag(agree)) * 2).max()) // 2
        if least > distance:
            best, distance = code, least
    return best


@dataclass(frozen=True)
class CodeModel:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language number, score and lead (in mean loss per bit) of each profile."""
        margins = profiles @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]).sum(axis=2)
        best = loss.argmin(axis=1)
        likelihood = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        score = 1 / likelihood.sum(axis=1)
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else loss[:, 0] + np.inf
        return best, score, (second - loss.min(axis=1)) / self.code.shape[1]


def fit(profiles: np.ndarray, language: list[str], penalty: float = PENALTY, steps: int = STEPS) -> CodeModel:
    """All bit classifiers at once, by accelerated gradient steps on the penalised logistic loss."""
    names = tuple(sorted(set(language)))
    code = codewords(len(names))
    number = {name: at for at, name in enumerate(names)}
    which = np.array([number[name] for name in language], np.int64)
    signs = code[which].astype(np.float32) if len(which) else np.zeros((0, code.shape[1]), np.float32)
    # Every language weighs the same however often it was drawn.
    share = (1.0 / (np.bincount(which, minlength=max(1, len(names)))[which] * max(1, len(names)))).astype(np.float32)
    weights, bias = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead, ahead_bias, momentum, rate = weights.copy(), bias.copy(), 1.0, 2.0
    for _ in range(steps if len(names) > 1 else 0):
        margins = signs * (profiles @ ahead + ahead_bias)
        pull = -signs * share[:, None] / (1 + np.exp(np.clip(margins, -30, 30)))
        step = ahead - rate * (profiles.T @ pull + penalty * 1e-2 * ahead)
        step_bias = ahead_bias - rate * pull.sum(axis=0)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, weights = step + (momentum - 1) / faster * (step - weights), step
        ahead_bias, bias = step_bias + (momentum - 1) / faster * (step_bias - bias), step_bias
        momentum = faster
    return CodeModel(names, code, weights, bias)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("bigint").cast("string")), F.lit(4)) == 2, F.lit(False))


def training_profiles(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """(lang, profile) of the drawn documents.

    Rows that repeat an id and a language are one draw. Languages are counted first; only ids whose hash falls into the lowest few times ``per_language`` of a language
    are ranked, so that a language with most of the documents doesn't fill one task.
    """
    draw = F.xxhash64(F.lit("language"), "id")
    eligible = (
        docs.filter("doc_id is not null and lang is not null and text is not null")
        .select(F.col("doc_id").cast("bigint").alias("id"), "lang").filter(~is_held_out(F.col("id"))).distinct()
    )
    sizes = eligible.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.shiftrightunsigned(draw, 40) / F.lit(1 << 24)
    low = eligible.join(sizes, "lang").filter(place < F.lit(3.0 * per_language + 100) / F.col("n"))
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(draw, 40), draw, "id")
    drawn = low.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_language).select("id", "lang")
    schema = pa.schema([("lang", pa.string()), ("profile", pa.binary())])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = [letters_of(text) for text in batch.column(1).to_pylist()]
            rows = [(lang, ngram_profile(x).astype(np.float16).tobytes())
                    for lang, x in zip(batch.column(0).to_pylist(), letters, strict=True) if x]
            columns = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], schema=schema)

    texts = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("id"), F.col("lang").alias("own"), "text")
    # At most ``per_language`` ids per language, and of rows that repeat an id and language the one with the greatest text.
    joined = texts.join(F.broadcast(drawn), "id").filter(F.col("own") == F.col("lang"))
    joined = joined.groupBy("id", "lang").agg(F.max("text").alias("text"))
    return joined.select("lang", "text").mapInArrow(profile, "lang string, profile binary")


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> CodeModel:
    rows = sorted((row["lang"], bytes(row["profile"])) for row in training_profiles(docs, per_language).collect())
    profiles = np.frombuffer(b"".join(p for _, p in rows), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return fit(profiles, [lang for lang, _ in rows])


def language_columns(docs: DataFrame, model: CodeModel, text: Column) -> Column:
    """lang_pred, score and ambiguous of a text, as a struct."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            names, scores, unclear = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for start in range(0, len(texts) if known.languages else 0, 512):
                letters = [letters_of(t) if t else b"" for t in texts.iloc[start : start + 512]]
                rows = [at for at, x in enumerate(letters) if x]
                if not rows:
                    continue
                best, score, lead = known.decode(np.stack([ngram_profile(letters[at]) for at in rows]))
                for at, language, certain, ahead in zip(rows, best, score, lead, strict=True):
                    names[start + at], scores[start + at] = known.languages[language], certain
                    unclear[start + at] = ahead < AMBIGUOUS
            yield pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": unclear})

    schema = StructType([
        StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType()),
    ])
    return F.pandas_udf(predict, schema)(text)


def predict_language(docs: DataFrame, model: CodeModel) -> DataFrame:
    """Per row: doc_id, held_out, predicted language, score and whether the decoding was ambiguous."""
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    predicted = chosen.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"),
                              language_columns(docs, model, F.col("text")).alias("p"))
    return predicted.select("doc_id", "held_out", "p.*")


def keep_known(docs: DataFrame, model: CodeModel) -> DataFrame:
    """The rows whose language is recognised, all columns. Texts without letters and ambiguous ones go."""
    found = language_columns(docs, model, F.col("text"))
    return docs.filter((found["lang_pred"] != UNKNOWN) & ~found["ambiguous"])
