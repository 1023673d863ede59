"""Classifiers on held-out rows, their edge cases, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import math
import sys
import unicodedata
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwright.llm import decontaminate, language, packing, quality, simhash_trie
from tillwright.llm.common import table
from tillwright.llm.queries import QUERIES


def test_codewords_are_far_apart():
    for languages in (2, 3, 4, 6, 7, 20):
        code = language.codewords(languages).astype(int)
        assert len({tuple(row) for row in code}) == languages
        least = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert least >= (1 if languages == 2 else 2)
        assert all(abs(column.sum()) < languages for column in code.T)


@pytest.fixture(scope="module")
def larger(spark):
    return "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark, larger):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, larger, "documents").collect()}
    rows = QUERIES["op10_code_languages"](spark, larger).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_edge_cases(spark, documents, no_documents):
    model = language.train(documents)
    rows = {r["doc_id"]: r for r in language.predict_language(documents, model).collect()}
    for doc_id in (3, 4, 5, 12):
        assert rows[doc_id]["lang_pred"] == language.UNKNOWN and rows[doc_id]["score"] == 0
    assert rows[6]["lang_pred"] == "en" and rows[None]["held_out"] is False
    kept = language.keep_known(documents, model)
    assert kept.columns == documents.columns and not {3, 4, 5, 12} & {r["doc_id"] for r in kept.collect()}
    untrained = language.train(no_documents)
    assert {r["lang_pred"] for r in language.predict_language(documents, untrained).collect()} == {language.UNKNOWN}
    assert language.predict_language(no_documents, model).count() == 0


def test_predictions_use_the_text_alone(spark, larger):
    docs = table(spark, larger, "documents").limit(200)
    model = language.train(docs)
    blind = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("x"))
    see = lambda d: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict_language(d, model).collect())
    assert see(docs) == see(blind)


def test_quality_on_unseen_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    seen, unseen = labels.filter("doc_id % 5 <> 0"), labels.filter("doc_id % 5 = 0")
    model = quality.train(docs, seen, most=2_500)
    graded = quality.grade_documents(docs.join(unseen.select("doc_id"), "doc_id", "left_semi"), model)
    rows = graded.join(unseen, "doc_id").collect()
    share = lambda pick: np.mean([r["selected"] for r in rows if pick(r)])
    assert share(lambda r: r["quality"] == 1 and not r["toxic"]) > 0.95
    assert share(lambda r: r["toxic"] == 1) < 0.1 and share(lambda r: r["quality"] == 0) < 0.15
    assert all(r["p_at_least_1"] >= r["p_at_least_2"] >= 0 for r in rows)
    assert all(r["expected_grade"] == pytest.approx(r["p_at_least_1"] + r["p_at_least_2"]) for r in rows)


def test_quality_edge_cases(spark, documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 1), (8, None, 0), (9, 1, 1), (9, 1, 1)],
                                   "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
    model = quality.train(documents, labels)
    rows = quality.grade_documents(documents, model).collect()
    assert len(rows) == documents.count() and list(model.thresholds) == sorted(model.thresholds)
    nothing = quality.train(documents, labels.limit(0))
    assert quality.select_good(documents, nothing).count() == documents.count()
    assert quality.select_good(documents, nothing).columns == documents.columns
    assert quality.grade_documents(no_documents, model).count() == 0


def test_samples_stay_bounded_when_ids_repeat(spark):
    ids = [n for n in range(60) if zlib.crc32(str(n).encode()) % 4 != 2]
    rows = [(n, f"text number {n} and copy {k}", "en") for n in ids for k in range(6 if n == ids[0] else 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for most, want in ((10, 10), (1_000, len(ids))):
        assert language.training_profiles(docs, most).count() == want
    labels = spark.createDataFrame([(n, 1, 0) for n in ids for _ in range(4)] + [(ids[0], 0, 0)], "doc_id bigint, quality int, toxic int")
    for most, want in ((10, 10), (1_000, len(ids))):
        assert quality.training_rows(docs, labels, most).count() == want


def test_fit_recovers_an_ordered_signal():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 600)
    documents = [np.array(sorted({10 + int(g), *(100 + rng.integers(0, 30, 5)).tolist()})) for g in grades]
    model = quality.fit(documents, grades)
    scores = np.array([sum(model.weights.get(int(f), 0.0) for f in d) for d in documents])
    tails = model.tails(scores)
    assert np.mean((tails > 0.5).sum(axis=1) == grades) > 0.97


def test_only_letters_are_letters(spark):
    for code in range(0, sys.maxunicode + 1, 1):
        if not 0xD800 <= code < 0xE000:
            assert bool(language.letters_of(chr(code))) == unicodedata.category(chr(code)).startswith("L"), hex(code)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["²", "½ Ⅷ ①", "#### ###", "１２", "a plain text"])], "doc_id bigint, text string, lang string")
    rows = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(docs, language.train(docs)).collect()}
    assert [rows[i] for i in range(5)] == [language.UNKNOWN] * 4 + ["en"]


def test_decoding_is_that_of_a_loop_over_bits_and_languages():
    rng = np.random.default_rng(5)
    for languages in (2, 3, 5, 9):
        code = language.codewords(languages)
        names = tuple(f"l{i}" for i in range(languages))
        model = language.CodeModel(names, code, rng.normal(size=(language.BUCKETS, code.shape[1])).astype(np.float32), rng.normal(size=code.shape[1]).astype(np.float32))
        profiles = np.stack([language.ngram_profile(f" text number {i} of some ".encode()) for i in range(12)])
        best, score, lead = model.decode(profiles)
        for i, profile in enumerate(profiles):
            losses = []
            for j in range(languages):
                margins = [float(profile @ model.weights[:, b]) + float(model.bias[b]) for b in range(code.shape[1])]
                losses.append(sum(math.log1p(math.exp(-int(code[j, b]) * margins[b])) for b in range(code.shape[1])))
            first, second = sorted(losses)[:2]
            assert losses[best[i]] == pytest.approx(first, rel=1e-4)
            assert score[i] == pytest.approx(1 / sum(math.exp(first - x) for x in losses), rel=1e-3)
            assert lead[i] == pytest.approx((second - first) / code.shape[1], rel=1e-2, abs=1e-4)


def plain_loss(documents: list, grades: list, weights: dict, thresholds: list) -> float:
    """Mean negative log likelihood of the cumulative logit and the penalty, by loops."""
    edges, total = [-math.inf, *thresholds, math.inf], 0.0
    logistic = lambda x: 0.0 if x == -math.inf else 1.0 if x == math.inf else 1 / (1 + math.exp(-x))
    for d, g in zip(documents, grades, strict=True):
        score = sum(weights.get(int(f), 0.0) for f in d)
        total -= math.log(max(1e-12, logistic(edges[g + 1] - score) - logistic(edges[g] - score)))
    return total / len(documents) + quality.PENALTY * sum(abs(w) for w in weights.values())


def test_fit_is_near_the_minimum_of_the_plain_loss():
    """A search along single weights and thresholds, each by trial, finds nothing that is much better."""
    rng = np.random.default_rng(8)
    grades = rng.integers(0, 3, 200)
    documents = [np.array(sorted({int(10 + max(0, min(2, g + rng.integers(-1, 2)))), *(100 + rng.integers(0, 9, 3)).tolist()})) for g in grades]
    model = quality.fit(documents, grades)
    fitted = plain_loss(documents, grades, model.weights, list(model.thresholds))
    best, weights, thresholds = fitted, dict(model.weights), list(model.thresholds)
    seen = Counter(int(f) for d in documents for f in d)
    usable = sorted(f for f, n in seen.items() if quality.LEAST_DOCS <= n <= quality.MOST_SHARE * len(documents))
    for step in (0.2, 0.05):
        for _ in range(6):
            for f in usable:
                for moved in (weights.get(f, 0.0) - step, weights.get(f, 0.0) + step):
                    if (loss := plain_loss(documents, grades, {**weights, f: moved}, thresholds)) < best:
                        best, weights = loss, {**weights, f: moved}
            for k in range(2):
                for moved in (thresholds[k] - step, thresholds[k] + step):
                    trial = [moved if i == k else t for i, t in enumerate(thresholds)]
                    if (loss := plain_loss(documents, grades, weights, trial)) < best:
                        best, thresholds = loss, trial
    assert fitted - best < 0.005 < plain_loss(documents, grades, {}, list(model.thresholds)) - best


def test_scores_are_plain_sums_over_features(documents):
    texts = [r["text"] or "" for r in documents.collect()]
    every = sorted({f for t in texts for f in quality.features(t)})
    model = quality.OrdinalModel({f: math.sin(i) for i, f in enumerate(every) if i % 3}, (-1.0, 1.0))
    scorer = quality.Scorer(model)
    for text in texts * 2:
        score = sum(model.weights.get(f, 0.0) for f in quality.features(text))
        assert scorer.score(text) == pytest.approx(score, abs=1e-9)
        tails = model.tails(np.array([score]))[0]
        assert tails.tolist() == pytest.approx([1 / (1 + math.exp(t - score)) for t in model.thresholds])


def test_pipeline_against_plain_stages(spark, folder):
    """Each stage on its own input: the rows it keeps are those a plain loop keeps."""
    docs = table(spark, folder, "documents")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        columns, docs = docs.columns, stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert name == "packing" or docs.columns == columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    everything = spark.createDataFrame(inputs[names[0]], table(spark, folder, "documents").schema)
    model = quality.train(everything, table(spark, folder, "labels"))
    scorer = quality.Scorer(model)
    good = [r for r in inputs[names[0]] if model.tails(np.array([scorer.score(r["text"])]))[0, 1] >= quality.SELECT]
    assert ids(inputs[names[1]]) == ids(good)

    known = language.train(spark.createDataFrame(good, everything.schema))
    clear = []
    for r in good:
        best, _, lead = known.decode(np.stack([language.ngram_profile(language.letters_of(r["text"]))]))
        clear += [r] if lead[0] >= language.AMBIGUOUS else []
    assert ids(inputs[names[2]]) == ids(clear)

    prints = {r["doc_id"]: simhash_trie.fingerprint(r["text"]) for r in clear}
    groups = {d: d for d in prints}
    for _ in groups:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    groups[a] = groups[b] = min(groups[a], groups[b])
        break
    assert ids(inputs[names[3]]) == sorted({groups[d] for d in groups if groups[groups[d]] == groups[d]})

    block = decontaminate.Benchmark([tuple(r) for r in table(spark, folder, "benchmark").collect()])
    clean = [r for r in inputs[names[3]] if all(m / n < decontaminate.COVERAGE for _, _, m, n in block.coverage(r["text"]))]
    assert ids(inputs[names[4]]) == ids(clean)

    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted({r["doc_id"] for r in packed}) == ids(clean)
    assert all(r["offset"] + r["length"] <= packing.SEQUENCE_TOKENS for r in packed)


def test_pipeline_on_odd_tables(spark, documents, no_documents, folder):
    for start in (documents, no_documents):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert (docs.count() > 0) == (start is documents)


def test_fit_holds_few_times_its_entries():
    """The fit runs on the driver, so its peak is bounded per feature entry (8 bytes each as given)."""
    import tracemalloc

    draw = np.random.default_rng(1)
    documents = [np.unique(draw.integers(0, 30_000, 600)) for _ in range(600)]
    grades = draw.integers(0, 3, 600)
    tracemalloc.start()
    quality.fit(documents, grades, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 52 * sum(map(len, documents))
