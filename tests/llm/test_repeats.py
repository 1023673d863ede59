"""Periodic runs, repeated passages and centroid clusters against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwright.llm import centroids, queries, runs, substrings
from tillwright.llm.fm_index import FmIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lyndon(values: list[int]) -> list[int]:
    """Longest Lyndon word at each position: less than all its proper suffixes."""
    longest = lambda i: max(j - i for j in range(i + 1, len(values) + 1)
                            if all(values[i:j] < values[k:j] for k in range(i + 1, j)))
    return [longest(i) for i in range(len(values))]


def brute_runs(values: list) -> list[tuple[int, int, int]]:
    """Maximal stretches of each period, if no smaller period holds."""
    found = []
    for q in range(1, len(values) // 4 + 1):
        at = 0
        while at + q < len(values):
            end = at
            while end + q < len(values) and values[end] == values[end + q]:
                end += 1
            size = end - at + q
            smaller = (r for r in range(1, q) if values[at : at + size - r] == values[at + r : at + size])
            if size >= max(6, 4 * q) and not any(True for _ in smaller):
                found.append((at, size, q))
            at = end + 1
    return sorted(found)


def brute_collapsed(words: list) -> tuple[list, list]:
    found = brute_runs(words)
    dropped = {i for start, size, q in found for i in range(start + q, start + size)}
    return found, [w for i, w in enumerate(words) if i not in dropped]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=16))
def test_lyndon_arrays_of_phase_one(values):
    ranks = {v: i for i, v in enumerate(sorted(set(values)))}
    values = [ranks[v] for v in values]
    assert runs.lyndon_groups(values)[0] == brute_lyndon(values)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), max_size=6))
def test_runs_follow_the_definition(parts):
    values = [v for unit, times in parts for v in unit * times]
    assert runs.find_runs(np.array(values, np.int64)) == brute_runs(values)


def test_runs_of_a_very_long_text():
    unit = list(range(1_000))
    values = np.array(unit * 60 + [-1] + [7] * 50_000, np.int64)
    assert runs.find_runs(values) == [(0, 60_000, 1_000), (60_001, 50_000, 1)]


def planted(doc_id, text) -> list[str]:
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected_runs(doc_id, text) -> tuple:
    found, kept = brute_collapsed(planted(doc_id, text))
    longest = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (
        doc_id, len(found), *longest, longest[1] and 1000 * longest[1] // longest[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest(),
    )


def bounded(rows, words: int = 500) -> list:
    """Rows that brute force can take."""
    return [r for r in rows if len(WORD.findall(r["text"] or "")) <= words]


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_word_runs_query(spark, folder):
    got = {r["doc_id"]: tuple(r[c] for c in RUN_COLUMNS) for r in queries.op12_word_runs(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    wanted = [expected_runs(r["doc_id"], r["text"]) for r in bounded(rows)]
    assert [got[w[0]] for w in wanted] == wanted
    assert sum(w[1] > 0 for w in wanted) > 10


def test_word_runs_of_odd_documents(spark, documents, no_documents, tmp_path):
    rng = random.Random(2)
    rows = [(100 + i, " ".join(rng.choice("ab") * rng.choice([1, 5]) for _ in range(40)), None, "b", 1) for i in range(80)]
    rows += [(200, "no   break " * 8, "en", "b", 1), (201, "x " * 5, "en", "b", 1), (202, "x " * 6, "en", "b", 1)]
    more = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in RUN_COLUMNS) for r in queries.op12_word_runs(spark, str(tmp_path)).collect()]
    source = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted((expected_runs(r["doc_id"], r["text"]) for r in bounded(source, 10**6)), key=key)
    assert runs.collapse_runs(no_documents).count() == 0
    spans = runs.collapse_runs(more).filter("doc_id = 202").select(F.explode("runs").alias("r"), "text").first()
    assert tuple(spans["r"]) == (0, 6, 1) and spans["text"] == "x"


def brute_statistics(sequences: list, weights: list, query: list, depth: int) -> list[int]:
    """Longest pattern at each position that stands at least twice in the sequences, by trying all."""
    def heavy(pattern: list) -> bool:
        return sum(w for s, w in zip(sequences, weights, strict=True) for j in range(len(s) - len(pattern) + 1)
                   if s[j : j + len(pattern)] == pattern) >= 2
    return [max(n for n in range(min(depth, len(query) - i) + 1) if not n or heavy(query[i : i + n])) for i in range(len(query))]


symbols = st.lists(st.integers(1, 4), max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(symbols, st.sampled_from([1, 1, 2])), max_size=5), st.lists(st.integers(-1, 6), max_size=9), st.integers(1, 6))
def test_matching_statistics(shard, query, depth):
    sequences, weights = [s for s, _ in shard], [w for _, w in shard]
    index = FmIndex([np.array(s, np.int64) for s in sequences], np.array(weights, np.int64), depth)
    streamed = [*sequences, query]
    got = index.matching_statistics([np.array(s, np.int64) for s in streamed])
    assert [g.tolist() for g in got] == [brute_statistics(sequences, weights, s, depth) for s in streamed]


def brute_repeats(texts: list, window: int) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, digest of the rest) of each text, windows counted in a dictionary."""
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    found = []
    for words in split:
        gone = {j for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] > 1 for j in range(i, i + window)}
        rest = " ".join(w for j, w in enumerate(words) if j not in gone)
        found.append((len(words), len(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return found


@pytest.mark.parametrize("common_texts, shard_words", [(4, 1 << 19), (2, 200)])
def test_repeats_of_a_shared_passage(spark, monkeypatch, common_texts, shard_words):
    """A passage in most texts at all offsets, copies, repeats within one text, near the window's size, many shards."""
    monkeypatch.setattr(substrings, "COMMON_TEXTS", common_texts)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard_words)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(90)]
    texts = []
    for i in range(60):
        cut = passage[rng.randrange(40) :][: rng.randrange(33, 60)]
        texts.append(" ".join([word() for _ in range(rng.randrange(30))] + cut + [word() for _ in range(rng.randrange(30))]))
    texts += [texts[0], texts[0].replace(" ", "\n\t"), "same " * 34, "word " * 35, "again " * 36, "ab " * 400, None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    own = substrings.with_repeats(docs, substrings.repeats_of_texts(docs)).collect()
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), hashlib.sha256(r["kept"].encode()).hexdigest()) for r in own}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 35)
    assert sum(v[1] > 0 for v in got.values()) > 50


def test_repeats_query(spark, documents, no_documents, folder, tmp_path):
    documents.write.parquet(f"{tmp_path}/a/documents.parquet")
    no_documents.write.parquet(f"{tmp_path}/b/documents.parquet")
    for at in (folder, f"{tmp_path}/a", f"{tmp_path}/b"):
        rows = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
        want = [(r["doc_id"], *w) for r, w in zip(rows, brute_repeats([r["text"] for r in rows], 35), strict=True)]
        got = [tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in queries.op11_fm_repeats(spark, at).collect()]
        key = lambda r: (r[0] is None, r)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_leader_windows_are_bounded():
    with pytest.raises(ValueError):
        substrings.Blocks(np.zeros(0, np.uint64), window=60, gram=8)


def brute_clusters(vectors: list, start: list, rounds: int) -> tuple[list, list]:
    """Full scans and exact floors."""
    centroids = [list(c) for c in start]
    for now in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for v in vectors]
        if now < rounds:
            for j in range(len(centroids)):
                mine = [v for v, (_, c) in zip(vectors, own, strict=True) if c == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(j, d) for d, j in own], centroids


@pytest.mark.parametrize("spread", [3, 100, 1 << 27])
def test_clusters_are_those_of_full_scans(spark, spread):
    """Few values (ties and empty centroids), groups, and components at the bound."""
    rng = random.Random(spread)
    middle = [[rng.randrange(-spread, spread + 1) for _ in range(5)] for _ in range(6)]
    vectors = [[max(-spread, min(spread, x + rng.randrange(-spread // 9, spread // 9 + 1))) for x in rng.choice(middle)] for _ in range(150)]
    points = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, v array<int>")
    start = vectors[:7] + [vectors[0], [spread] * 5]
    found = centroids.cluster_vectors(points, start, 4)
    own, last = brute_clusters(vectors, start, 4)
    assert found.centroids == last
    assert sorted(tuple(r) for r in found.assigned.collect()) == [(i, *o) for i, o in enumerate(own)]


def test_bounds_spare_distances():
    """Later rounds evaluate few distances, and a bound uses the total displacement: a centroid that came back costs nothing."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-4_000, 4_000, (10, 16))
    vectors = middle[rng.integers(0, 10, 500)] + rng.integers(-40, 40, (500, 16))
    first = middle + 5
    away = first.copy()
    away[:5] += 900
    state = [np.full(500, -1, np.int32), np.zeros(500, np.int64), np.zeros(500, np.int8), np.zeros((500, 10)), np.zeros((500, 10), np.int8)]
    assert centroids.assign(vectors, np.stack([first]), *state)[2] == 5_000
    kept = [x.copy() for x in state]
    assert centroids.assign(vectors, np.stack([first, away, first]), *kept)[2] == 0
    assert centroids.assign(vectors, np.stack([first, away]), *state)[2] < 2_500


def test_cluster_query_of_odd_vectors(spark, tmp_path):
    good = [[((i * 7 + j * 3) % 11 - 5) / 9 for j in range(64)] for i in range(60)]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [
        (3, good[3], 1), (None, good[5], 2), (70, None, 1), (71, good[0][:63], 1), (72, good[0] + [1.0], 1), (73, [None, *good[0][1:]], 1),
        (74, [float("nan"), *good[0][1:]], 1), (75, [float("-inf"), *good[0][1:]], 1), (76, [], 1), (77, [1e30, *good[0][1:]], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({n: F.lit(1) for n in ("cluster", "v", "distance")})
    frame.write.parquet(f"{tmp_path}/a/embeddings.parquet")
    frame.limit(0).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    got = queries.op13_ns_clusters(spark, f"{tmp_path}/a").collect()
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in v]) for i, v, _ in rows
            if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    draw = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    own, last = brute_clusters([v for _, v in kept], [v for _, v in sorted(kept, key=draw)[:40]], 5)
    total = Counter()
    for j, d in own:
        total[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last]
    want = [(i, j, d, total[j], sum(total.values()), names[j]) for (i, _), (j, d) in zip(kept, own, strict=True)]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert queries.op13_ns_clusters(spark, f"{tmp_path}/b").count() == 0


@pytest.mark.parametrize("name, names", [("op11_fm_repeats", ["documents"]), ("op13_ns_clusters", ["embeddings"])])
def test_matches_sql(spark, folder, name, names):
    duck = duckdb.connect()
    for each in names:
        duck.execute(f"CREATE VIEW {each} AS SELECT * FROM read_parquet('{folder}/{each}.parquet')")
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(cursor.fetchall())
