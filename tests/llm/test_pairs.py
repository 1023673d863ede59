"""Decontamination, near duplicates and sketches against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwright.llm import decontaminate, simhash_trie, sketch
from tillwright.llm.components import component_roots


def brute_tiles(doc: list, item: list, width: int) -> int:
    """Matched words by marking the longest match of unmarked words again and again."""
    free_doc, free_item, total = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while (d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k]
                       and free_doc[d + k] and free_item[i + k]):
                    k += 1
                best = max(best, (k, -d, -i))
        if best[0] < width:
            return total
        k, d, i = best[0], -best[1], -best[2]
        free_doc[d : d + k] = [False] * k
        free_item[i : i + k] = [False] * k
        total += k


@settings(max_examples=150, deadline=None)
@given(doc=st.lists(st.sampled_from("abc"), max_size=24), item=st.lists(st.sampled_from("abc"), min_size=1, max_size=14))
def test_tiles_follow_the_definition(doc, item):
    block = decontaminate.Benchmark([(1, " ".join(item))], min_match=3)
    found = [r[2] for r in block.coverage(" ".join(doc))]
    width = min(3, len(item))
    want = brute_tiles(doc, item, width)
    # Among matches of equal length the choice is free, so only the first one is bound to agree.
    assert bool(found) == (want > 0)
    if found:
        assert found[0] >= width and found[0] <= len(item)
        longest = max(k for k in range(len(item) + 1) if any(
            item[i : i + k] == doc[d : d + k] for i in range(len(item) - k + 1) for d in range(len(doc) - k + 1)))
        assert found[0] >= longest


def test_reordered_passages_are_caught(spark, documents, no_documents):
    passage = [f"t{i}" for i in range(40)]
    moved = " ".join(passage[20:] + ["other", "words"] + passage[:20])
    rows = [(1, f"Before. {' '.join(passage).upper()}, after"), (2, moved), (3, " ".join(passage[:25])), (4, None),
            (5, "x " * 50), (None, " ".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit(9))
    items = spark.createDataFrame([(7, " ".join(passage)), (8, None), (9, "!!"), (None, "q1 q2 q3")], "item_id bigint, text string")
    found = decontaminate.contaminated_pairs(docs, items, block_words=20).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "None"] and {r["item_id"] for r in found} == {7}
    kept = decontaminate.drop_contaminated(docs, items, block_words=20)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5] and kept.columns == docs.columns
    assert decontaminate.contaminated_pairs(no_documents, items).count() == 0
    assert decontaminate.contaminated_pairs(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(documents, items.limit(0)).count() == documents.count()


def brute_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(text=st.text(st.sampled_from("aBé \t\x0b \n"), max_size=40))
def test_fingerprint(text):
    assert simhash_trie.fingerprint(text) == brute_fingerprint(text)


def components(values: list[int]) -> dict[int, int]:
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


@pytest.mark.parametrize("crowded", [10_000, 20])
def test_trie_links_connect_what_brute_force_connects(spark, crowded):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre, 0, 1, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(60)}
    values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 4, 5]))) for _ in range(150)}
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "bits bigint")
    links = simhash_trie.trie_links(nodes, subtree=16, crowded=crowded, least_depth=3)
    pairs = [tuple(int(x) for x in np.array([r["a"], r["b"]], np.int64).view(np.uint64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        root[find(a)] = find(b)
    want = components(values)
    groups: dict = {}
    assert all(groups.setdefault(want[v], find(v)) == find(v) for v in values) and len(set(groups.values())) == len(groups)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (52, 51), (60, 60), (None, 3), (41, 40), (100, 99)]
    roots = component_roots(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in roots} == {**{i: 1 for i in range(2, 42)}, 51: 50, 52: 50, 100: 99}
    assert component_roots(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates(spark, documents, no_documents):
    rows = simhash_trie.near_duplicates(documents).collect()
    assert len(rows) == documents.count()
    prints = [(r["doc_id"], brute_fingerprint(r["text"] or "")) for r in documents.collect()]
    root = components(sorted({p for _, p in prints}))
    least: dict = {}
    for doc_id, p in prints:
        if doc_id is not None:
            least[root[p]] = min(least.get(root[p], doc_id), doc_id)
    want = sorted((str(d), f"{p:016x}", least.get(root[p])) for d, p in prints)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in rows) == want
    kept = simhash_trie.keep_one_per_group(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(least.values()))
    assert simhash_trie.near_duplicates(no_documents).count() == 0
    assert simhash_trie.keep_one_per_group(no_documents).count() == 0


def paragraphs(text: str) -> set[str]:
    return {p for p in re.split(sketch.PARAGRAPH_END, text) if p.strip(" ")}


def brute_edits(rows: list[tuple]) -> list[tuple]:
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = []
    for at, (doc_id, text) in enumerate(ordered):
        following, half = ordered[(at + 1) % len(ordered)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, third = paragraphs(text), paragraphs(edited), paragraphs(following)
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        found.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(),
                      round(alike(own, other), 9), round(alike(own, third), 9)))
    return sorted(found)


@pytest.mark.parametrize("slice_docs", [2_000, 3])
def test_sketches(spark, documents, monkeypatch, slice_docs):
    monkeypatch.setattr(sketch, "SLICE_DOCS", slice_docs)
    rows = sketch.fingerprint_edits(documents).collect()
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))
                 for r in rows)
    assert got == brute_edits([(r["doc_id"], r["text"] or "") for r in documents.collect()])
    prints = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(prints) == 1 and "" not in prints


def test_sketches_of_few_rows(spark, no_documents):
    assert sketch.fingerprint_edits(no_documents).count() == 0
    one = spark.createDataFrame([(None, "One.\nTwo.")], "doc_id bigint, text string")
    row = sketch.fingerprint_edits(one).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == 9


def test_failed_peeling_is_retried(spark):
    """Far more digests than the base sketch holds, and more than the retries were made for."""
    rng = random.Random(1)
    keys = [rng.getrandbits(62) for _ in range(900)]
    rows = [(0, keys[:500], keys[200:]), (1, keys, []), (2, [], []), (3, keys[:3], keys[:3]), (4, keys[:40], keys[5:60])]
    pairs = spark.createDataFrame(rows, "pid bigint, plus array<bigint>, minus array<bigint>")
    got = {r["pid"]: r["likeness"] for r in sketch.likeness(pairs, 2_000).collect()}
    assert got == pytest.approx({0: 300 / 900, 1: 0.0, 2: 1.0, 3: 1.0, 4: 35 / 60})
