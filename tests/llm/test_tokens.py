"""Token ids, wavelet shards, packing and edit-aware counts against encoding whole texts."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillwright.llm import edit_counts, packing, token_shards
from tillwright.llm.piece_tokens import byte_encoder, word_encoder
from tillwright.llm.wavelet import WaveletMatrix, build
from tillwright.plans.staging import shared_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.text(st.one_of(st.sampled_from("aB é.,\n\t'sΣσİß1\0\x85́"), st.characters(codec="utf-8")), max_size=60)


def whole(path: str, text: str) -> np.ndarray:
    return np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4")


@pytest.fixture(scope="module")
def tokenizers():
    return {path: Tokenizer.from_file(path) for path in (WORD, BYTE)}


@settings(max_examples=600, deadline=None)
@given(text=TEXTS)
def test_pieces_give_the_ids_of_the_whole_text(tokenizers, text):
    for path, encoder in ((WORD, word_encoder(WORD)), (BYTE, byte_encoder(BYTE))):
        ids = np.array(tokenizers[path].encode(text, add_special_tokens=False).ids, "<u4")
        assert encoder.encode(text) == ids.tobytes()


def test_every_latin_letter(tokenizers):
    for code in range(0x20, 0x250):
        for text in (chr(code), f"a{chr(code)}.", f" {chr(code)}b,", f"x {chr(code)}{chr(code)}"):
            for path, encoder in ((WORD, word_encoder(WORD)), (BYTE, byte_encoder(BYTE))):
                ids = np.array(tokenizers[path].encode(text, add_special_tokens=False).ids, "<u4")
                assert encoder.encode(text) == ids.tobytes(), (path, text)


def test_marks_after_a_word_are_encoded_once(tokenizers, monkeypatch):
    """Words that end in marks take the ids of the word and of the run of marks; only the run goes through the whole tokenizer."""
    words = ["for&&&", "Ertzßsch.***", "WITH,!!", "anat'", "x_", "it's.", "a.b!!", "...", "éê%%%", "İstan!!"]
    for path, encoder in ((WORD, word_encoder(WORD)), (BYTE, byte_encoder(BYTE))):
        encoder.pieces.clear()
        seen, real = [], encoder.pieces.whole
        monkeypatch.setattr(encoder.pieces, "whole", lambda text, seen=seen, real=real: seen.append(text) or real(text))
        for text in (" ".join(words), "\n".join(words)):
            ids = np.array(tokenizers[path].encode(text, add_special_tokens=False).ids, "<u4")
            assert encoder.encode(text) == ids.tobytes()
        assert {"&&&", ".***", ",!!", "%%%"} <= set(seen)
        assert not [text for text in seen if text.strip().startswith(("for", "Ertz", "WITH", "anat", "x", "é"))]


@settings(max_examples=80, deadline=None)
@given(values=st.lists(st.integers(0, 70_000), max_size=700))
def test_wavelet_matrix(values):
    ids = np.array(values, np.uint32)
    matrix = WaveletMatrix(build(ids), len(ids))
    assert matrix.decode().tolist() == values
    for at in range(0, len(values), 37):
        assert matrix.access(at) == values[at]
    for token in {*values[:5], 1, 99_999}:
        assert matrix.locate(token) == [i for i, v in enumerate(values) if v == token]
        low, high = len(values) // 3, 2 * len(values) // 3
        assert matrix.count(token, low, high) == values[low:high].count(token)


def test_shards_round_trip(spark, documents, no_documents):
    path = shared_path(spark, "test-shards")
    token_shards.write_shards(documents, path, WORD, shard_tokens=5_000)
    shards = token_shards.read_shards(spark, path)
    read = token_shards.with_part_offsets(shards, token_shards.read_tokens(shards), F.col("local_start"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read.collect())
    rows = sorted(((r["doc_id"], r["text"] or "") for r in documents.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start, ones = [], 0, 0
    for doc_id, text in rows:
        ids = np.append(whole(WORD, text), np.uint32(1)).astype("<u4")
        want.append((start, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        ones += int((ids == 1).sum())
    assert got == want
    assert token_shards.token_counts(shards, [1]).first()["n"] == ones
    assert token_shards.occurrences(shards, 1).count() == ones
    empty = shared_path(spark, "test-shards")
    token_shards.write_shards(no_documents, empty, WORD)
    assert token_shards.read_tokens(token_shards.read_shards(spark, empty)).count() == 0


@settings(max_examples=200, deadline=None)
@given(histogram=st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=20))
def test_patterns_place_every_piece_once(histogram):
    patterns = packing.pack_histogram(histogram, 32)
    placed: dict[int, int] = defaultdict(int)
    for count, slots in patterns:
        assert count > 0 and sum(length * times for length, times in slots) <= 32
        for length, times in slots:
            placed[length] += count * times
    assert dict(placed) == histogram


def test_packing(spark, documents, no_documents):
    rows = packing.pack(documents, BYTE, capacity=256).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in documents.collect()), key=str)
    fills: dict[int, list] = defaultdict(list)
    by_doc: dict = defaultdict(list)
    for r in rows:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert sorted(fills) == list(range(len(fills)))
    for slots in fills.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 256
    want: dict = defaultdict(list)
    for doc_id, text in texts:
        ids = np.append(whole(BYTE, text), np.uint32(1)).astype("<u4")
        for start in range(0, len(ids), 256):
            piece = ids[start : start + 256]
            want[doc_id].append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(no_documents, BYTE).count() == 0


@settings(max_examples=150, deadline=None)
@given(
    text=st.text(st.sampled_from("ab  .\n\té's1"), max_size=150), leaf=st.sampled_from([4, 9, 30]),
    edits=st.lists(st.tuples(st.integers(-2, 160), st.integers(-1, 30), st.text(st.sampled_from("ab .\n'"), max_size=9)), max_size=5),
)
def test_edited_counts_equal_a_recount(tokenizers, text, leaf, edits):
    encoder = byte_encoder(BYTE)
    tree = edit_counts.CountTree.of_text(text, encoder, leaf)
    for at, remove, insert in edits:
        start = min(max(at, 0), len(text))
        want = text[:start] + insert + text[start + max(remove, 0) :]
        text, _ = tree.replace(text, at, remove, insert, encoder)
        assert text == want
        assert (tree.n_tokens, tree.n_chars) == (len(tokenizers[BYTE].encode(text, add_special_tokens=False).ids), len(text))


def test_edit_table(spark, documents, no_documents):
    trees = edit_counts.build_trees(documents, BYTE)
    change = F.struct(F.lit(3).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("remove"), F.lit("xyz ").alias("insert"))
    edited = edit_counts.apply_edits(trees.withColumn("edits", F.when(F.col("doc_id") > 2, F.array(change))), BYTE).collect()
    want = []
    for r in documents.collect():
        text = r["text"] or ""
        after = text[:3] + "xyz " + text[3:] if (r["doc_id"] or 0) > 2 else text
        want.append((str(r["doc_id"]), len(whole(BYTE, text)), len(whole(BYTE, after)), len(after)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["edited_tokens"], r["edited_chars"]) for r in edited) == sorted(want)
    assert max(r["encoded_chars"] for r in edited) < 2_000
    assert edit_counts.build_trees(no_documents, BYTE).count() == 0
