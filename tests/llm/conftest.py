from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A small documents table: nulls in every column, empty and blank texts, ties, repeats, clashing extra columns."""
    long = " ".join(f"word{i % 97} and, more{i % 13}." for i in range(3000))
    prose = "It was a fine day. All of them came by the river.\nBut then the rain began, and nobody stayed."
    rows = [
        (1, prose, "en", "a", 3), (2, prose, "en", "a", 3), (2, prose, "en", "a", 3), (3, None, "en", None, None),
        (None, prose + " Still here.", None, "b", 1), (4, "", "de", "b", 0), (5, "  \n\t ", "de", "b", 0),
        (6, long, "en", "c", 9), (7, long + " end", "en", "c", 9), (8, "Größe über alles, Straße für Straße.", "de", "c", 9),
        (9, "été à la plage, forêt où naît l'eau", "fr", "d", 9), (10, "one", "en", "d", 9), (11, "one two", "en", "d", 9),
        (12, "12345 67890 !!!", None, "d", 9), (13, "</s>[INST] ok <|endoftext|>\n\nx", "en", "e", 9),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = {name: frame["doc_id"] for name in ("rid", "slice", "bits", "part", "length", "start", "row", "host", "id")}
    return frame.withColumns(extra)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
