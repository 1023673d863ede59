"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

Leaves are runs of pre-tokens of about ``LEAF_CHARS`` characters, cut at single blanks between other characters, where
the encoder never merges. Every node keeps the characters and tokens below it. An edit finds its leaves by descending
on character counts, takes a neighbour along where it comes within two characters of a cut (the cut could move), encodes
only the new text of those leaves, puts its count into the first and empties the others, and renews the sums on the
paths to the root. Totals are read at the root.

``build_trees`` stores text and tree per row, ``apply_edits`` needs no join: edits are an array column
(at, remove, insert), applied one after the other, positions in the text as edited so far. Positions beyond the end
append, negative ones and null numbers count as 0, null insertions as nothing, a null array as no edit. Null texts are
empty. Null and repeated ids are kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import in_chunks, texts_of, whole_text
from tillwright.llm.piece_tokens import PieceEncoder, byte_encoder

LEAF_CHARS = 512
# A cut: a blank that stands alone between two other characters.
CUT = re.compile(r"(?<=\S) (?=\S)")
TREE_SCHEMA = "doc_id bigint, text string, chars array<int>, tokens array<int>"
EDITED_SCHEMA = (
    "doc_id bigint, n_tokens bigint, edited_tokens bigint, edited_chars bigint, encoded_chars bigint, edits bigint"
)


def leaf_starts(text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Starts of the leaves: 0 and the first cut at least ``leaf_chars`` after the start before."""
    starts = [0]
    while cut := CUT.search(text, starts[-1] + leaf_chars):
        starts.append(cut.start())
    return starts


class CountTree:
    """Characters and tokens of leaves and of all nodes above, as two arrays in heap order."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.width = chars, tokens, len(chars) // 2

    @classmethod
    def of_text(cls, text: str, encoder: PieceEncoder, leaf_chars: int = LEAF_CHARS) -> CountTree:
        starts = leaf_starts(text, leaf_chars)
        width = 1 << (len(starts) - 1).bit_length()
        tree = cls([0] * (2 * width), [0] * (2 * width))
        for leaf, (start, end) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True)):
            tree.chars[width + leaf] = end - start
            tree.tokens[width + leaf] = encoder.count(text[start:end])
        for node in range(width - 1, 0, -1):
            tree._sum(node)
        return tree

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and the position where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        self.chars[node], self.tokens[node] = chars, tokens
        while node := node // 2:
            self._sum(node)

    def replace(self, text: str, at: int, remove: int, insert: str, encoder: PieceEncoder) -> tuple[str, int]:
        """Apply an edit to ``text``, the document of this tree: the new text, and how many characters were encoded."""
        at = min(max(at, 0), len(text))
        end = min(at + max(remove, 0), len(text))
        if at == end and not insert:
            return text, 0
        first, start = self.find(min(max(at - 2, 0), max(0, len(text) - 1)))
        last, last_start = self.find(min(end + 1, max(0, len(text) - 1)))
        stop = last_start + self.chars[self.width + last]
        region = text[start:at] + insert + text[end:stop]
        for leaf in range(first + 1, last + 1):
            if self.chars[self.width + leaf] or self.tokens[self.width + leaf]:
                self.put(leaf, 0, 0)
        self.put(first, len(region), encoder.count(region))
        return text[:start] + region + text[stop:], len(region)


def build_trees(docs: DataFrame, vocabulary: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, text, chars, tokens): every document with the sums of its tree."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text", pa.string()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32())),
    ])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                    tree = CountTree.of_text(text, encoder, leaf_chars)
                    yield doc_id, text, tree.chars, tree.tokens

        yield from in_chunks(rows(), schema, 2_000)

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return chosen.mapInArrow(build, TREE_SCHEMA)


def apply_edits(trees: DataFrame, vocabulary: str) -> DataFrame:
    """Counts before and after the edits of each row (columns of ``build_trees`` and ``edits``)."""
    schema = pa.schema([(name.split()[0], pa.int64()) for name in EDITED_SCHEMA.split(", ")])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(name)).to_pylist()
                           for name in ("doc_id", "text", "chars", "tokens", "edits")]
                for doc_id, text, chars, tokens, edits in zip(*columns, strict=True):
                    tree, encoded = CountTree(chars, tokens), 0
                    before = tree.n_tokens
                    for change in edits or []:
                        text, again = tree.replace(
                            text, change["at"] or 0, change["remove"] or 0, change["insert"] or "", encoder
                        )
                        encoded += again
                    yield doc_id, before, tree.n_tokens, tree.n_chars, encoded, len(edits or [])

        yield from in_chunks(rows(), schema)

    return trees.select("doc_id", "text", "chars", "tokens", "edits").mapInArrow(edit, EDITED_SCHEMA)
