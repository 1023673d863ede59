"""Whole texts to token ids with the tokenizers library, encoding every distinct word once per task.

A byte-pair encoder never merges across the borders its pre-tokenizer sets, and single blanks and line breaks between
other characters are such borders for the vocabularies used here. A text is therefore cut there, each distinct piece
is encoded once by the library, and the ids (kept as little-endian 32-bit bytes) are joined. Texts where a cut could
be wrong (runs of white space, where borders depend on the neighbours) are encoded as a whole. The ids are those of
encoding the text in one call; tests/llm/test_tokens.py compares both on arbitrary texts.
"""

from __future__ import annotations

import re
from functools import lru_cache
from string import punctuation as PUNCTUATION
from struct import pack

from tokenizers import Tokenizer

# Distinct pieces remembered per task, about 200 bytes each; pieces first seen later are encoded at each sight.
REMEMBERED_PIECES = 400_000
RUN_OF_BLANKS = re.compile(r"\s\s")
# Letters below this one are precomposed Latin letters, on which all Unicode versions agree.
BEYOND_LATIN = "\u0250"


def _is_plain(word: str) -> bool:
    """One run of Latin letters, in lower case too (one capital has a lower case with a mark that is no letter)."""
    return word.isalpha() and (word.isascii() or max(word) < BEYOND_LATIN and word.lower().isalpha())


class _Marks(dict):
    """Character -> how the library's pre-tokenizer writes its bytes."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.pre_tokenizer = tokenizer.pre_tokenizer

    def __missing__(self, letter: str) -> str:
        self[letter] = "".join(part for part, _ in self.pre_tokenizer.pre_tokenize_str(letter))
        return self[letter]


class _Pieces(dict):
    """Piece -> ids as bytes, filled by the library on first sight.

    A word of Latin letters is one pre-token, which the library's model takes directly; the run of ASCII punctuation marks
    that ends such a piece is a pre-token of its own. Every other piece goes through the whole tokenizer.
    """

    def __init__(self, tokenizer: Tokenizer, blanks_kept: bool):
        super().__init__()
        self.tokenizer, self.model, self.marks = tokenizer, tokenizer.model, _Marks(tokenizer)
        self.blanks_kept = blanks_kept
        self.blank = "".join(p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(" ")) if blanks_kept else ""

    def __missing__(self, piece: str) -> bytes:
        word = piece[1:] if piece[:1] == " " else piece
        head = word.rstrip(PUNCTUATION)
        if not _is_plain(head):
            ids = self.whole(piece)
        elif len(head) < len(word):
            # Straight to the word's own entry, so that a capital with a mark does not fill three.
            first = piece[: len(piece) - len(word) + len(head)]
            ids = self[first if self.blanks_kept else first.lower()] + self[word[len(head) :]]
        elif self.blanks_kept:
            ids = self._packed(self._tokens(("" if word is piece else self.blank) + self._written(word)))
        elif (lower := word.lower()) != piece:
            ids = self[lower]
        else:
            ids = self._packed(self._tokens(self._written(lower)))
        if len(self) < REMEMBERED_PIECES:
            self[piece] = ids
        return ids

    def _written(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.marks.__getitem__, word))

    def _tokens(self, pre_token: str) -> list[int]:
        return [token.id for token in self.model.tokenize(pre_token)]

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


class PieceEncoder:
    """``blanks_kept``: the vocabulary has ids for white space (byte-level), else white space only separates words."""

    def __init__(self, tokenizer: Tokenizer, blanks_kept: bool):
        self.pieces = _Pieces(tokenizer, blanks_kept)
        self.blanks_kept = blanks_kept

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        if not self.blanks_kept:
            return b"".join(map(pieces.__getitem__, text.replace("\n", " ").split(" ")))
        if "\0" in text or RUN_OF_BLANKS.search(text):
            return pieces.whole(text)
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return b"".join(map(pieces.__getitem__, cut))

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


@lru_cache(maxsize=4)
def encoder(path: str, blanks_kept: bool) -> PieceEncoder:
    """One encoder per Python worker and vocabulary file."""
    return PieceEncoder(Tokenizer.from_file(path), blanks_kept)


def word_encoder(path: str) -> PieceEncoder:
    return encoder(path, False)


def byte_encoder(path: str) -> PieceEncoder:
    return encoder(path, True)
