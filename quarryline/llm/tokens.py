"""Whole-text token ids with the tokenizers library, a piece at a time.

Both vocabularies split a text by a pattern before any merge, so the ids of a
text are the ids of its pieces in a row, and what was met before need not be
encoded again. Texts with characters outside the range where pattern, case
and normal form are the same in both regex engines, or with runs of spaces,
go to the library whole.
"""

from __future__ import annotations

import functools
import re

from . import words

#: Letters, digits and white space among the characters that don't go to the library whole.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-įı-ˁˆ-ˑˠ-ˤˬˮ", "0-9²³¹¼-¾", "\t-\r "
_OTHER = re.compile("[^\t-\r -~¡-įı-˿]")
#: The split patterns of the two vocabulary files, for these characters.
_WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Words and pieces remembered at most, unless told otherwise; then the memory starts anew.
MOST_KNOWN = 1_200_000


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Remembers what ``make`` gives."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        ids = self[key] = self.make(key)
        return ids


class PieceEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned integers of ``width`` bytes.

    Strings of special tokens in a text are ordinary text, and none are added.
    ``lower`` tells a vocabulary of lower-cased words from one of all bytes.
    """

    def __init__(self, path: str, lower: bool, width: int = 4, most_known: int = MOST_KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = width
        self.most_known = most_known
        self.tokenizer.encode_special_tokens = True
        self.lower = lower
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces = (_WORD_PIECES if lower else _BYTE_PIECES).findall
        self.known = _Known(self._piece)
        self.first = _Known(self._joined)
        self.later = self.first if lower else _Known(lambda word: self._joined(" " + word))

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(self.width, "little") for i in ids])

    def _piece(self, piece: str) -> bytes:
        spelt = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(spelt)])

    def _joined(self, word: str) -> bytes:
        pieces = self.pieces(word)
        if len(pieces) == 1:  # kept as a word
            return self.known.get(pieces[0]) or self._piece(pieces[0])
        return b"".join([self.known[p] for p in pieces])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not text.isascii() and _OTHER.search(text) or text.isascii() and not text.isprintable() and _OTHER.search(text):
            return self.whole(text)
        if len(self.known) + len(self.first) + len(self.later) > self.most_known:
            self.known.clear(), self.first.clear(), self.later.clear()
        if self.lower:
            return b"".join(map(self.first.__getitem__, text.lower().split()))
        if "  " in text:
            return self._joined(text)
        first, *later = text.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, later))


@functools.cache
def _encoder(path: str, lower: bool, width: int, most_known: int) -> PieceEncoder:
    return PieceEncoder(path, lower, width, most_known)


def encoder(path: str, lower: bool, width: int = 4, most_known: int = MOST_KNOWN) -> PieceEncoder:
    """One encoder for each worker process, which gives back what it remembers for other work."""
    words.forget()
    return _encoder(path, lower, width, most_known)


@functools.cache
def id_width(path: str) -> int:
    """Bytes that hold every id of a vocabulary: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def forget() -> None:
    """Drops the encoders of a worker process that goes on to other work."""
    _encoder.cache_clear()
