"""Ids of whole texts by the tokenizers library, through a cache of the pieces that no token crosses."""

from __future__ import annotations

import re
import struct

import numpy as np
from tokenizers import Tokenizer

#: Unicode white space, beyond which no pre-token that starts before it reaches.
WHITE = "\t-\r \x85\xa0  -     　"
_SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Bytes at whose sight a text isn't cut at single spaces and line ends but by _SEGMENT: runs of white space, and rarer kinds.
_RARE = (b"  ", b" \n", b"\n ", b"\n\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: A word that needs neither normalising nor splitting: Latin-1 letters, then one mark at most.
_PLAIN = re.compile("([\n ]?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([,.;:!?]?)")
#: Pieces held before the cache starts anew.
HELD = 700_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it is printable Latin-1, else the next from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: bytes) -> bytes:
        if len(self) >= HELD:
            self.clear()
        self[key] = out = self.make(key)
        return out


class WholeTexts:
    """Ids of whole texts, as little-endian unsigned 16 or 32 bits end to end.

    A pre-token never reaches from a character that isn't white space over white space, so a text may be cut before
    white space and each distinct piece be encoded once by the library. `words`: the vocabulary drops white space and
    lowers case; else a piece keeps the space or line end before it."""

    def __init__(self, path: str, words: bool) -> None:
        self.tok, self.words = Tokenizer.from_file(path), words
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.format = "<%dH" if self.dtype.itemsize == 2 else "<%dI"
        self.bases: dict[str, bytes] = {}
        self.pieces = _Pieces(self._word if words else self._after_space)
        self.firsts = _Pieces(lambda p: self._segment(p.decode("utf-8", "replace")))

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(self.format % len(ids), *ids)

    def _library(self, text: str) -> bytes:
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _base(self, text: str) -> bytes:
        """One pre-token, with a space before it or not, by the library's model alone."""
        if (out := self.bases.get(text)) is None:
            if len(self.bases) >= HELD:
                self.bases.clear()
            shown = text if text.isalpha() and text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            self.bases[text] = out = self._pack([t.id for t in self.tok.model.tokenize(shown)])
        return out

    def _word(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace")
        if text.isascii():
            if text.isalpha():
                return self._base(text.lower())
            if text[-1] in ",.;:!?" and text[:-1].isalpha():
                return self._base(text[:-1].lower()) + self._base(text[-1])
        m = _PLAIN.fullmatch(text)
        if not m:
            return self._library(text)
        return self._base(m[2].lower()) + (self._base(m[3]) if m[3] else b"")

    def _segment(self, text: str) -> bytes:
        m = _PLAIN.fullmatch(text)
        if not m:
            return self._library(text)
        head = self._base("\n") + self._base(m[2]) if m[1] == "\n" else self._base(m[1] + m[2])
        return head + (self._base(m[3]) if m[3] else b"")

    def _after_space(self, piece: bytes) -> bytes:
        return self._segment((piece if piece[:1] == b"\n" else b" " + piece).decode("utf-8", "replace"))

    def split(self, body: bytes) -> list[bytes]:
        """The pieces of a text that no token crosses; together their tokens are those of the text."""
        if self.words:
            return body.split()
        if any(x in body for x in self.added):
            return [body]
        return [x.encode() for x in _SEGMENT.findall(body.decode("utf-8", "replace"))]

    def length(self, piece: bytes) -> int:
        """How many tokens a piece has."""
        text = piece.decode("utf-8", "replace")
        if self.words and text.isascii() and text.isalpha():
            return len(self.tok.model.tokenize(text.lower()))
        return len(self.tok.encode(text, add_special_tokens=False))

    def encode(self, body: bytes) -> bytes:
        if self.words:
            return b"".join(map(self.pieces.__getitem__, body.split()))
        if any(x in body for x in self.added):  # an added token ends a segment wherever it stands
            return self._library(body.decode("utf-8", "replace"))
        if any(x in body for x in _RARE) or body.endswith(b"\n\n"):
            return b"".join([self.firsts[x.encode()] for x in _SEGMENT.findall(body.decode("utf-8", "replace"))])
        first, *rest = body.replace(b"\n", b" \n").split(b" ")
        return (self.firsts[first] if first else b"") + b"".join(map(self.pieces.__getitem__, rest))


_held: dict[tuple[str, bool], WholeTexts] = {}


def whole_texts(path: str, words: bool) -> WholeTexts:
    """One per Python worker, so that its cache serves every task there."""
    if (path, words) not in _held:
        _held[path, words] = WholeTexts(path, words)
    return _held[path, words]


def forget() -> None:
    """Let the worker's tokenizers and their caches go: for stages that come after one that encoded."""
    _held.clear()
