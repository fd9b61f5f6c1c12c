"""Whole texts to token ids with the ``tokenizers`` library, inside Spark tasks.

Byte-pair merges never cross the boundary between a visible character and the
white space after it, nor that between a letter and an ASCII sign or digit, so a
text may be cut there and its pieces encoded one by one.  A task remembers the
ids of the short pieces it has met lately, in a space of bounded size that ends
with it; only new pieces go through the library.  Texts in which such a cut could
change the result (other white space than blanks and line feeds for byte-level
vocabularies, or the strings of special tokens) are encoded in one call.

A new piece of well-known letters, ASCII signs and digits is cut into words by
the vocabulary's own public pattern and each word goes to the library's model
alone; every other new piece goes through the whole library.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

BYTE_LEVEL = "byte_bpe_50k.json"
WORD_LEVEL = "word_bpe_49k.json"

#: Pieces of ``SHORT`` characters at most are remembered, in two generations of so many (about 200 bytes each); results don't depend on either.
REMEMBERED = 300_000
SHORT = 40

#: Latin letters (but U+0130, which becomes two characters in lower case), not followed by anything that could be a letter or a mark: the end of such a run is a boundary.
_LETTERS = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]++(?![\x80-\U0010FFFF])"
_PIECE = re.compile(rf"[ \n]*+{_LETTERS}|[ \n]*[^ \n]+|[ \n]+")
_WORD = re.compile(rf"{_LETTERS}|[^ \n]+")
#: All white space but blanks and line feeds.
_OTHER_SPACE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Letters that every version of Unicode calls letters, that composition leaves alone and that have one lower case: Latin, Cyrillic, Hebrew, Arabic, kana, Han, Hangul.
_SURE = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F\u0410-\u044F\u0401\u0451\u05D0-\u05EA\u0621-\u063A\u0641-\u064A\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3"
_PLAIN = re.compile(rf"[ -~\n{_SURE}]+")
#: The patterns by which these vocabularies cut words, over ``_PLAIN`` texts.
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_WORDS = re.compile(rf"{_ENDINGS}| ?[{_SURE}]+| ?[0-9]+| ?[^\s{_SURE}0-9]+|\s+(?!\S)|\s+")
_WORD_WORDS = re.compile(rf"{_ENDINGS}|[{_SURE}]+|[0-9]|[^\s{_SURE}0-9]+")
#: How byte-level vocabularies write bytes: visible signs stay, the others follow 255 in order.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_BYTES = [chr(b if b in _VISIBLE else 256 + _HIDDEN.index(b)) for b in range(256)]

#: The libraries' own tables, by file; what a task remembers isn't kept here.
_tokenizers: dict = {}


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Remembered(dict):
    """Ids by piece; what is missing comes from the generation before, or is made."""

    def __init__(self, make: Callable[[str], bytes], older: dict[str, bytes]):
        self.make, self.older = make, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer.from_file(path)
        self.tokenizer = _tokenizers[path]
        self.keeps_space = keeps_space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.known = _Remembered(self._piece, {})

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece that holds no special token."""
        if not _PLAIN.fullmatch(piece):
            return self._library(piece)
        words = _BYTE_WORDS.findall(piece) if self.keeps_space else _WORD_WORDS.findall(piece.lower())
        return array("I", [t.id for w in words for t in self.model.tokenize("".join([_BYTES[b] for b in w.encode()]))]).tobytes()

    def _whole(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return True
        return self.keeps_space and _OTHER_SPACE.search(text) is not None

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self._whole(text):
            return self._library(text)
        if len(self.known) > REMEMBERED:
            self.known.older = {}
            self.known = _Remembered(self._piece, self.known)
        pieces = (_PIECE if self.keeps_space else _WORD).findall(text)
        return b"".join(map(self.known.__getitem__, pieces))


def encoder(path: str, keeps_space: bool) -> Encoder:
    """A task's own encoder for a vocabulary file."""
    return Encoder(path, keeps_space)
