"""Ids of public tokenizers for whole texts, with a memo of pre-tokens.

``Encoder`` gives the ids that ``tokenizers`` gives for a whole text. Texts of
plain Latin characters are cut into the tokenizer's own pre-tokens here, and each
distinct pre-token is merged by the library's own model once and remembered; a
text with any other character, or with a special token's string in it, goes to
the library whole. The memo is bounded in entries and bytes, in two
generations: it never changes ids.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters for which the two pre-token patterns below are exact: ASCII without
#: control characters but for \t\n\r, and Latin letters that have no decomposed form in play.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: The byte-level pre-token pattern on those characters, its most frequent case first.
_BYTE_LEVEL = re.compile(rf" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")
#: The word-level pre-token pattern on those characters, after lower-casing.
_WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s0-9{_LETTER}]+")

#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}

#: Entries of one generation of a memo, by kind; there are two. Longer strings are not remembered.
MEMO_ENTRIES, MEMO_CHARS = {"word": 750_000, "byte": 450_000}, 48
_ENCODERS: dict = {}


class Encoder:
    """``ids(text)`` of one tokenizer file, as bytes of ``code``-sized unsigned ids."""

    def __init__(self, path: str, kind: str, code: str = "H") -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if (array(code).itemsize == 2) and self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.kind, self.code = kind, code
        self.find = {"byte": _BYTE_LEVEL, "word": _WORD_LEVEL}[kind].findall
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        self.model = self.tokenizer.model
        self.memo = _Memo(self._merge, MEMO_ENTRIES[kind])  # pre-tokens to ids

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()

    def ids(self, text: str) -> bytes:
        if _PLAIN.search(text) or self.special.search(text):
            return self.whole(text)
        self.memo.bound()
        return b"".join(map(self.memo.__getitem__, self.find(text.lower() if self.kind == "word" else text)))


class _Memo(dict):
    """Pre-tokens to ids in two generations; what neither holds is made by ``make``."""

    def __init__(self, make: Callable[[str], bytes], entries: int) -> None:
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids

    def bound(self) -> None:
        """The young generation, once full, becomes the old one, which is dropped; what is used again moves up."""
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def public_path(name: str) -> str:
    """Where the tokenizer file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
