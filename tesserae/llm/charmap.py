"""Models in the public SentencePiece format and their normalisation, with source offsets.

A model file is a protocol buffer message of pieces, a trainer record and a
normaliser record. The normaliser's compiled character map is a double-array
trie of byte strings beside the texts that replace them: at every place the
longest prefix that the trie holds is replaced, and anything else stays as it
is. ``normalise`` also tells, for every byte it gives, at which byte of the
source it begins.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np

MARK = "▁"
_MARK = MARK.encode()
#: Kinds of pieces in a model file; fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and raw values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({5: 4, 1: 8}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """What a model file holds: ``pieces`` as (text, score, kind), and its settings."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        rules: dict[int, object] = {}
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                rules = dict(_fields(value))
        self.is_bpe, self.byte_fallback = trainer.get(3, 1) == 2, bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.mark_last = bool(trainer.get(24, 0))
        self.charmap = CharMap(rules.get(2, b""))
        # Absent fields have the format's defaults, which are true.
        self.dummy_prefix, self.trim, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))

    def id_of(self, piece: str, kind: int) -> int | None:
        return next((k for k, (p, _, t) in enumerate(self.pieces) if t == kind and p == piece), None)


class CharMap:
    """A compiled character map; an empty one changes nothing."""

    def __init__(self, blob: bytes = b"") -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self._starts: dict[str, bool] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _walk(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """Nodes on the path of ``data`` from ``at`` on: bytes read, and the node's unit."""
        units = self.units
        if not units:
            return
        node = self._offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                return
            unit = units[node]
            node ^= self._offset(unit)
            yield k + 1 - at, node if unit & 0x100 else -1

    def starts(self, char: str) -> bool:
        """Whether some key begins with ``char``; remembered by character."""
        if char not in self._starts:
            raw = char.encode()
            self._starts[char] = any(n == len(raw) for n, _ in self._walk(raw, 0))
        return self._starts[char]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest key at ``at`` (0: none) and what replaces it."""
        size, leaf = 0, -1
        for n, node in self._walk(data, at):
            if node >= 0:
                size, leaf = n, node
        if not size:
            return 0, b""
        begin = self.units[leaf] & 0x7FFFFFFF
        return size, self.texts[begin : self.texts.index(0, begin)]


def _parts(text: str, charmap: CharMap) -> Iterator[tuple[int, bytes, bool]]:
    """Consecutive parts of ``text``: the source byte each begins at, what it becomes, and whether that is the source itself."""
    special = "".join(c for c in set(text) if charmap.starts(c))
    data = text.encode()
    if not special:
        yield 0, data, True
        return
    find, at, char = re.compile(f"[{re.escape(special)}]").search, 0, 0
    while at < len(data):
        m = find(text, char)
        run = text[char : m.start() if m else len(text)].encode()
        if run:
            yield at, run, True
            at += len(run)
        if m:
            size, new = charmap.longest(data, at)
            if not size:
                size, new = len(m.group().encode()), None
            yield at, data[at : at + size] if new is None else new, new is None
            char = m.start() + len(data[at : at + size].decode())
            at += size


def normalise(text: str, model: Model) -> tuple[str, np.ndarray]:
    """The normalised text, and for each of its UTF-8 bytes the source byte it begins at; the last entry is where it ends."""
    held, starts, end = [], [], len(text.encode())
    after_space = model.trim  # spaces at the front and after a space go, if the model says so
    front = None if model.trim else 0  # where the text begins after the spaces at its front
    for at, part, own in _parts(text, model.charmap):
        x = np.frombuffer(part, np.uint8)
        if front is None and (part.strip(b" ") if own else part != b" "):
            front = at + len(part) - len(part.lstrip(b" ")) if own else at
        where = np.arange(at, at + len(x)) if own else np.full(len(x), at)
        if model.trim and len(x):
            space = x == 32
            # Within a replacement only the spaces at its front can go.
            drop = space & np.r_[after_space, space[:-1]] if own else np.logical_and.accumulate(space) & after_space
            if own or not drop.all():
                after_space = bool(space[-1])
            x, where = x[~drop], where[~drop]
        held.append(x)
        starts.append(where)
    body = np.concatenate(held or [np.zeros(0, np.uint8)])
    where = np.concatenate(starts or [np.zeros(0, np.int64)])
    if model.trim:
        n = len(body.tobytes().rstrip(b" "))
        end = int(where[n]) if n < len(body) else end
        body, where = body[:n], where[:n]
    if not text or front is None or not (len(body) or not model.trim or model.mark_last):
        return "", np.array([end])
    if model.dummy_prefix:
        body = np.r_[body, np.uint8(32)] if model.mark_last else np.r_[np.uint8(32), body]
        where = np.r_[where, end] if model.mark_last else np.r_[front, where]
    out = body.tobytes().decode()
    if model.escape:
        out, where = out.replace(" ", MARK), np.repeat(where, np.where(body == 32, len(_MARK), 1))
    return out, np.r_[where, end]
