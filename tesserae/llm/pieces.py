"""SentencePiece encoding with source offsets, and decoding.

A text is normalised by the longest prefixes of the model's compiled character
map, which keeps for every normalised byte the source byte it comes from
(``charmap``). The normalised text falls into chunks that no piece of the
vocabulary crosses: before marks, and between letters and the rest. A chunk's
neighbouring symbols are merged by the pieces' scores, highest first and
leftmost among equals; distinct chunks are merged once and remembered in a memo
of bounded size. Pieces are then laid over the normalised bytes, and their borders
projected to bytes of the source. Characters that no piece covers become byte
pieces, one a byte (without byte fallback: a run of them is one unknown piece).

Each task encodes its own rows as they come; nothing is shuffled, and what a
task holds is one Arrow batch, the memo and one text.

Defined cases: null and empty texts are the begin and end ids alone, with empty
spans at the text's two ends, and decode to the empty string; repeated rows are
encoded one by one; an empty table gives an empty table; other columns are not
read. Vocabularies of user-defined pieces, or other than by merges, are refused.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.llm._common import trimmed
from tesserae.llm.charmap import BYTE, CONTROL, MARK, NORMAL, UNKNOWN, UNUSED, USER_DEFINED, Model, normalise
from tesserae.llm.tokenization import _Memo, public_path

#: Chunks of one generation of the memo (there are two), and ids of an output batch.
MEMO_CHUNKS, BATCH_IDS = 400_000, 1 << 18
#: Latin letters: few vocabularies have pieces of these and of others.
LETTERS = "A-Za-z\u00c0-\u024f"
#: Characters of a chunk up to which the best pair is looked for by a plain search.
SHORT = 64

# Each byte of a wrong sequence becomes one replacement character.
codecs.register_error("tesserae-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class _Packed(dict):
    """Pieces to their ids and normalised bytes, as pairs of 32-bit integers; what is no piece falls to bytes or the unknown id."""

    def __init__(self, model: Model, unknown: int) -> None:
        super().__init__((p, struct.pack("<II", k, len(p.encode()))) for k, (p, _, t) in enumerate(model.pieces) if t in (NORMAL, UNUSED))
        own = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.of = (lambda raw: b"".join(struct.pack("<II", own[b], 1) for b in raw)) if model.byte_fallback else (lambda raw: struct.pack("<II", unknown, len(raw)))

    def __missing__(self, piece: str) -> bytes:
        return self.of(piece.encode())


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, data: bytes) -> None:
        self.model = model = Model(data)
        if not model.is_bpe or any(t == USER_DEFINED for _, _, t in model.pieces):
            raise ValueError("only vocabularies of merged pieces without user-defined ones are supported")
        self.cost = {p: -s for p, s, t in model.pieces if t in (NORMAL, UNUSED)}
        self.unused = {p for p, _, t in model.pieces if t == UNUSED}
        self.unknown, self.bos, self.eos = (model.id_of(*x) for x in (("<unk>", UNKNOWN), ("<s>", CONTROL), ("</s>", CONTROL)))
        self.chunks = self._chunker()
        self.packed = _Packed(model, self.unknown)
        self.memo = _Memo(lambda chunk: b"".join(map(self.packed.__getitem__, self.merged(chunk))), MEMO_CHUNKS)
        self.control = np.array([t == CONTROL for _, _, t in model.pieces])
        self.surface = [self._surface(k) for k in range(len(model.pieces))]

    def _chunker(self) -> Callable[[str], list[str]]:
        """Cuts normalised texts at places that no piece of the vocabulary crosses."""
        bodies = [p.lstrip(MARK) for p in self.cost]
        if self.model.mark_last or any(MARK in p for p in bodies):
            return lambda text: [text] if text else []
        if any(len({bool(x) for x in map(re.compile(f"[{LETTERS}]").match, p)}) > 1 for p in bodies):
            return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        return re.compile(f"{MARK}*[{LETTERS}]+|{MARK}*[^{MARK}{LETTERS}]+|{MARK}+").findall

    def _surface(self, k: int) -> bytes:
        piece, _, kind = self.model.pieces[k]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else self.model.unknown_text.encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def merged(self, chunk: str) -> list[str]:
        """The pieces of a chunk: neighbours merged by score, the leftmost of equals first."""
        if len(chunk) > SHORT or self.unused:
            return self._merged_by_heap(chunk)
        cost, none = self.cost.get, float("inf")
        symbols = list(chunk)
        costs = [cost(a + b, none) for a, b in zip(chunk, chunk[1:])]
        while costs:
            least = min(costs)
            if least == none:
                break
            k = costs.index(least)
            symbols[k] += symbols.pop(k + 1)
            del costs[k]
            if k:
                costs[k - 1] = cost(symbols[k - 1] + symbols[k], none)
            if k < len(costs):
                costs[k] = cost(symbols[k] + symbols[k + 1], none)
        return symbols

    def _merged_by_heap(self, chunk: str) -> list[str]:
        """The same for chunks of any length; pieces that are marked unused fall apart again."""
        symbols, n, cost = list(chunk), len(chunk), self.cost
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        made: dict[str, tuple[str, str]] = {}
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                piece = symbols[a] + symbols[b]
                if piece in cost:
                    heapq.heappush(heap, (cost[piece], a, b, piece))
                    if piece in self.unused:
                        made[piece] = (symbols[a], symbols[b])

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, piece = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != len(piece):
                continue  # one of the two has been merged since
            symbols[a], symbols[b], right[a] = piece, "", right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])

        def split(piece: str) -> list[str]:
            return [x for half in made[piece] for x in split(half)] if piece in made else [piece]

        return [x for s in symbols if s for x in split(s)]

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the source bytes at which each piece begins and ends."""
        self.memo.bound()
        shown, where = normalise(text, self.model)
        found = np.frombuffer(b"".join(map(self.memo.__getitem__, self.chunks(shown))), "<u4").reshape(-1, 2)
        ids, ends = found[:, 0], np.cumsum(found[:, 1], dtype=np.int64)
        if not self.model.byte_fallback and len(ids):  # runs of unknown pieces are one
            last = np.append((ids[1:] != self.unknown) | (ids[:-1] != self.unknown), True)
            ids, ends = ids[last], ends[last]
        # Empty spans of the begin and end ids at the two ends of the text.
        front = where[:1] if len(ids) else where[-1:]
        borders = np.concatenate([where[:bos] * 0, front, where[ends], where[-1:][:eos]])
        ids = np.concatenate([np.array([self.bos] * bos, "<u4"), ids, np.array([self.eos] * eos, "<u4")])
        starts, ends = borders[:-1], borders[1:]
        if bos:
            ends = ends.copy()
            ends[0] = 0
        return ids, starts, ends

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: marks are spaces, bytes are joined, control pieces are nothing; the space of the dummy prefix goes."""
        model, surface = self.model, self.surface.__getitem__
        # Bytes on two sides of a control piece are no one character.
        parts = np.split(ids, np.flatnonzero(self.control[ids]))
        out = "".join(b"".join(map(surface, x.tolist())).decode("utf-8", "tesserae-each-byte") for x in parts)
        if model.dummy_prefix or model.trim:
            cut = 0
            for k in ids.tolist():
                piece, _, kind = model.pieces[k]
                if kind == CONTROL:
                    continue
                front = kind in (NORMAL, UNUSED) and piece.startswith(MARK)
                cut += front
                if not front or piece != MARK or not model.trim:
                    break
            out = out[cut:]
        return out


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One encoder for each model file and Python worker."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Pieces(f.read())
    return _LOADED[path]


def encode_pieces(df: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text: str = "text", bos: bool = True, eos: bool = True) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids`` (32-bit little-endian), and the source bytes ``starts`` and ``ends`` of each piece."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T._parse_datatype_string("n_tokens long, ids binary, starts array<int>, ends array<int>").fields])
    names = schema.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces(public_path(model)).encode
        for b in batches:
            first, held, size = 0, [], 0
            for k, t in enumerate(b.column(1)):
                held.append(encode(t.as_py() or "", bos, eos))
                size += len(held[-1][0])
                if size > BATCH_IDS or k + 1 == b.num_rows:
                    at = pa.array(np.r_[0, np.cumsum([len(x) for x, _, _ in held])].astype(np.int32))
                    spans = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([h[j] for h in held]).astype(np.int32))) for j in (1, 2)]
                    own = [b.column(0).slice(first, len(held)), pa.array([len(x) for x, _, _ in held], pa.int64()), pa.array([x.astype("<u4").tobytes() for x, _, _ in held], pa.binary()), *spans]
                    yield pa.RecordBatch.from_arrays(own, names=names)
                    first, held, size = k + 1, [], 0

    return df.select(id_col, text).mapInArrow(lambda batches: trimmed(rows(batches)), schema)


def decode_pieces(df: DataFrame, model: str = "piece_bpe_32k.model", ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the text of its ``ids`` as ``name``; null ids are none."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    at = df.columns.index(ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = pieces(public_path(model)).decode
        for b in batches:
            texts = [decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(lambda batches: trimmed(rows(batches)), schema)
