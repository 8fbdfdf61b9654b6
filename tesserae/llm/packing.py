"""Sum-of-squares online packing of token sequences into windows.

Whole windows of a document are cut off first. What remains of it goes to the
fill level for which the sum over levels of squared counts of partially filled
windows becomes least; the counts are a level array. Each task packs its own
rows as they come, without a shuffle. Windows leave as soon as they are full;
when more than ``max_open`` are open, the fuller half leaves as it is. When a task
ends, open windows with a gap of at most ``window / 32`` leave as they are, and
only the emptier ones are joined and cut anew. Their number grows like the
square root of the task's rows, so their share falls: with 8,000 documents in a
task about a tenth of the windows, of 250 about a third.

Sequence ids are the task's number times 2^40 plus a count; they agree between
runs over the same input splits.

Defined cases: null and empty texts are one end id; repeated rows are packed
one by one; an empty table gives no sequences; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._common import emitted, schema_of
from tesserae.llm.tokenization import encoder, public_path

#: (document, ids before the piece, ids, ids of the document)
Piece = tuple[object, int, np.ndarray, int]


class Packer:
    """Online packer of one task; ``add`` and ``end`` yield finished windows as lists of pieces."""

    def __init__(self, window: int = 1024, max_open: int = 16384) -> None:
        self.window, self.max_open, self.n_open = window, max_open, 0
        self.count = np.zeros(window + 1, np.int64)  # the level array; a full window never counts
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]

    def add(self, key: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        n, w = len(ids), self.window
        whole = n - n % w
        for at in range(0, whole, w):
            yield [(key, at, ids[at : at + w], n)]
        if whole < n:
            full = self._place((key, whole, ids[whole:], n))
            if full:
                yield full
            if self.n_open > self.max_open:
                yield from self._shed(self.n_open // 2)

    def _place(self, piece: Piece) -> list[Piece] | None:
        size, w, count = len(piece[2]), self.window, self.count
        # change of the sum of squares, less 1: a new window; a window of level h
        best, level = 2 * int(count[size]), 0
        of, to = count[1 : w - size + 1], count[size + 1 : w + 1]
        if len(of):
            change = np.where(of > 0, 2 * (to - of) + 1, 1 << 40)
            change[-1] -= of[-1] > 0  # it becomes full and leaves
            h = len(change) - 1 - int(change[::-1].argmin())
            if change[h] <= best:
                level = h + 1
        pieces = self.open[level].pop() if level else []
        pieces.append(piece)
        count[level] -= level > 0
        self.n_open -= level > 0
        if level + size == w:
            return pieces
        self._keep(level + size, pieces)
        return None

    def _keep(self, level: int, pieces: list[Piece]) -> None:
        self.open[level].append(pieces)
        self.count[level] += 1
        self.n_open += 1

    def _shed(self, most: int, least: int = 0) -> Iterator[list[Piece]]:
        """At most ``most`` of the fullest open windows, of level ``least`` or more, as they are."""
        for level in range(self.window - 1, least - 1, -1):
            while most and self.open[level]:
                yield self.open[level].pop()
                self.count[level] -= 1
                self.n_open -= 1
                most -= 1

    def _recut(self) -> Iterator[list[Piece]]:
        """Join the open windows and cut them anew; the last, if not full, stays open."""
        rest = [p for level in reversed(self.open) for pieces in level for p in pieces]
        self.open, self.n_open = [[] for _ in range(self.window)], 0
        self.count[:] = 0
        now, room = [], self.window
        for key, start, ids, n in rest:
            while len(ids):
                part = ids[:room]
                now.append((key, start, part, n))
                start, ids, room = start + len(part), ids[len(part) :], room - len(part)
                if not room:
                    yield now
                    now, room = [], self.window
        if now:
            self._keep(self.window - room, now)

    def end(self) -> Iterator[list[Piece]]:
        yield from self._shed(self.n_open, self.window - self.window // 32)
        yield from self._recut()
        yield from self._shed(self.n_open)


def pack(df: DataFrame, window: int = 1024, tokenizer: str = "byte_bpe_50k.json", kind: str = "byte", end_id: int = 0, id_col: str = "doc_id", text: str = "text", max_open: int = 16384) -> DataFrame:
    """Pieces of the packed rows of ``df``.

    Columns: id, ``start``, ``length``, ``ids`` (32-bit little-endian),
    ``doc_tokens``, ``sequence_id``, ``offset``.
    """
    fields = [(id_col, df.schema[id_col].dataType.simpleString()), ("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]
    fields[0] = (id_col, "long" if fields[0][1] in ("bigint", "int", "smallint", "tinyint") else "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, tail = encoder(public_path(tokenizer), kind).ids, Packer(window, max_open), end_id.to_bytes(2, "little")

        def windows() -> Iterator[list[Piece]]:
            for b in batches:
                for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield from packer.add(key, np.frombuffer(encode(t or "") + tail, "<u2"))
            yield from packer.end()

        def rows() -> Iterator[tuple]:
            for k, pieces in enumerate(windows(), TaskContext.get().partitionId() << 40):
                at = 0
                for key, start, ids, n in pieces:
                    yield key, start, len(ids), ids.astype("<u4").tobytes(), n, k, at
                    at += len(ids)

        return emitted(rows(), fields, 2048)

    return df.select(F.col(id_col).cast(fields[0][1]), F.col(text)).mapInArrow(run, schema_of(fields))
