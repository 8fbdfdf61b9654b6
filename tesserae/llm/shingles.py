"""Word shingles as sorted sets of 64-bit hashes, and counts of hash cells over a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from tesserae.llm._common import emitted, schema_of, stored

#: Words are hashed in runs of so many, so temporary arrays stay small for very long texts.
RUN_WORDS = 1 << 20
_MASK, _START = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _windows(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of all ``width``-word windows: word hashes taken in one after another, each through a mixing step."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.full(n, (_START * width) & _MASK, np.uint64)
    for k in range(width):
        h = _mixed(h ^ w[k : k + n])
    return h


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; all words as one if they are fewer."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII spaces only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(n, width)
    if n <= RUN_WORDS:
        out = _windows(words, width)
    else:
        out = np.concatenate([_windows(words[s : s + RUN_WORDS + width - 1], width) for s in range(0, n - width + 1, RUN_WORDS)])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_key(a: np.ndarray) -> int:
    """A signed 64-bit key of a set; with the set's size it stands for the set."""
    return xxhash.xxh3_64_intdigest(a.tobytes()) - (1 << 63)


#: Cells grow with the corpus, about one for 20 shingles, up to 2^25: 64 MB once for each executor.
LEAST_BITS, MOST_BITS, SLICE_BITS, DENSE_BITS = 16, 25, 14, 22


def cell_bits(n_bytes: int) -> int:
    """Bits of the cell number for a corpus of so many bytes of text."""
    return min(MOST_BITS, max(LEAST_BITS, (n_bytes // 128).bit_length()))


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class CellCounts:
    """Counts of a task's hashes by cell, as rows ``(slice, blob)`` of cells within a slice and their counts."""

    def __init__(self, bits: int) -> None:
        self.bits, self.held, self.size = bits, [], 0
        self.dense = np.zeros(1 << bits, np.uint32) if bits <= DENSE_BITS else None

    def add(self, hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
        self.held.append(cells(hashes, self.bits).astype(np.uint32))
        self.size += len(hashes)
        if self.size > 1 << (19 if self.dense is not None else 22):
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.held:
            return
        found = np.concatenate(self.held)
        self.held, self.size = [], 0
        at, n = np.unique(found, return_counts=True)
        if self.dense is not None:
            self.dense[at] += n.astype(np.uint32)
        else:
            yield from self._slices(at, n)

    def end(self) -> Iterator[tuple[int, bytes]]:
        yield from self.flush()
        if self.dense is not None:
            at = np.flatnonzero(self.dense)
            yield from self._slices(at, self.dense[at])

    def _slices(self, at: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes]]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        owner = at >> SLICE_BITS
        edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(at) else np.zeros(1, np.int64)
        for s, e in zip(edges[:-1], edges[1:]):
            yield int(owner[s]), squeeze((at[s:e] & (1 << SLICE_BITS) - 1).astype("<u2").tobytes() + n[s:e].astype("<u4").tobytes())


def rarity(slices: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """Of each cell four times the root of its count, as 16 bits, and the mean count.

    The root of a count varies by a half, whatever the count, so equally rare
    cells differ by noise only and frequent ones stand out at any corpus size.
    """
    fields = [("slice", "int"), ("blob", "binary"), ("total", "long")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = zstandard.decompress(blob)
                n = len(data) // 6
                own = sums.setdefault(k, np.zeros(1 << SLICE_BITS, np.int64))
                own[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, "<u4", n, 2 * n)
        yield from emitted(((k, np.minimum(4 * np.sqrt(v), 65535).astype("<u2").tobytes(), int(v.sum())) for k, v in sums.items()), fields, 64)

    n_slices = 1 << (bits - SLICE_BITS)
    rows = stored(slices.repartition(min(n_slices, int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "slice").mapInArrow(run, schema_of(fields)), "cells")
    out, total = np.zeros((n_slices, 1 << SLICE_BITS), np.uint16), 0
    for r in rows.toLocalIterator():
        out[r.slice] = np.frombuffer(r.blob, "<u2")
        total += r.total
    return out.reshape(-1), total / (1 << bits)
