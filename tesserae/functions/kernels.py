"""Distances of many points at once, as NumPy arrays inside Arrow batches.

A metric names its kernel in the attribute ``kernel``. ``rows`` gives the exact
integer distances of corresponding points, which add up over blocks of columns;
``tile`` those of all pairs of two blocks of points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

#: Every second bit of 64.
_ODD = np.int64(0x5555555555555555)
#: Words of packed symbols at most that are spread to bit planes at a time: 96 products of each sum to less than half of ``_TWO``.
_WORDS, _TWO = 21, np.float32(4096)
#: Symbols at most whose numbers of agreement are counted three in one product, and columns at a time.
_COUNTED, _COLUMNS = 255, 256
#: Rows of a tile that are computed at a time.
_ROWS = 8
#: Squared distances below so much of the largest squared norms are computed from differences, so many pairs at a time.
_CLOSE, _PAIRS = 1e-6, 4096


def packed_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing symbols of two bits in corresponding rows of words."""
    d = a ^ b
    d |= d >> 1
    d &= _ODD
    return np.bitwise_count(d).sum(1, dtype=np.int64)


def value_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.count_nonzero(a != b, axis=1)


def _planes(words: np.ndarray) -> np.ndarray:
    """Both bits of each symbol and their product, as +1 and -1."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    high, low = bits[:, 0::2], bits[:, 1::2]
    return np.concatenate([high, low, high * low], 1)


def packed_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing symbols of all pairs: of two symbols, the products of the three planes sum to 3 if they agree and to -1 if not.

    Two rows of ``a`` go through one product, the second times 4096: their sums
    are whole, below 2048 and so told apart, and the whole is exact below 2^24.
    """
    half, width = -(-len(a) // 2), a.shape[1]
    kind = np.float32 if 96 * width < 1 << 24 else np.float64
    agree = np.zeros((2 * half, len(b)), kind)
    step = max(1, -(-width // max(1, -(-width // _WORDS))))
    for k in range(0, width, step):
        planes = _planes(a[:, k : k + step])
        both = planes[:half].copy()
        both[: len(a) - half] += _TWO * planes[half:]
        sums = both @ _planes(b[:, k : k + step]).T
        second = np.rint(sums / _TWO)
        agree[half:] += second
        sums -= _TWO * second
        agree[:half] += sums
    return (3 * 32 * width - agree[: len(a)]) / 4


def _symbols(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low bits of packed symbols, as 0 and 1."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
    return bits[:, 0::2], bits[:, 1::2]


def _cuts(symbols: int) -> list[slice]:
    """Even pieces of at most ``_COUNTED`` symbols."""
    edges = np.linspace(0, symbols, -(-symbols // _COUNTED) + 1).astype(int).tolist()
    return [slice(s, e) for s, e in zip(edges, edges[1:])]


def packed_ready(a: np.ndarray) -> tuple[int, int, list[np.ndarray]]:
    """Rows for ``packed_columns``, three in one number: how many they are, their symbols, and a matrix a piece of the symbols.

    Of symbols 0 to 2 a row has the unit vectors, of 3 a vector of -1: its product
    with the columns' unit vectors (of 3: none), and 1 for each 3 of the row, is the
    number of symbols that agree.
    """
    third = -(-len(a) // 3)
    high, low = (v.view(np.int8) for v in _symbols(a))
    last = high & low
    planes = [v - last for v in ((high ^ 1) & (low ^ 1), (high ^ 1) & low, high & (low ^ 1))]
    out = []
    for cut in _cuts(high.shape[1]):
        own = np.concatenate([*(p[:, cut] for p in planes), last[:, cut].sum(1, dtype=np.int16)[:, None]], 1)
        rows = np.zeros((third, own.shape[1]), np.float32)
        for k in range(3):
            part = own[k * third : (k + 1) * third]
            rows[: len(part)] += np.float32(256**k) * part
        out.append(rows)
    return len(a), high.shape[1], out


def packed_columns(b: np.ndarray) -> Callable[[tuple[int, int, list[np.ndarray]]], np.ndarray]:
    """Gives differing symbols of all pairs of some rows (from ``packed_ready``) and ``b``.

    Three numbers of agreeing symbols below 256 come out of a product as one
    below 2^24, in which single precision is exact.
    """
    high, low = _symbols(b)
    planes, one = ((high ^ 1) & (low ^ 1), (high ^ 1) & low, high & (low ^ 1)), np.ones((len(b), 1), np.uint8)
    columns = [np.concatenate([*(p[:, cut] for p in planes), one], 1).astype(np.float32) for cut in _cuts(high.shape[1])]

    def run(ready: tuple[int, int, list[np.ndarray]]) -> np.ndarray:
        n, symbols, rows = ready
        third = -(-n // 3)
        out = np.empty((3 * third, len(b)), np.uint16)
        for c in range(0, len(b), _COLUMNS):  # some columns at a time, which stay in the processor's cache
            at = slice(c, min(c + _COLUMNS, len(b)))
            product = np.empty((third, at.stop - c), np.float32)
            whole, part, outer, middle = np.zeros((4, *product.shape), np.int32)
            for r, g in zip(rows, columns):
                np.matmul(r, g[at].T, out=product)
                np.copyto(whole, product, casting="unsafe")
                outer += np.bitwise_and(whole, 0xFF00FF, out=part)
                np.right_shift(whole, 8, out=whole)
                middle += np.bitwise_and(whole, 0xFF, out=part)
            np.subtract(symbols, outer & 0xFFFF, out=out[:third, at], casting="unsafe")
            np.subtract(symbols, middle, out=out[third : 2 * third, at], casting="unsafe")
            np.subtract(symbols, outer >> 16, out=out[2 * third :, at], casting="unsafe")
        return out[:n]

    return run


def value_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        out += a[:, k, None] != b[None, :, k]
    return out


def field_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of codes from ``Codes``: a null (0) differs from nothing."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        x, y = a[:, k, None], b[None, :, k]
        out += (x != y) & (x > 0) & (y > 0)
    return out


def euclidean_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares are added column by column, as the column expression does; some rows at a time, which stay in the processor's cache."""
    a, b = a.astype(np.float64), np.ascontiguousarray(b.T, np.float64)
    out, space = np.zeros((len(a), b.shape[1])), np.empty((_ROWS, b.shape[1]))
    for s in range(0, len(a), _ROWS):
        own = out[s : s + _ROWS]
        d = space[: len(own)]
        for k in range(len(b)):
            np.subtract(a[s : s + _ROWS, k, None], b[k], out=d)
            np.multiply(d, d, out=d)
            np.add(own, d, out=own)
    return np.sqrt(out, out=out)


def euclidean_again(b: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Gives the same distances of some points to ``b`` through one matrix product, to about ten digits: those that are small beside the largest norms are computed from differences."""
    b = np.asarray(b, np.float64)
    centre = b.mean(0) if len(b) else 0.0
    y = b - centre
    n = np.einsum("ij,ij->i", y, y)[:, None]
    right = np.ascontiguousarray(np.concatenate([y, np.ones_like(n), n], 1).T)

    def run(a: np.ndarray) -> np.ndarray:
        a = np.asarray(a, np.float64)
        x = a - centre
        m = np.einsum("ij,ij->i", x, x)[:, None]
        out = np.concatenate([-2 * x, m, np.ones_like(m)], 1) @ right
        near = _CLOSE * (m.max(initial=0) + n.max(initial=0))
        i, j = np.nonzero(out <= near) if out.min(initial=np.inf) <= near else ((), ())
        for s in range(0, len(i), _PAIRS):
            u, v = i[s : s + _PAIRS], j[s : s + _PAIRS]
            d = a[u] - b[v]
            out[u, v] = np.einsum("ij,ij->i", d, d)
        return np.sqrt(out, out=out)

    return run


@dataclass(frozen=True)
class Kernel:
    tile: Callable[[np.ndarray, np.ndarray], np.ndarray]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray] | None
    elements: tuple[str, ...]
    #: Symbols of one element: the largest distance of two points is so many times their length.
    symbols: int | None = 1
    #: For columns, distances of rows to them at so small a price that passes make them again instead of keeping them.
    again: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]] | None = None
    #: Rows and columns made ready once for many tiles, of points that are not too wide: ``columns(b)(ready(a))`` is ``tile(a, b)``.
    ready: Callable[[np.ndarray], Any] | None = None
    columns: Callable[[np.ndarray], Callable[[Any], np.ndarray]] | None = None

    def code(self, width: int) -> str:
        """The smallest number type that holds every distance of points of ``width`` elements."""
        if self.symbols is None:
            return "<f8"
        return "<u2" if width * self.symbols < 1 << 16 else "<u4"


_WHOLE = ("byte", "short", "integer", "long")
KERNELS = {
    "packed": Kernel(packed_tile, packed_rows, ("long",), 32, None, packed_ready, packed_columns),
    "values": Kernel(value_tile, value_rows, _WHOLE),
    "fields": Kernel(field_tile, None, ("struct",)),
    "euclidean": Kernel(euclidean_tile, None, (*_WHOLE, "float", "double"), None, euclidean_again),
}


def kernel_of(metric: object, kind: T.DataType) -> Kernel | None:
    """The kernel of a metric on coordinates of a type, if it has one."""
    own = KERNELS.get(getattr(metric, "kernel", ""))
    if own is None:
        return None
    name = kind.elementType.typeName() if isinstance(kind, T.ArrayType) else kind.typeName()
    return own if name in own.elements else None


class Codes:
    """Coordinates of Arrow columns as matrices; values of struct fields get the same code within one task."""

    def __init__(self) -> None:
        self.seen: list[dict] = []

    def matrix(self, column: pa.Array) -> np.ndarray:
        if pa.types.is_struct(column.type):
            fields = column.flatten()
            self.seen = self.seen or [{} for _ in fields]
            return np.stack([self._codes(d, f) for d, f in zip(self.seen, fields)], 1) if fields else np.zeros((len(column), 0), np.int64)
        flat = column.flatten()
        if flat.null_count or column.null_count:
            raise ValueError("coordinates must not hold nulls")
        width = len(flat) // len(column) if len(column) else 0
        x = flat.to_numpy(zero_copy_only=False)
        if x.size != width * len(column) or len({*np.diff(column.offsets.to_numpy()).tolist()}) > 1:
            raise ValueError("points must have the same number of coordinates")
        return x.reshape(len(column), width)

    @staticmethod
    def _codes(seen: dict, values: pa.Array) -> np.ndarray:
        held = ["nan" if v != v else v for v in values.to_pylist()]
        return np.array([0 if v is None else seen.setdefault(v, len(seen) + 1) for v in held], np.int64)
