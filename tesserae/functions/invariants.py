"""Invariants of n points as expressions over the condensed distances of a tuple.

Distances are the DOUBLE columns ``d01, d02, ..., d12, ...``: one column a pair,
so an invariant reads the pairs it needs and the rest is pruned.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Distances = Mapping[tuple[int, int], Column]


def pairs(n: int) -> list[tuple[int, int]]:
    """Pairs of n points in condensed order."""
    return list(itertools.combinations(range(n), 2))


def distance_name(a: int, b: int) -> str:
    return f"d{a}{b}" if b < 10 else f"d{a}_{b}"


def points_of(n_pairs: int) -> int:
    """How many points have ``n_pairs`` pairs."""
    n = (1 + math.isqrt(1 + 8 * n_pairs)) // 2
    if n < 2 or n * (n - 1) // 2 != n_pairs:
        raise ValueError(f"{n_pairs} is not the number of pairs of any number of points")
    return n


def distance_columns(n: int) -> dict[tuple[int, int], Column]:
    return {p: F.col(distance_name(*p)) for p in pairs(n)}


def pairwise_distance(d: Distances) -> tuple[Column, ...]:
    """Distance of the two points."""
    return (d[0, 1],)


def hyperbolicity_deficit(d: Distances) -> tuple[Column, ...]:
    """Half the gap between the largest and the middle one of the three opposite sums."""
    x, y, z = d[0, 1] + d[2, 3], d[0, 3] + d[1, 2], d[0, 2] + d[1, 3]
    middle = F.greatest(F.least(x, y), F.least(F.greatest(x, y), z))
    return ((F.greatest(x, y, z) - middle) / F.lit(2.0),)


def vr_persistence(n: int) -> Callable[[Distances], tuple[Column, ...]]:
    """Birth and death of the class of dimension (n - 2) / 2 of n points; (0, 0) if there is none."""
    if n < 2 or n % 2:
        raise ValueError(f"persistence needs an even number of points, at least 2; got {n}")

    def pair(d: Distances) -> tuple[Column, ...]:
        births, deaths = [], []
        for i in range(n):
            around = [d[min(i, j), max(i, j)] for j in range(n) if j != i]
            if n == 2:
                births.append(F.lit(0.0))
                deaths.append(around[0])
                continue
            # The two largest, by pairwise folding: no array is made.
            top, second = F.greatest(around[0], around[1]), F.least(around[0], around[1])
            for x in around[2:]:
                top, second = F.greatest(top, x), F.greatest(second, F.least(top, x))
            births.append(second)
            deaths.append(top)
        birth = F.greatest(*births) if len(births) > 1 else births[0]
        death = F.least(*deaths) if len(deaths) > 1 else deaths[0]
        there = birth < death
        return F.when(there, birth).otherwise(0.0), F.when(there, death).otherwise(0.0)

    return pair


def gromov_product(d: Distances) -> tuple[Column, ...]:
    """(d01 + d02 - d12) / 2 of three points: an extension."""
    return ((d[0, 1] + d[0, 2] - d[1, 2]) / F.lit(2.0),)


@dataclass(frozen=True)
class Invariant:
    """An invariant of ``n`` points with the constants its bounds need.

    ``func`` maps the distance columns of the first n points of a tuple to one
    value column, or to several. ``lip`` is its Lipschitz constant for the
    supremum norm on distances; ``lam`` bounds its range in diameters and is
    ``lip`` by default.
    """

    func: Callable[[Distances], tuple[Column, ...]]
    n: int
    lip: float = 1.0
    lam: float | None = None
    real_valued: bool = False
    name: str = field(default="")

    def __post_init__(self) -> None:
        if int(self.n) != self.n or self.n < 2:
            raise ValueError(f"n must be an integer of at least 2; got {self.n}")
        if self.lam is None:
            object.__setattr__(self, "lam", self.lip)
        for label, value in (("lip", self.lip), ("lam", self.lam)):
            if not value > 0:
                raise ValueError(f"{label} must be positive; got {value}")
        if not self.name:
            object.__setattr__(self, "name", self.func.__name__)

    def values(self, distances: Distances) -> tuple[Column, ...]:
        """Value columns on the first n points of tuples that have at least n."""
        there = 1 + max(b for _, b in distances)
        if there < self.n:
            raise ValueError(f"{self.name} needs tuples of at least {self.n} points; got {there}")
        out = self.func({p: c for p, c in distances.items() if p[1] < self.n})
        return out if isinstance(out, tuple) else (out,)


PAIRWISE_DISTANCE = Invariant(pairwise_distance, 2, 1.0, 1.0, True, "pairwise_distance")
HYPERBOLICITY_DEFICIT = Invariant(hyperbolicity_deficit, 4, 2.0, 1.0, True, "hyperbolicity_deficit")
VR_PERSISTENCE_4_1 = Invariant(vr_persistence(4), 4, 1.0, 1.0, False, "vr_persistence_4_1")
NAMED = {f.name: f for f in (PAIRWISE_DISTANCE, HYPERBOLICITY_DEFICIT, VR_PERSISTENCE_4_1)}


def named(invariants: Invariant | Mapping[str, object] | Sequence[object], n: int) -> list[tuple[str, object]]:
    """Names and invariants in the order given, checked against tuples of n points."""
    if callable(invariants) and not isinstance(invariants, Invariant):
        raise TypeError("pass invariants as a mapping of names or as a list")
    if isinstance(invariants, Invariant):
        invariants = [invariants]
    found = list(invariants.items()) if isinstance(invariants, Mapping) else [(getattr(f, "name", getattr(f, "__name__", repr(f))), f) for f in invariants]
    names = [k for k, _ in found]
    if len(set(names)) < len(names):
        raise ValueError(f"invariants need distinct names; got {names}")
    for name, f in found:
        if isinstance(f, Invariant) and f.n > n:
            raise ValueError(f"{name} needs tuples of {f.n} points, but the sample has n = {n}")
    return found


def from_numpy(func: Callable[[np.ndarray], np.ndarray], width: int | None = None) -> Callable[[Distances], tuple[Column, ...]]:
    """An invariant given by a function of condensed rows: an array (size, pairs) to one (size,) or (size, k), on Arrow batches.

    ``width`` is k; by default the function is asked for it with two rows of ones.
    """

    def shaped(x: np.ndarray, k: int | None) -> np.ndarray:
        out = np.asarray(func(x))
        if out.ndim not in (1, 2) or len(out) != len(x) or k is not None and (1 if out.ndim == 1 else out.shape[1]) != k:
            raise TypeError(f"the function must give {k or 'a fixed number of'} values a row; {len(x)} rows gave the shape {out.shape}")
        return out.astype(np.float64).reshape(len(x), -1)

    def values(d: Distances) -> tuple[Column, ...]:
        k = width or shaped(np.ones((2, len(d))), None).shape[1]

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rows(x: pd.Series) -> pd.Series:
            return pd.Series(list(shaped(np.stack(x.to_numpy()), k)) if len(x) else [], dtype=object)

        found = rows(F.array(*d.values()))
        return tuple(F.get(found, F.lit(j)) for j in range(k))

    values.__name__ = getattr(func, "__name__", "f")
    return values


def values_of(f: object, distances: Distances) -> tuple[Column, ...]:
    """Values of an ``Invariant``, of a function of all distance columns, or of a NumPy function of condensed rows."""
    if isinstance(f, Invariant):
        return _columns(f.values(distances))
    try:
        return _columns(f(distances))
    except Exception as first:  # not a function of columns: NumPy functions raise all kinds of errors on them
        try:
            return _columns(from_numpy(f)(distances))
        except Exception:
            raise TypeError("an invariant must give columns from the distance columns, or values from an array of distance rows") from first


def _columns(out: object) -> tuple[Column, ...]:
    out = out if isinstance(out, tuple) else (out,)
    if not out or not all(isinstance(c, Column) for c in out):
        raise TypeError("an invariant must give a column, or a tuple of columns")
    return out


def as_square(distances: Distances) -> Column:
    """The symmetric matrix of a tuple's distances, with a zero diagonal, as an array of arrays."""
    n = 1 + max(b for _, b in distances)
    return F.array(*(F.array(*(F.lit(0.0) if i == j else distances[min(i, j), max(i, j)] for j in range(n))) for i in range(n)))
