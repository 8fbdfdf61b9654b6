"""Metrics as column factories: ``metric(a, b)`` for the coordinates of two points.

A factory takes two columns that hold a point each (an array, a struct of
scalars or a string) and gives a DOUBLE column, so distances stay inside
whole-stage code. Python callables run as Arrow-batched functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Metric = Callable[[Column, Column], Column]
NAMES = ("euclidean", "hamming", "precomputed")
#: Every second bit of 64, as a signed integer.
_ODD_BITS = 0x5555555555555555


def euclidean(a: Column, b: Column) -> Column:
    """Square root of the summed squared differences of two arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def differs(x: Column, y: Column) -> Column:
    """1 if two symbols differ, else 0; NaN differs from everything, as in IEEE arithmetic."""
    return F.when((x != y) | F.isnan(x.cast("double")), 1).otherwise(0)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing entries of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v).cast("double")


def hamming_fields(names: Sequence[str]) -> Metric:
    """Hamming distance of structs over the fields ``names``: plain comparisons, all in generated code."""

    def metric(a: Column, b: Column) -> Column:
        total = F.lit(0)
        for n in names:
            total = total + F.when(a[n] != b[n], 1).otherwise(0)
        return total.cast("double")

    metric.kernel = "fields"
    return metric


def hamming_packed(a: Column, b: Column) -> Column:
    """Hamming distance of symbols packed by two bits into arrays of 64-bit integers."""

    def word(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(_ODD_BITS)))

    return F.aggregate(F.zip_with(a, b, word), F.lit(0), lambda s, v: s + v).cast("double")


def pack_symbols(seq: Column, alphabet: str = "ACGT") -> Column:
    """A string over at most four symbols as an array of 64-bit integers, 32 symbols each; the rest is zero."""

    def packed(codes: Column) -> Column:
        words = F.ceil(F.length(codes) / 32).cast("int")

        def word(k: Column) -> Column:
            part = F.rpad(F.substr(codes, k * 32 + 1, F.lit(32)), 32, "0")
            return F.aggregate(F.split(part, "(?<=.)(?=.)"), F.lit(0).cast("long"), lambda s, c: F.shiftleft(s, 2).bitwiseOR(c.cast("long")))

        return F.when(words > 0, F.transform(F.sequence(F.lit(0), words - 1), word)).otherwise(F.array().cast("array<bigint>"))

    # As the element of an array the string is computed once, not anew for each word.
    return F.element_at(F.transform(F.array(F.translate(seq, alphabet, "0123"[: len(alphabet)])), packed), 1)


def absolute_difference(a: Column, b: Column) -> Column:
    """|a - b| of two numbers."""
    return F.abs(a.cast("double") - b.cast("double"))


def manhattan(a: Column, b: Column) -> Column:
    """Summed absolute differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def from_python(func: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Metric:
    """A metric on corresponding rows of two 2-D arrays, run on Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def rows(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = np.stack(a.to_numpy()), np.stack(b.to_numpy())
        return pd.Series(np.asarray(func(x, y), np.float64))

    return lambda a, b: rows(a, b)


#: How blocks of points are compared at once (``kernels``).
euclidean.kernel, hamming.kernel, hamming_packed.kernel = "euclidean", "values", "packed"


def resolve(metric: str | Metric) -> Metric:
    """The factory of a name, or the factory itself."""
    if callable(metric):
        return metric
    try:
        return {"euclidean": euclidean, "hamming": hamming}[metric]
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}; use one of {', '.join(map(repr, NAMES))} or a function of two columns") from None
