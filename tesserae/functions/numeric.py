"""Small numeric helpers shared by the expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(value: Column, decimals: int | None) -> Column:
    """Half-even rounding by scaling, as NumPy rounds; ``None`` leaves the value."""
    if decimals is None:
        return value
    scale = F.lit(float(10**decimals))
    return F.rint(value * scale) / scale


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def normal_cdf_column(x: pd.Series) -> pd.Series:
    """The standard normal distribution function; Spark has no ``erf``."""
    return x.map(normal_cdf)
