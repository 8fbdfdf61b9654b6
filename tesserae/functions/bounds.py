"""Sample sizes and accuracies of empirical measures in Wasserstein distance.

Driver-side numbers, with DataFrame forms where the formula is closed. The
dimension of the space of distance rows of n points is d = n (n - 1) / 2; the
empirical measure of N samples converges at the rate N^-e with e = 1/2 for
p >= d/2 and p/d below. ``statement`` texts name the published results.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.invariants import Invariant

INF = math.inf


def dimension(n: int) -> float:
    return n * (n - 1) / 2


def rate(n: int, p: float) -> float:
    d = dimension(n)
    return p / d if 2 * p < d else 0.5


def deviation(alpha: float) -> float:
    """Coefficient of N^-1/2 at confidence ``alpha``."""
    return math.sqrt(-math.log(1 - alpha) / 2)


# Covering numbers, needed by the constants for finite norms only.


def N_cover(x: float, d: float, m: float) -> float:  # noqa: N802
    """Covering number of the unit ball at radius x; for finite m an upper bound."""
    if m < INF:
        warnings.warn("for finite m this is an upper bound only", stacklevel=2)
    return math.ceil(1 / x) ** d


def K_cover(d: float, m: float) -> float:  # noqa: N802
    """Supremum over (0, 1] of x^d times the covering number.

    Just below 1/k the covering number is (k + 1)^d, so the product tends to
    ((k + 1) / k)^d there; this is largest for k = 1.
    """
    if m < INF:
        warnings.warn("for finite m this is an upper bound only", stacklevel=2)
    return 2.0**d


def _minimum(f: Callable[[float], float], low: float) -> float:
    """Minimum over (low, inf) of a function that falls and then rises: bracket, then golden sections."""
    step = low
    while f(low + 2 * step) < f(low + step) and step < 1e12:
        step *= 2
    a, b, ratio = low, low + 2 * step, (math.sqrt(5) - 1) / 2
    for _ in range(200):
        c, e = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, e) if f(c) < f(e) else (c, b)
    return f((a + b) / 2)


def kappa_1(d: float, p: float, m: float = INF) -> float:
    """Constant for p > d/2."""
    if m == INF:
        return 2 ** (d / 2 - 1) / (1 - 2 ** (d / 2 - p))
    root = math.sqrt(K_cover(d, m))
    return root * _minimum(lambda r: 2 ** (p - 1 - d / 2) * r ** (p + d / 2) / ((r - 1) ** p * (1 - r ** (d / 2 - p))), 2.0)


def kappa_2(N: float, d: float, p: float, m: float = INF) -> float:  # noqa: N803
    """Factor for p = d/2; it grows with the logarithm of N."""
    if m == INF:
        grown = max(math.log((2 ** (1 - p) - 2 ** (1 - 2 * p)) * math.sqrt(N)), 0.0)
        return 2 ** (p - 1) * (grown / (p * math.log(2)) + 1 / (1 - 2**-p))
    k = K_cover(d, m)

    def at(r: float) -> float:
        grown = max(math.log(2 ** (p + 1) * (r**-p - r ** (-2 * p)) * math.sqrt(N / k)), 0.0)
        return (r ** (2 * p) * grown / (p * math.log(r)) + r ** (3 * p) / (r**p - 1)) / (r - 1) ** p

    return math.sqrt(k) / 2 * _minimum(at, 2.0)


def kappa_3(d: float, p: float, m: float = INF) -> float:
    """Constant for p < d/2."""
    share = 1 - 2 * p / d
    if m == INF:
        return 2 ** (p * (1 - 2 / d)) * (1 - 2 ** (-d / 2)) ** share / (1 - 2 ** (p - d / 2))
    k = K_cover(d, m)
    return (k / 4) ** (p / d) * _minimum(lambda r: r ** (2 * p) * (1 - r ** (-d / 2)) ** share / ((r - 1) ** p * (1 - r ** (p - d / 2))), 2.0)


def fournier_constant(n: int, p: float, N: float | None = None) -> float:  # noqa: N803
    """Constant of the moment bound for n-tuples in units of the diameter.

    At the boundary p = n (n - 1) / 4 it depends on the sample count ``N``.
    """
    d = dimension(n)
    if 2 * p == d:
        if N is None:
            raise ValueError(f"at p = n (n - 1) / 4 = {p:g} the constant depends on the sample count; pass N")
        return kappa_2(N, d, p)
    return kappa_1(d, p) if 2 * p > d else kappa_3(d, p)


def wasserstein_moment_bound(N: float, n: int, p: float, D: float = 1, lip: float = 1) -> float:  # noqa: N803
    """Bound on the expected p-th power of the distance after N samples."""
    return fournier_constant(n, p, N) * (lip * D) ** p * N ** -rate(n, p)


def wasserstein_bound(N: float, alpha: float, n: int, p: float, D: float = 1, lip: float = 1, lam: float | None = None) -> float:  # noqa: N803
    """Bound on the distance after N samples, with probability ``alpha``."""
    spread = (lip if lam is None else lam) ** p * deviation(alpha) / math.sqrt(N)
    return D * (wasserstein_moment_bound(N, n, p, 1, lip) + spread) ** (1 / p)


def wasserstein_bound_md(N: float, alpha: float, n: int, p: float, D: float = 1, lip: float = 1, lam: float | None = None) -> float:  # noqa: N803
    """As ``wasserstein_bound``, with bounded differences of the distance itself; for comparison."""
    spread = (lip if lam is None else lam) * deviation(alpha) * N ** (1 / p - 0.5)
    return D * (wasserstein_moment_bound(N, n, p, 1, lip) ** (1 / p) + spread)


def _smallest(holds: Callable[[float], bool], method: str) -> int:
    """The smallest N >= 1 at which a bound holds that improves with N: bisection of log N, then of N."""
    low, high = 0.0, 1.0
    while not holds(10.0**high):
        low, high = high, 2 * high
        if high > 300:
            raise ValueError(f"the {method} bound never reaches this accuracy; use method='WB'")
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(10.0**mid) else (mid, high)
    # The float root fixes N up to its last digits; settle those in integers.
    n = max(1, math.ceil(10.0**high))
    down, up = 0, 1
    while n - up >= 1 and holds(float(n - up)):
        down, up = up, 2 * up
    while up - down > 1:
        mid = (up + down) // 2
        down, up = (mid, up) if n - mid >= 1 and holds(float(n - mid)) else (down, mid)
    return n - down


def sample_size(epsilon: float, alpha: float, n: int, p: float, lip: float = 1, lam: float | None = None, N: float | None = None, method: str = "WB") -> int:  # noqa: N803
    """Fewest n-tuples for accuracy ``epsilon`` (in diameters) with probability ``alpha``.

    ``method``: "WB" (concentration of the p-th power), "MD" (bounded
    differences; only for p > 2) or "Markov".
    """
    lam = lip if lam is None else lam
    if method not in ("WB", "MD", "Markov"):
        raise ValueError(f"unknown method {method!r}; use 'WB', 'MD' or 'Markov'")
    c, e, s = fournier_constant(n, p, N), rate(n, p), deviation(alpha)
    if method == "WB":
        return _smallest(lambda x: lip**p * c * x**-e + lam**p * s * x**-0.5 <= epsilon**p, "Weed-Bach")
    if method == "MD":
        warnings.warn("method 'MD' gives needlessly large sample sizes", stacklevel=2)
        if p <= 2:
            raise ValueError("the McDiarmid bound does not fall with N for p <= 2; use method='WB'")
        return _smallest(lambda x: lip * c ** (1 / p) * x ** (-e / p) + lam * s * x ** (1 / p - 0.5) <= epsilon, "McDiarmid")
    warnings.warn("method 'Markov' gives impractically large sample sizes", stacklevel=2)
    return math.ceil((c / (1 - alpha)) ** (1 / e) * (lip / epsilon) ** (p / e))


# Real-valued invariants: one dimension, whatever the tuple size.


def _line_constant(p: float) -> float:
    if p < 1:
        raise ValueError(f"the bound for real values needs p >= 1; got {p:g}")
    return 1 / (math.sqrt(2) - 2 ** (1 - p))


def wasserstein_moment_bound_real_valued(N: float, p: float, D: float = 1, lam: float = 1) -> float:  # noqa: N803
    return _line_constant(p) * (lam * D) ** p / math.sqrt(N)


def wasserstein_bound_real_valued(N: float, alpha: float, p: float, D: float = 1, lam: float = 1) -> float:  # noqa: N803
    return D * lam * ((_line_constant(p) + deviation(alpha)) / math.sqrt(N)) ** (1 / p)


def sample_size_real_valued(epsilon: float, alpha: float, p: float, lam: float = 1) -> int:
    return math.ceil(((_line_constant(p) + deviation(alpha)) * (lam / epsilon) ** p) ** 2)


@dataclass(frozen=True)
class Guarantee:
    """With probability ``alpha`` the distance is at most ``accuracy`` diameters, by ``statement``."""

    invariant: str
    accuracy: float
    statement: str
    n_samples: int
    alpha: float
    p: float


def guaranteed_accuracy(n_samples: int, invariants: Mapping[str, Invariant] | Iterable[Invariant], p: float, alpha: float = 0.999) -> dict[str, Guarantee]:
    """The sharpest accuracy of each invariant after ``n_samples`` tuples, in the order given."""
    n_samples = int(n_samples)
    if n_samples < 1:
        raise ValueError("n_samples must be at least 1")
    listed = list(invariants.items()) if isinstance(invariants, Mapping) else [(getattr(f, "name", None), f) for f in invariants]
    out: dict[str, Guarantee] = {}
    for name, f in listed:
        if not isinstance(f, Invariant):
            raise TypeError(f"{name or f!r} carries no constants; describe it as an Invariant")
        if name in out:
            raise ValueError(f"two invariants are named {name!r}")
        lam = min(f.lam, f.lip)
        bound, by = wasserstein_bound(n_samples, alpha, f.n, p, lip=f.lip, lam=lam), "Cor 6.3" if lam == f.lip else "Cor 6.5"
        if f.real_valued and (line := wasserstein_bound_real_valued(n_samples, alpha, p, lam=lam)) <= bound:
            bound, by = line, "Prop 6.6"
        out[name] = Guarantee(name, bound, by, n_samples, alpha, p)
    return out


def log10_sample_size(epsilon: float, alpha: float, n: int, p: float, lip: float = 1.0) -> float:
    """log10 of the real root of the sample-size equation with range constant 1; 0 if one sample is enough."""
    c, e, s = fournier_constant(n, p), rate(n, p), deviation(alpha)

    def excess(u: float) -> float:
        return lip**p * c * 10 ** (-e * u) + s * 10 ** (-u / 2) - epsilon**p

    low, high = 0.0, 400.0
    if excess(low) <= 0:
        return 0.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) <= 0 else (mid, high)
    return high


# DataFrame forms over parameter tables.


def deviation_column(alpha: Column) -> Column:
    return F.sqrt(-F.log(F.lit(1.0) - alpha) / F.lit(2.0))


def real_valued_columns(grid: DataFrame) -> DataFrame:
    """Add ``bound`` (for ``n_samples``) and ``n_needed`` (for ``epsilon``) by ``alpha, p, lam``."""
    constant = F.lit(1.0) / (F.sqrt(F.lit(2.0)) - F.pow(F.lit(2.0), F.lit(1.0) - F.col("p"))) + deviation_column(F.col("alpha"))
    bound = F.col("lam") * F.pow(constant / F.sqrt(F.col("n_samples").cast("double")), F.lit(1.0) / F.col("p"))
    needed = F.ceil(F.pow(constant * F.pow(F.col("lam") / F.col("epsilon"), F.col("p")), F.lit(2.0)))
    return grid.withColumn("bound", bound).withColumn("n_needed", needed.cast("long"))


def moment_columns(grid: DataFrame) -> DataFrame:
    """Add ``moment`` and ``bound`` by ``n_points, p, n_samples, alpha, lip, lam`` (not at the boundary p = d/2)."""
    n, p, lip, two = F.col("n_points").cast("double"), F.col("p"), F.col("lip"), F.lit(2.0)
    d = n * (n - 1) / two
    above = F.pow(two, d / 2 - 1) / (1 - F.pow(two, d / 2 - p))
    below = F.pow(two, p - two * p / d) * F.pow(1 - F.pow(two, -d / 2), 1 - two * p / d) / (1 - F.pow(two, p - d / 2))
    constant = F.when(p > d / 2, above).otherwise(below)
    e = F.when(p < d / 2, p / d).otherwise(0.5)
    samples = F.col("n_samples").cast("double")
    moment = F.pow(lip, p) * constant * F.pow(samples, -e)
    spread = F.pow(F.col("lam"), p) * deviation_column(F.col("alpha")) * F.pow(samples, F.lit(-0.5))
    return grid.withColumn("moment", moment).withColumn("bound", F.pow(moment + spread, 1 / p))


def guarantees(spark: SparkSession, n_samples: int, invariants: Mapping[str, Invariant] | Iterable[Invariant], p: float, alpha: float = 0.999) -> DataFrame:
    """``guaranteed_accuracy`` as a table."""
    rows = [(g.invariant, float(g.accuracy), g.statement, g.n_samples, float(g.alpha), float(g.p)) for g in guaranteed_accuracy(n_samples, invariants, p, alpha).values()]
    return spark.createDataFrame(rows, "invariant string, accuracy double, statement string, n_samples long, alpha double, p double")


def sample_sizes(grid: DataFrame, method: str = "WB") -> DataFrame:
    """Add ``n_needed`` by ``epsilon, alpha, n_points, p, lip, lam`` for a table of any length."""
    @F.pandas_udf(T.LongType())
    def solve(epsilon: pd.Series, alpha: pd.Series, n: pd.Series, p: pd.Series, lip: pd.Series, lam: pd.Series) -> pd.Series:
        return pd.Series([sample_size(*row, method=method) for row in zip(epsilon, alpha, n, p, lip, lam)], dtype="int64")

    return grid.withColumn("n_needed", solve("epsilon", "alpha", "n_points", "p", "lip", "lam"))
