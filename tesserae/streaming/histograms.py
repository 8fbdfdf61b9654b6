"""Streamed forms of the batch operators: an extension.

A stream of tuple numbers runs through the same draws, lookups and values as a
batch; after M numbers its histogram is that of the first M tuples. Events give
windowed histograms with a watermark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.invariants import Invariant, named
from tesserae.operators.distributions import histogram, tagged_values, with_distances
from tesserae.operators.draws import uniform_words
from tesserae.operators.space import Space


def streamed_distributions(numbers: DataFrame, space: Space, invariants: Mapping[str, object] | Sequence[object], n: int, seed: int = 0, decimals: int | None = None) -> DataFrame:
    """Running histograms over a stream of numbers ``t``, for output mode "complete" (uniform measures)."""
    if space.weighted:
        raise ValueError("streamed draws are uniform")
    found = named(invariants, n)
    used = max(f.n if isinstance(f, Invariant) else n for _, f in found)
    drawn = numbers.select(F.col("t").cast("long").alias("t")).select("t", *(w.alias(f"i{k}") for k, w in enumerate(uniform_words(seed, used, "xx", space.n_points))))
    return histogram(tagged_values(with_distances(space, drawn, used), found, used, decimals))


def windowed_histogram(events: DataFrame, value: str, time: str = "ts", window: str = "1 hour", watermark: str = "10 minutes", decimals: int = 0) -> DataFrame:
    """Counts of rounded values by window of event time; rows later than the watermark are dropped."""
    scale = F.lit(float(10**decimals))
    late = events.withWatermark(time, watermark)
    return late.groupBy(F.window(time, window).alias("window"), (F.rint(F.col(value) * scale) / scale).alias("v0")).agg(F.count("*").alias("cnt"))
