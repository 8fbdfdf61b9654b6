"""Finite metric measure spaces as tables.

A space is a table of points with dense ids from 0, one column that holds the
coordinates (array, struct or scalar), an optional weight, and a metric. With
the metric "precomputed" a table of distances (i, j, d) takes the place of
coordinates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tesserae.functions.metrics import Metric, hamming_fields, resolve
from tesserae.sources.shared import stored

#: Points are sent to all executors up to this size, a shuffle join serves larger spaces.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Space:
    """``points``: ``pid`` (dense long), ``x`` (coordinates), and ``weight`` if ``weighted``.

    ``n_points`` is counted once. ``distances`` holds (i, j, d) rows for a
    precomputed metric.
    """

    points: DataFrame
    metric: Metric | str
    n_points: int
    weighted: bool = False
    distances: DataFrame | None = field(default=None, repr=False)
    point_bytes: int = 64
    #: Sum of the weights, and the last id with a positive one.
    total: int | float | None = None
    last: int | None = None
    #: The cumulative intervals of the weights, once some draw has made them.
    cut: list = field(default_factory=list, repr=False, compare=False)

    @property
    def spark(self):  # noqa: ANN201
        return self.points.sparkSession

    def small(self, rows: int | None = None, width: int | None = None) -> bool:
        """Whether a lookup table of this space is within the broadcast bound."""
        return (self.n_points if rows is None else rows) * (width or self.point_bytes) <= BROADCAST_BYTES

    def lookup(self, df: DataFrame, rows: int | None = None, width: int | None = None) -> DataFrame:
        """``df`` with a broadcast hint if its size is within the bound."""
        return F.broadcast(df) if self.small(rows, width) else df


def _width(points: DataFrame) -> Column:
    """Bytes of the widest point, about: its id, its coordinates and row overhead."""
    kind = points.schema["x"].dataType
    if kind.typeName() == "array":
        return F.lit(64) + 8 * F.coalesce(F.max(F.size("x")), F.lit(0))
    if kind.typeName() in ("string", "binary"):
        return F.lit(64) + F.coalesce(F.max(F.octet_length("x")), F.lit(0))
    return F.lit(64 + 24 * (len(kind.fields) if kind.typeName() == "struct" else 1))


def _counted(points: DataFrame, check: bool, weighted: bool) -> Row:
    """Row count ``n``, width ``w``, sum of weights ``total`` and last weighted id ``last``, in one pass, with the checks if asked for."""
    cells = [F.count("*").alias("n"), _width(points).alias("w")]
    if weighted:
        bad = F.count_if((F.col("weight") < 0) | F.col("weight").isNull())
        cells += [F.sum("weight").alias("total"), F.max(F.when(F.col("weight") > 0, F.col("pid"))).alias("last"), bad.alias("bad")]
    if check:
        cells += [F.min("pid").alias("lo"), F.max("pid").alias("hi"), F.count_distinct("pid").alias("u"), F.count_if(F.col("x").isNull()).alias("holes")]
    r = points.agg(*cells).first()
    if check:
        if weighted and (r.bad or not (r.total or 0) > 0):
            raise ValueError("weights must be nonnegative and not null, with a positive sum")
        if not r.n:
            raise ValueError("a space needs at least one point")
        if (r.lo, r.hi, r.u) != (0, r.n - 1, r.n):
            raise ValueError("point ids must be distinct and dense from 0")
        if r.holes:
            raise ValueError("coordinates must not be null")
    return r


def space(df: DataFrame, coords: str | Column | Sequence[str], metric: str | Metric, pid: str = "pid", weight: str | None = None, check: bool = True, n_points: int | None = None) -> Space:
    """A space over ``df``.

    ``coords``: a column, or names of scalar columns; several names with the
    metric "hamming" are compared field by field, with "euclidean" as an array.
    Weighted points are written to the shared folder once, since the checks,
    the intervals and every slot read them.
    """
    if isinstance(coords, (str, Column)):
        x = F.col(coords) if isinstance(coords, str) else coords
        if metric in ("euclidean", "hamming") and not df.select(x.alias("x")).schema[0].dataType.typeName() == "array":
            x = F.array(x)
        rule = resolve(metric)
    elif metric == "hamming":
        x, rule = F.struct(*(F.col(c).alias(c) for c in coords)), hamming_fields(list(coords))
    else:
        x, rule = F.array(*coords), resolve(metric)
    columns = [F.col(pid).cast("long").alias("pid"), x.alias("x")]
    if weight:
        columns.append(F.col(weight).alias("weight"))
    points = df.select(*columns)
    if weight:
        points = stored(points, "points")
    r = _counted(points, check, bool(weight))
    return Space(points, rule, n_points or r.n, bool(weight), point_bytes=r.w, total=r.total if weight else None, last=r.last if weight else None)


def precomputed(distances: DataFrame, weights: DataFrame | None = None) -> Space:
    """A space from rows ``i, j, d`` for all ordered pairs of dense ids; ``weights``: ``pid, weight``."""
    d = distances.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("d").cast("double").alias("d"))
    r = d.agg(F.count("*").alias("n"), F.count_distinct("i").alias("u"), F.count_distinct("j").alias("v"), F.max("i").alias("hi"), F.max("j").alias("hj")).first()
    if not r.n or r.n != r.u * r.u or (r.v, r.hi, r.hj) != (r.u, r.u - 1, r.u - 1):
        raise ValueError("precomputed distances must form a square matrix over dense ids")
    points = d.where("j = 0").select(F.col("i").alias("pid"), F.lit(0).alias("x"))
    if weights is None:
        return Space(points, "precomputed", r.u, False, d)
    points = stored(points.join(weights.select(F.col("pid").cast("long").alias("pid"), "weight"), "pid"), "points")
    w = _counted(points, True, True)
    return Space(points, "precomputed", r.u, True, d, total=w.total, last=w.last)
