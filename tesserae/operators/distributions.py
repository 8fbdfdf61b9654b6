"""Sampled distances and exact histograms of invariants.

One plan serves any number of invariants: draws, one lookup a needed point,
distances as columns, one ``stack`` of tagged values, one aggregation. Slots no
invariant reads are never drawn or joined.

Points within the broadcast bound are looked up slot by slot. Larger tables are
met once: the ids of all slots become rows, join the points, and meet again by
tuple, so each coordinate array travels once. Points that hold a large share of
a measure would pile up in one task; those few are sent to all executors.
Points of many columns under a metric that adds up over columns are met block by
block of their columns (``blocks``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.invariants import Invariant, distance_columns, distance_name, named, pairs, values_of
from tesserae.functions.numeric import rounded
from tesserae.operators.blocks import block_distances, blockwise
from tesserae.operators.draws import checked, tuples
from tesserae.operators.progress import progress
from tesserae.operators.space import BROADCAST_BYTES, Space
from tesserae.operators.tiles import distance_tiles, pair_rows
from tesserae.sources import tables
from tesserae.sources.shared import stored

#: Rows of distances collected to the driver are refused beyond this.
MAX_BYTES = 4 << 30


def with_distances(space: Space, drawn: DataFrame, n: int, wanted: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Add the distance columns of ``wanted`` pairs (all by default) to tuples of ids."""
    wanted = list(wanted or pairs(n))
    if space.distances is not None:
        out = drawn
        for a, b in wanted:
            name = distance_name(a, b)
            own = space.lookup(space.distances.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("d").alias(name)), space.n_points**2, 32)
            out = out.join(own, (out[f"i{a}"] == own["_i"]) & (out[f"i{b}"] == own["_j"])).drop("_i", "_j")
        return out
    kernel = blockwise(space)
    if kernel and not drawn.isStreaming:
        return block_distances(space, drawn, wanted, kernel)
    used = sorted({k for p in wanted for k in p})
    out = drawn if space.small() else _gathered(space, drawn, used)
    for k in used if space.small() else ():
        own = space.lookup(space.points.select(F.col("pid").alias("_pid"), F.col("x").alias(f"_x{k}")))
        out = out.join(own, out[f"i{k}"] == own["_pid"]).drop("_pid")
    metric = space.metric
    return out.select(*drawn.columns, *(metric(F.col(f"_x{a}"), F.col(f"_x{b}")).alias(distance_name(a, b)) for a, b in wanted))


#: At most so many of the heaviest points are sent to all executors when the rest is shuffled.
HEAVY = 1024


def _gathered(space: Space, drawn: DataFrame, used: Sequence[int]) -> DataFrame:
    """``drawn`` with the coordinates of the slots ``used`` as ``_x<k>``, through one join of all slots."""
    slots = F.array(*(F.struct(F.lit(k).alias("_k"), F.col(f"i{k}").alias("_pid")) for k in used))
    asked = drawn.select("t", F.inline(slots))
    points = space.points.select(F.col("pid").alias("_pid"), F.col("x").alias("_x"))
    if space.weighted:
        most = max(1, min(HEAVY, BROADCAST_BYTES // space.point_bytes))
        heavy = F.broadcast(space.points.where(F.col("weight") * most >= F.lit(space.total)).select(F.col("pid").alias("_pid"), F.col("x").alias("_x")))
        met = asked.join(heavy, "_pid").unionByName(asked.join(F.broadcast(heavy.select("_pid")), "_pid", "left_anti").join(points, "_pid"))
    else:
        met = asked.join(points, "_pid")
    return drawn.join(met.groupBy("t").agg(*(F.first(F.when(F.col("_k") == k, F.col("_x")), ignorenulls=True).alias(f"_x{k}") for k in used)), "t")


def sample_tuples(space: Space, n: int, n_samples: int, seed: int = 0, mode: str = "xx", start: int = 0, partitions: int | None = None) -> DataFrame:
    """Tuples with all their distances: ``t, i0.., d01..``, lazily; arguments are checked at once."""
    n, n_samples = checked(n, n_samples)
    return with_distances(space, tuples(space, n, start, start + n_samples, seed, mode, partitions), n)


#: Tuples of a block of a written measure, which is a folder of its own.
MEASURE_BLOCK = 1 << 20


def curvature_measure(space: Space, n: int, n_samples: int, seed: int = 0, mode: str = "xx", decimals: int | None = None, out: str | None = None, block: int = MEASURE_BLOCK, overwrite: bool = False) -> DataFrame:
    """The empirical measure of distance rows: ``t, d01..``.

    With ``out`` it is written as one folder a ``block`` of consecutive tuples,
    each committed as a whole: a broken run goes on with the blocks that are
    missing, and ``measure_slice`` reads only the blocks it needs. A larger
    ``n_samples`` adds to what is there. Blocks tell nothing of the space, the
    seed or the mode: each of these needs an ``out`` of its own, or ``overwrite``.
    """
    n, n_samples = checked(n, n_samples)

    def rows(start: int, stop: int) -> DataFrame:
        own = with_distances(space, tuples(space, n, start, stop, seed, mode), n)
        return own.select("t", *(rounded(F.col(distance_name(*p)), decimals).alias(distance_name(*p)) for p in pairs(n)))

    if out is None:
        return rows(0, n_samples)
    for k in range(-(-n_samples // block)):
        stop = min((k + 1) * block, n_samples)
        tables.once(space.spark, f"{out}/block={k}/stop={stop}", lambda k=k, stop=stop: rows(k * block, stop), overwrite)
    return measure_slice(space.spark, out, 0, n_samples, block)


def measure_slice(spark: SparkSession, out: str, start: int, stop: int, block: int = MEASURE_BLOCK) -> DataFrame:
    """The tuples start <= t < stop of a written measure; the files of other blocks are not opened."""
    paths = []
    for k in range(start // block, -(-stop // block)):
        ends = [int(name.removeprefix("stop=")) for name in tables.children(spark, f"{out}/block={k}") if tables.finished(spark, f"{out}/block={k}/{name}")]
        if max(ends, default=0) < min(stop, (k + 1) * block):  # a block may have been written short, and then longer
            raise ValueError(f"block {k} of {out} is not written up to {min(stop, (k + 1) * block)}")
        paths.append(f"{out}/block={k}/stop={max(ends)}")
    return spark.read.parquet(*paths).where((F.col("t") >= start) & (F.col("t") < stop))


def collected(measure: DataFrame, n_samples: int, max_bytes: int | None = MAX_BYTES) -> list:
    """Rows of a curvature measure in the order of t, unless they take more than ``max_bytes``."""
    need = n_samples * 8 * (len(measure.columns) - 1)
    if max_bytes is not None and need > max_bytes:
        raise ValueError(f"{need / 2**30:.1f} GiB of rows exceed max_bytes = {max_bytes / 2**30:.1f} GiB; write them with out=, or take histograms")
    return measure.orderBy("t").collect()


def tagged_values(rows: DataFrame, found: list[tuple[str, object]], n: int, decimals: int | None = None) -> DataFrame:
    """One row a tuple and invariant: ``invariant, v0, v1, ...`` (missing values null)."""
    distances = distance_columns(n)
    values = {name: values_of(f, distances) for name, f in found}
    width = max(map(len, values.values()))
    # Values first, tags after: functions that run in Python can't stand inside a generator.
    names = {(name, k): f"_v{j}_{k}" for j, (name, own) in enumerate(values.items()) for k in range(len(own))}
    rows = rows.select(*(rounded(own[k].cast("double"), decimals).alias(names[name, k]) for name, own in values.items() for k in range(len(own))))

    def cell(name: str, k: int) -> F.Column:
        return F.col(names[name, k]) if (name, k) in names else F.lit(None).cast("double")

    if len(values) == 1:
        (name,) = values
        return rows.select(F.lit(name).alias("invariant"), *(cell(name, k).alias(f"v{k}") for k in range(width)))
    cells = [c for name in values for c in (F.lit(name), *(cell(name, k) for k in range(width)))]
    return rows.select(F.stack(F.lit(len(values)), *cells).alias("invariant", *(f"v{k}" for k in range(width))))


def histogram(values: DataFrame) -> DataFrame:
    """Distinct values and how often each occurs: all columns, and ``cnt``."""
    return values.groupBy(*values.columns).agg(F.count("*").alias("cnt"))


def row_histogram(rows: DataFrame, invariants: Invariant | Mapping[str, object] | Sequence[object], n: int, decimals: int | None = None) -> DataFrame:
    """Histograms of invariants over given distance rows ``d01, d02, ...`` of n points: ``invariant, v0, ..., cnt``."""
    return histogram(tagged_values(rows, named(invariants, n), n, decimals))


def distributions(space: Space, invariants: Invariant | Mapping[str, object] | Sequence[object], n: int, n_samples: int, seed: int = 0, mode: str = "xx", decimals: int | None = None, start: int = 0, partitions: int | None = None, report: bool = False) -> DataFrame:
    """Histograms of several invariants on one sample: ``invariant, v0[, v1..], cnt``.

    An invariant of k points reads the first k of each tuple. Plain functions
    of all distance columns count as invariants of n points. ``report``: compute
    at once, with progress on stderr.
    """
    n, n_samples = checked(n, n_samples)
    found = named(invariants, n)
    used = max(f.n if isinstance(f, Invariant) else n for _, f in found)
    drawn = tuples(space, n, start, start + n_samples, seed, mode, partitions, slots=used)
    with progress(space.spark, "tuples", report):
        out = histogram(tagged_values(with_distances(space, drawn, used), found, used, decimals))
        return stored(out, "histograms") if report else out


def distribution(space: Space, invariant: object, n: int, n_samples: int, **options: object) -> DataFrame:
    """Histogram of one invariant: ``v0[, v1..], cnt``."""
    return distributions(space, [invariant] if isinstance(invariant, Invariant) else {"f": invariant}, n, n_samples, **options).drop("invariant")


def ordered(histogram: DataFrame) -> DataFrame:
    """A histogram by invariant and value, pairs of values in lexicographic order."""
    return histogram.orderBy(*(c for c in histogram.columns if c == "invariant"), *(c for c in histogram.columns if c.startswith("v")))


def batch_histogram(rows: DataFrame, f: Callable[[np.ndarray], Mapping], n: int, width: int = 1, square: bool = False) -> DataFrame:
    """Histogram from a callback on batches of distance rows ``d01, d02, ...`` of n points: ``v0, .., cnt``.

    ``f`` gets an array of condensed rows (size, n (n - 1) / 2), or of symmetric
    matrices (size, n, n) if ``square``, and gives counts by value, values of
    ``width`` > 1 numbers as tuples. Counts of all batches are added up.
    """
    names = [distance_name(*p) for p in pairs(n)]
    fields = [f"v{k}" for k in range(width)]
    upper = np.triu_indices(n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(c).to_numpy() for c in names], axis=1)
            if square:
                whole = np.zeros((len(x), n, n))
                whole[:, upper[0], upper[1]] = whole[:, upper[1], upper[0]] = x
                x = whole
            found = f(x)
            keys = [k if isinstance(k, tuple) else (k,) for k in found]
            if any(len(k) != width for k in keys):
                raise TypeError(f"the callback must give values of {width} numbers")
            if sum(found.values()) != b.num_rows:
                raise ValueError("the callback must count each row once")
            yield pa.RecordBatch.from_arrays([*(pa.array([float(k[j]) for k in keys], pa.float64()) for j in range(width)), pa.array([int(c) for c in found.values()], pa.int64())], names=[*fields, "cnt"])

    parts = rows.select(*names).mapInArrow(run, ", ".join(f"{c} double" for c in fields) + ", cnt long")
    return parts.groupBy(*fields).agg(F.sum("cnt").cast("long").alias("cnt"))


def all_pairs(points: DataFrame, space: Space, n_points: int | None = None) -> DataFrame:
    """Distances ``i, j, d`` of all pairs i < j of a table of points, such as a subsample, from packed tiles (``tiles``)."""
    return pair_rows(distance_tiles(points, space, n_points))
