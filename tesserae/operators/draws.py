"""Sequences of i.i.d. tuples of points, fixed by a seed.

Tuple t is a function of (seed, t) alone: the first M tuples of N are the M
tuples, whatever the number of partitions. Three generators:

``xx``   64-bit hashes of (seed, t, slot);
``md5``  15 hex digits of md5("seed:t:block") a slot, two slots a block, which any
         SQL engine can repeat;
``numpy``  blocks of 1,024 tuples from NumPy's generator, seeded by the block's
         child seed, on Arrow batches.

The hashed generators give words of 60 bits. A word is reduced to [0, total)
by its remainder, after words beyond the largest multiple of the total were
drawn anew (``TRIES`` words in all), so shares are off by at most
(total / 2^60)^TRIES: nothing to be seen at any total below 2^50.

Weighted draws invert the cumulative weights. The interval [lo, hi) of each
point is cut at bucket borders, so the lookup is an equality join with a
residual range instead of a nested loop. There are about as many buckets as
points, so a draw meets two intervals on average, whatever the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.ordering import running_total
from tesserae.operators.space import BROADCAST_BYTES, Space
from tesserae.sources.shared import stored

BLOCK_SIZE = 1024
#: Hashed words are uniform on [0, 2^WORD_BITS).
WORD_BITS, TRIES = 60, 3
WORD = 1 << WORD_BITS
MODES = ("xx", "md5", "numpy")


def checked(n: int, n_samples: int) -> tuple[int, int]:
    if int(n) < 2:
        raise ValueError("a tuple needs at least n = 2 points")
    if int(n_samples) < 1:
        raise ValueError("n_samples must be at least 1")
    return int(n), int(n_samples)


def words(seed: int, n: int, mode: str, again: int = 0) -> list[Column]:
    """n columns of uniform integers in [0, 2^60) of the tuple number ``t``; ``again``: of the further tries."""
    if mode == "xx":
        more = [F.lit(again)] if again else []
        return [F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.col("t"), F.lit(k), *more), 64 - WORD_BITS) for k in range(n)]
    return [hex_word(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("t").cast("string"), F.lit(str(k // 2)), *([F.lit(str(again))] if again else []))), k % 2) for k in range(n)]


def hex_word(digest: Column, half: int = 0) -> Column:
    """60 bits of a hexadecimal md5 digest: the first 15 digits of one of its halves."""
    return F.conv(F.substring(digest, 16 * half + 1, WORD_BITS // 4), 16, 10).cast("long")


def uniform_words(seed: int, n: int, mode: str, total: int) -> list[Column]:
    """n columns of uniform integers in [0, total)."""
    if not 0 < total <= WORD:
        raise ValueError(f"totals must be positive and at most 2^{WORD_BITS}; got {total}")
    limit, out = WORD - WORD % total, words(seed, n, mode, TRIES - 1)
    if limit == WORD:
        out = words(seed, n, mode)
    else:
        for again in range(TRIES - 2, -1, -1):
            out = [F.when(w < F.lit(limit), w).otherwise(o) for w, o in zip(words(seed, n, mode, again), out)]
    return [w % F.lit(total) for w in out]


def register_draws(spark: SparkSession) -> None:
    """SQL functions ``draw_xx`` and ``draw_md5`` of (seed, t, slot, size): the ids that ``tuples`` draws uniformly.

    They are expressions, inlined by the planner: ``SELECT id AS t, draw_xx(7, id,
    0, 500) AS i0 FROM range(100, 200)`` makes tuples 100 to 199, and slots that a
    query doesn't read are never computed.
    """

    def words_of(again: int) -> dict[str, str]:
        more = f", {again}" if again else ""
        digest = "md5(concat_ws(':', string(seed), string(t), string(slot div 2)" + (f", '{again}'" if again else "") + "))"
        return {"xx": f"shiftrightunsigned(xxhash64(seed, t, slot{more}), {64 - WORD_BITS})", "md5": f"bigint(conv(substr({digest}, 16 * (slot % 2) + 1, {WORD_BITS // 4}), 16, 10))"}

    tries = [words_of(k) for k in range(TRIES)]
    for mode in ("xx", "md5"):
        limit = f"{WORD} - {WORD} % size"
        cases = " ".join(f"WHEN {w[mode]} < {limit} THEN {w[mode]}" for w in tries[:-1])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION draw_{mode}(seed BIGINT, t BIGINT, slot INT, size BIGINT) RETURNS BIGINT RETURN (CASE {cases} ELSE {tries[-1][mode]} END) % size")


def unit_words(seed: int, n: int, mode: str) -> list[Column]:
    """n columns of uniform multiples of 2^-53 in [0, 1)."""
    return [F.shiftright(w, WORD_BITS - 53) / F.lit(float(1 << 53)) for w in words(seed, n, mode)]


def _numbers(space: Space, start: int, stop: int, partitions: int | None) -> DataFrame:
    return space.spark.range(start, stop, 1, partitions or max(1, space.spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "t")


def n_buckets(n_points: int) -> int:
    """A power of two, at least the number of points."""
    return 1 << max(n_points - 1, 1).bit_length()


def intervals(space: Space, buckets: int | None = None) -> tuple[DataFrame, float | int, bool, int]:
    """Cumulative intervals ``pid, lo, hi, bucket`` of positive weights, their total, whether they are integers, and the number of buckets.

    Integer weights give integer intervals of [0, total); others parts of [0, 1),
    the last of which ends at 1. They are written once, for all slots and queries.
    """
    if space.cut:
        return space.cut[0]
    buckets = buckets or n_buckets(space.n_points)
    whole = space.points.schema["weight"].dataType.typeName() in ("byte", "short", "integer", "long")
    w = F.col("weight").cast("long" if whole else "double")
    rows = running_total(space.points.select("pid", w.alias("w")), "pid", F.col("w"), "lo").where("w > 0")
    rows, total = rows.withColumn("hi", F.col("lo") + F.col("w")), space.total
    if whole:
        width = max(1, -(-int(total) // buckets))
        rows = rows.withColumn("bucket", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    else:
        rows = rows.withColumns({"lo": F.col("lo") / F.lit(float(total)), "hi": F.when(F.col("pid") == space.last, F.lit(1.0)).otherwise(F.col("hi") / F.lit(float(total)))})
        rows = rows.withColumn("bucket", F.explode(F.sequence(F.least(F.floor(F.col("lo") * buckets), F.lit(buckets - 1)), F.least(F.floor(F.col("hi") * buckets), F.lit(buckets - 1)))))
    space.cut.append((stored(rows.select("pid", "lo", "hi", "bucket"), "intervals"), total, whole, buckets))
    return space.cut[0]


def tuples(space: Space, n: int, start: int, stop: int, seed: int = 0, mode: str = "xx", partitions: int | None = None, slots: int | None = None) -> DataFrame:
    """Tuples ``start <= t < stop``: columns ``t, i0, ..., i{n-1}``.

    ``slots``: make only the first so many columns.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; use one of {', '.join(MODES)}")
    if start < 0 or stop < start:
        raise ValueError("need 0 <= start <= stop")
    used = slots or n
    if mode == "numpy" and not space.weighted:
        return _numpy_draws(space, n, start, stop, seed, partitions).select("t", *(F.col(f"u{k}").alias(f"i{k}") for k in range(used)))
    if not space.weighted:
        drawn = _numbers(space, start, stop, partitions)
        return drawn.select("t", *(w.alias(f"i{k}") for k, w in enumerate(uniform_words(seed, used, mode, space.n_points))))
    table, total, whole, buckets = intervals(space)
    if mode == "numpy":
        drawn = _numpy_draws(space, n, start, stop, seed, partitions)
        at = [F.floor(F.col(f"u{k}") * F.lit(float(total))) if whole else F.col(f"u{k}") for k in range(used)]
    else:
        drawn = _numbers(space, start, stop, partitions)
        at = uniform_words(seed, used, mode, int(total)) if whole else unit_words(seed, used, mode)
    drawn = drawn.select("t", *(a.alias(f"_u{k}") for k, a in enumerate(at)))
    width = max(1, -(-int(total) // buckets)) if whole else 0
    for k in range(used):
        u = F.col(f"_u{k}")
        bucket = F.expr(f"_u{k} div {width}") if whole else F.floor(u * buckets)
        own = space.lookup(table.select(F.col("pid").alias(f"i{k}"), "lo", "hi", "bucket"), space.n_points + buckets, 40)
        drawn = drawn.join(own, (bucket == own["bucket"]) & (u >= own["lo"]) & (u < own["hi"])).drop("lo", "hi", "bucket", f"_u{k}")
    return drawn.select("t", *(f"i{k}" for k in range(used)))


def _numpy_draws(space: Space, n: int, start: int, stop: int, seed: int, partitions: int | None) -> DataFrame:
    """``t, u0, ...``: ids for uniform measures, numbers in [0, 1) for weighted ones."""
    spark, size, weighted = space.spark, space.n_points, space.weighted
    names = ["t", *(f"u{k}" for k in range(n))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                rng = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(block,)))
                u = rng.random((BLOCK_SIZE, n)) if weighted else rng.integers(0, size, (BLOCK_SIZE, n))
                t = np.arange(block * BLOCK_SIZE, (block + 1) * BLOCK_SIZE)
                keep = (t >= start) & (t < stop)
                yield pa.RecordBatch.from_arrays([pa.array(t[keep]), *(pa.array(u[keep, k]) for k in range(n))], names=names)

    first, last = start // BLOCK_SIZE, -(-stop // BLOCK_SIZE)
    blocks = spark.range(first, max(last, first), 1, partitions or max(1, spark.sparkContext.defaultParallelism))
    return blocks.mapInArrow(run, "t long, " + ", ".join(f"{c} {'double' if weighted else 'long'}" for c in names[1:]))


def subsample(df: DataFrame, size: int, seed: int, key: str = "pid", pin: int | None = None) -> DataFrame:
    """``size`` rows without replacement by the order of hashes of their distinct ``key``; all if there are no more; ``pin`` is always in.

    Only keys are ordered; the rows then meet the chosen keys.
    """
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]
    if pin is not None:
        order.insert(0, F.col(key) != F.lit(pin))
    chosen = df.select(key).orderBy(*order).limit(size)
    return df.join(F.broadcast(chosen) if 64 * size <= BROADCAST_BYTES else chosen, key, "left_semi")


def sequences(spark, rho: list[float], length: int, samples: int, seed: int, mode: str = "md5") -> DataFrame:  # noqa: ANN001
    """``samples`` sequences of symbols 0, 1, ... drawn site by site from ``rho``: ``t, symbols``."""
    if abs(sum(rho) - 1) > 1e-9 or min(rho) < 0:
        raise ValueError("rho must be a probability vector")
    edges, total = [], 0.0
    for r in rho[:-1]:
        total += r
        edges.append(F.lit(total))
    t = spark.range(samples).withColumnRenamed("id", "t")

    def symbol(k: Column) -> Column:
        if mode == "xx":
            u = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), F.col("t"), k), 64 - WORD_BITS)
        else:
            u = hex_word(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("t").cast("string"), k.cast("string"))))
        return F.aggregate(F.array(*edges), F.lit(0), lambda s, e: s + F.when(u / F.lit(float(WORD)) >= e, 1).otherwise(0))

    return t.select("t", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), symbol).alias("symbols"))
