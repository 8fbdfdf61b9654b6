"""Operations on histograms: tables of values and counts ``cnt``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.ordering import cumulated


def merge(*histograms: DataFrame, cnt: str = "cnt") -> DataFrame:
    """Counts of equal values added over histograms of the same columns."""
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    keys = [c for c in out.columns if c != cnt]
    return out.groupBy(*keys).agg(F.sum(cnt).cast("long").alias(cnt))


def with_total(df: DataFrame, column: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: the sum of ``column`` within ``by``, or of all rows, which then meet it as one broadcast number."""
    if by:
        return df.withColumn(name, F.sum(column).over(Window.partitionBy(*by)))
    return df.join(F.broadcast(df.agg(F.sum(column).alias(name))))


def pmf(histogram: DataFrame, by: Sequence[str] = (), cnt: str = "cnt") -> DataFrame:
    """Add ``prob``: the share of each value within ``by``."""
    return with_total(histogram, cnt, "_total", by).withColumn("prob", F.col(cnt) / F.col("_total")).drop("_total")


def _share(when: Column, cnt: Column, scale: float = 1.0) -> Column:
    return F.coalesce(F.sum(F.when(when, cnt)), F.lit(0)) * F.lit(float(scale)) / F.sum(cnt)


def distance_stats(histogram: DataFrame, by: Sequence[str] = (), tail: float = 200.0, v: str = "v0", cnt: str = "cnt") -> DataFrame:
    """Mean, variance over mean, maximum and parts per million above ``tail``."""
    w, x = F.col(cnt), F.col(v)
    mean = F.sum(x * w) / F.sum(w)
    square = F.sum(x * x * w) / F.sum(w)
    return histogram.groupBy(*by).agg(mean.alias("dist_mean"), ((square - mean * mean) / mean).alias("dist_var_over_mean"), F.max(x).alias("dist_max"), _share(x > tail, w, 1e6).alias("dist_tail_ppm"))


def deficit_stats(histogram: DataFrame, by: Sequence[str] = (), v: str = "v0", cnt: str = "cnt") -> DataFrame:
    """Share of zeros, mean, maximum and share of half integers."""
    w, x = F.col(cnt), F.col(v)
    return histogram.groupBy(*by).agg(_share(x == 0, w).alias("hyp_p_zero"), (F.sum(x * w) / F.sum(w)).alias("hyp_mean"), F.max(x).alias("hyp_max"), _share(x % 1 != 0, w).alias("hyp_half_share"))


def persistence_stats(histogram: DataFrame, by: Sequence[str] = (), birth: str = "v0", death: str = "v1", cnt: str = "cnt") -> DataFrame:
    """Statistics of the diagrams with a class: share, lifetimes, and the births' mode, mean and median.

    The mode is the birth of the most frequent cell, the least one of several.
    """
    w, b, life = F.col(cnt), F.col(birth), F.col(death) - F.col(birth)
    there = F.col(death) > F.col(birth)
    own = F.when(there, w)
    out = histogram.groupBy(*by).agg(
        _share(there, w, 1e6).alias("pers_nonzero_ppm"),
        (F.sum(F.when(there & (life == 1), w).otherwise(0)) / F.sum(own)).alias("pers_life_one_share"),
        F.max(F.when(there, life)).alias("pers_life_max"),
        F.min_by(b, F.when(there, F.struct(-w, b, life))).alias("pers_birth_mode"),
        (F.sum(F.when(there, b * w)) / F.sum(own)).alias("pers_birth_mean"),
    )
    middle = weighted_median(histogram.where(there), by, birth, cnt).withColumnRenamed("median", "pers_birth_median")
    return out.join(middle, list(by), "left") if by else out.join(F.broadcast(middle), how="left")


def weighted_median(histogram: DataFrame, by: Sequence[str] = (), v: str = "v0", cnt: str = "cnt") -> DataFrame:
    """The first value at which the cumulative count reaches half the total: ``median``."""
    per = histogram.groupBy(*by, v).agg(F.sum(cnt).alias("_c"))
    cum = with_total(cumulated(per, by, v, F.col("_c"), "_s"), "_c", "_t", by)
    return cum.groupBy(*by).agg(F.min(F.when(F.col("_s") * 2 >= F.col("_t"), F.col(v))).alias("median"))


def density_thresholds(cells: DataFrame, masses: Sequence[float], density: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """For each mass, the density level whose cells and all denser ones first hold that share: ``mass, threshold``."""
    if not all(0 < m < 1 for m in masses):
        raise ValueError("masses must lie in (0, 1)")
    per = cells.where((F.col(density) > 0) & ~F.isnan(F.col(density).cast("double"))).groupBy(*by, F.col(density).alias("_d")).agg((F.count("*") * F.first(F.col(density))).alias("_m"))
    cum = with_total(cumulated(per, by, "_d", F.col("_m"), "_s", descending=True), "_m", "_t", by).withColumn("_cum", F.col("_s") / F.col("_t"))
    # Rows of a group are aggregated at once: the level of each mass, or the least there is.
    levels = [F.coalesce(F.max(F.when(F.col("_cum") >= F.lit(float(m)), F.col("_d"))), F.min("_d")).alias(f"_m{k}") for k, m in enumerate(masses)]
    rows = cum.groupBy(*by).agg(*levels)
    pairs = F.array(*(F.struct(F.lit(float(m)).alias("mass"), F.col(f"_m{k}").alias("threshold")) for k, m in enumerate(masses)))
    return rows.select(*by, F.inline(pairs)).where(F.col("threshold").isNotNull())


def kde_curve(histogram: DataFrame, bandwidth: float, resolution: int, v: str = "v0", cnt: str = "cnt", upper: float | None = None) -> DataFrame:
    """Gaussian kernel density of a histogram on the grid 0, 1/resolution, ... up to the largest value: ``x, density``, of trapezoid area 1."""
    spark = histogram.sparkSession
    if upper is None:
        upper = histogram.agg(F.max(v)).first()[0]
        if upper is None:
            return spark.createDataFrame([], "x double, density double")
    n = max(math.ceil(upper * resolution) + 1, 2)
    grid = spark.range(n).select((F.col("id") * F.lit(upper / (n - 1))).alias("x"), F.when(F.col("id").isin(0, n - 1), 0.5).otherwise(1.0).alias("_end"))
    support = histogram.groupBy(F.col(v).alias("_v")).agg(F.sum(cnt).alias("_w"))
    z = (F.col("x") - F.col("_v")) / F.lit(float(bandwidth))
    raw = grid.crossJoin(support).groupBy("x", "_end").agg(F.sum(F.col("_w") * F.exp(-F.lit(0.5) * z * z)).alias("_d"))
    area = raw.agg((F.sum(F.col("_d") * F.col("_end")) * F.lit(upper / (n - 1))).alias("_area"))
    return raw.join(F.broadcast(area)).select("x", (F.col("_d") / F.col("_area")).alias("density"))


def support_mask(x: Column, y: Column, length: float, width: float | None = None) -> Column:
    """Where a class of Hamming quadruples can live: 0 < x <= length - 1 (or ``width``), 0 < y <= min(x, length - x)."""
    return (x > 0) & (x <= (length - 1 if width is None else width)) & (y > 0) & (y <= x) & (y <= length - x)


def density_grid(cells: DataFrame, length: int, ymax: int, samples: int, sigma: float = 0.0, width: int | None = None) -> DataFrame:
    """Share of samples by ``birth, lifetime``, Gaussian-smoothed, on the support: ``birth, lifetime, density``."""
    spark, right = cells.sparkSession, length if width is None else width
    mass = cells.where((F.col("lifetime") <= ymax) & (F.col("birth") <= right)).groupBy("birth", "lifetime").agg((F.sum("cnt") / F.lit(float(samples))).alias("m"))
    grid = spark.range(right + 1).select(F.col("id").alias("birth")).crossJoin(spark.range(ymax + 1).select(F.col("id").alias("lifetime")))
    if sigma > 0:
        reach = int(4 * sigma + 0.5)
        norm = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1))
        steps = F.sequence(F.lit(-reach), F.lit(reach))
        spread = mass.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
        weight = F.exp(F.lit(-0.5 / sigma**2) * (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))) / F.lit(norm * norm)
        mass = spread.groupBy((F.col("birth") + F.col("dx")).alias("birth"), (F.col("lifetime") + F.col("dy")).alias("lifetime")).agg(F.sum(F.col("m") * weight).alias("m"))
    on = support_mask(F.col("birth"), F.col("lifetime"), length, width)
    return grid.where(on).join(mass, ["birth", "lifetime"], "left").select("birth", "lifetime", F.coalesce("m", F.lit(0.0)).alias("density"))


def wasserstein1(a: DataFrame, b: DataFrame, v: str = "v0", cnt: str = "cnt") -> DataFrame:
    """Wasserstein distance of order 1 between two histograms on the line: one row ``w1``. An extension."""
    p, q = (pmf(h.select(F.col(v).alias("x"), F.col(cnt).alias("cnt"))) for h in (a, b))
    steps = p.select("x", F.col("prob").alias("d")).unionByName(q.select("x", (-F.col("prob")).alias("d"))).groupBy("x").agg(F.sum("d").alias("d"))
    steps = cumulated(steps, (), "x", F.col("d"), "gap", following="next")
    return steps.agg(F.coalesce(F.sum(F.abs("gap") * (F.col("next") - F.col("x"))), F.lit(0.0)).alias("w1"))


def integer_pmf(histogram: DataFrame, scale: float = 1.0, v: str = "v0", cnt: str = "cnt") -> DataFrame:
    """Shares by ``rint(scale * v)``: ``value, prob``."""
    per = histogram.groupBy(F.rint(F.col(v) * F.lit(float(scale))).cast("long").alias("value")).agg(F.sum(cnt).alias("c"))
    return pmf(per, cnt="c").select("value", "prob")


def axis_limits(histogram: DataFrame, v: str = "v0", cnt: str = "cnt", pad: float = 0.7) -> DataFrame:
    """Display limits: largest value, and the least positive share times ``pad``."""
    return pmf(histogram, cnt=cnt).where("prob > 0").agg(F.max(v).alias("xmax"), (F.min("prob") * F.lit(pad)).alias("ymin"), F.max("prob").alias("ymax"))
