"""One-site laws of substitution models and the exact laws of product measures.

A layer is a row ``family, time, rho``: the law of a symbol at one site. Sites
are independent, so distances of sequences are sums over sites.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.invariants import distance_name, pairs, vr_persistence
from tesserae.functions.numeric import normal_cdf_column
from tesserae.operators.draws import WORD, hex_word


def jc_law(t: float, k: int, beta: float = 1.0, start: int = 0) -> list[float]:
    """Law after time t of a chain that changes to every other symbol at one rate."""
    decay = math.exp(-k * beta * t / (k - 1))
    return [(1 - decay) / k + (decay if s == start else 0.0) for s in range(k)]


def hb_factor(x: float) -> float:
    """x / (1 - e^-x), continued by 1 at 0."""
    return 1.0 if abs(x) < 1e-10 else x / -math.expm1(-x)


def hb_generator(k: int, beta: float, phi: Sequence[float]) -> np.ndarray:
    """Rates towards fitter symbols are raised, others lowered, over one base rate."""
    phi = np.asarray(phi, float)
    if k < 2 or beta <= 0 or phi.shape != (k,):
        raise ValueError("need at least two symbols, a positive rate, and a fitness for each symbol")
    q = np.array([[hb_factor(b - a) for b in phi] for a in phi]) * beta / (k - 1)
    np.fill_diagonal(q, 0.0)
    return q - np.diag(q.sum(1))


def _exponential(m: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling and squaring of the Taylor series."""
    halvings = max(0, math.ceil(math.log2(max(np.abs(m).sum(1).max(), 1e-300))) + 4)
    x, term, out = m / 2.0**halvings, np.eye(len(m)), np.eye(len(m))
    for k in range(1, 20):
        term = term @ x / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


def hb_law(t: float, k: int, beta: float, phi: Sequence[float], start: int = 0) -> list[float]:
    """Law after time t of the chain with fitness ``phi``."""
    row = np.maximum(_exponential(hb_generator(k, beta, phi) * t)[start], 0.0)
    return (row / row.sum()).tolist()


def hb_stationary(phi: Sequence[float]) -> list[float]:
    """Limit law, proportional to e^phi."""
    w = np.exp(np.asarray(phi, float) - max(phi))
    return (w / w.sum()).tolist()


def model_layers(spark: SparkSession, k: int = 4, beta: float = 1.0, times: Sequence[float] = (0.05, 0.1, 0.5, 1.0), phi: Sequence[float] = (0.0, 0.0, -10.0, -10.0)) -> DataFrame:
    """Layers of both families at the times and in the limit (time infinite)."""
    rows = [("JC", float(t), jc_law(t, k, beta)) for t in times] + [("JC", math.inf, [1.0 / k] * k)]
    rows += [("HB", float(t), hb_law(t, k, beta, phi)) for t in times] + [("HB", math.inf, hb_stationary(phi))]
    return spark.createDataFrame(rows, "family string, time double, rho array<double>")


def mismatch(layers: DataFrame) -> DataFrame:
    """Add ``p``: how likely two draws differ at a site."""
    return layers.withColumn("p", F.lit(1.0) - F.aggregate("rho", F.lit(0.0), lambda s, r: s + r * r))


def jc_mismatch(t: F.Column, k: int, beta: float = 1.0) -> F.Column:
    """The same for the one-rate chain, in closed form of the time."""
    return F.lit((k - 1) / k) * (F.lit(1.0) - F.exp(F.lit(-2.0 * k * beta / (k - 1)) * t))


def binomial_pmf(probabilities: DataFrame, length: int) -> DataFrame:
    """Law of the number of mismatches over ``length`` sites: the rows, ``value`` and ``prob``.

    Logarithms of factorials are a running sum; probabilities 0 and 1 are exact.
    """
    spark = probabilities.sparkSession
    logs = spark.range(length + 1).select(F.col("id").alias("value"), F.sum(F.log(F.greatest("id", F.lit(1)).cast("double"))).over(Window.orderBy("id")).alias("_lf"))
    total = math.fsum(math.log(i) for i in range(2, length + 1))
    flip = logs.select((F.lit(length) - F.col("value")).alias("value"), F.col("_lf").alias("_lr"))
    table = logs.join(flip, "value")
    v = F.col("value")
    log_p = F.lit(total) - F.col("_lf") - F.col("_lr") + v * F.log("p") + (F.lit(length) - v) * F.log(F.lit(1.0) - F.col("p"))
    prob = F.when(F.col("p") <= 0, F.when(v == 0, 1.0).otherwise(0.0)).when(F.col("p") >= 1, F.when(v == length, 1.0).otherwise(0.0)).otherwise(F.exp(log_p))
    return probabilities.join(F.broadcast(table)).withColumn("prob", prob).drop("_lf", "_lr")


def _four(layers: DataFrame) -> DataFrame:
    """All assignments of symbols to four points at a site, with their probability: ``s0..s3, pr``."""
    keys = [c for c in layers.columns if c != "rho"]
    out = layers
    for k in range(4):
        out = out.select("*", F.posexplode("rho").alias(f"s{k}", f"r{k}"))
    return out.select(*keys, "s0", "s1", "s2", "s3", (F.col("r0") * F.col("r1") * F.col("r2") * F.col("r3")).alias("pr"))


def _mismatched(a: int, b: int) -> F.Column:
    return (F.col(f"s{a}") != F.col(f"s{b}")).cast("int")


def pair_sum_law(layers: DataFrame) -> DataFrame:
    """One-site law of the three opposite sums of four points: layer columns, ``s1, s2, s3, prob``."""
    keys = [c for c in layers.columns if c != "rho"]
    sums = [(_mismatched(0, 1) + _mismatched(2, 3)).alias("s1"), (_mismatched(0, 2) + _mismatched(1, 3)).alias("s2"), (_mismatched(0, 3) + _mismatched(1, 2)).alias("s3")]
    return _four(layers).select(*keys, "pr", *sums).groupBy(*keys, "s1", "s2", "s3").agg(F.sum("pr").alias("prob"))


def pattern_law(layers: DataFrame) -> DataFrame:
    """One-site law of which of the six pairs differ: layer columns, ``d01..d23`` (0 or 1), ``prob``."""
    keys = [c for c in layers.columns if c != "rho"]
    names = [distance_name(a, b) for a, b in pairs(4)]
    return _four(layers).select(*keys, "pr", *(_mismatched(a, b).alias(distance_name(a, b)) for a, b in pairs(4))).groupBy(*keys, *names).agg(F.sum("pr").alias("prob"))


def _difference_power(law: dict[tuple[int, int], float], length: int) -> np.ndarray:
    """Law of the summed differences of ``length`` sites, on a torus wide enough not to wrap."""
    side = 4 * length + 1
    grid = np.zeros((side, side))
    for (x, y), p in law.items():
        grid[x % side, y % side] += p
    out = np.maximum(np.fft.irfft2(np.fft.rfft2(grid) ** length, s=(side, side)), 0.0)
    return out / out.sum()


def hyperbolicity_law(one_site: DataFrame, length: int, keys: Sequence[str], tol: float = 0.0) -> DataFrame:
    """Exact law of the deficit of ``length`` independent sites from ``pair_sum_law`` rows: ``keys, deficit, prob``.

    The deficit depends on two differences of the three sums alone, so a
    two-dimensional transform does for each layer. Masses up to ``tol`` are
    dropped before normalizing.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        law: dict[tuple[int, int], float] = {}
        for a, b, c, p in zip(rows["s1"], rows["s2"], rows["s3"], rows["prob"]):
            law[int(a - c), int(b - c)] = law.get((int(a - c), int(b - c)), 0.0) + p
        grid = _difference_power(law, length)
        at = np.arange(len(grid))
        at = np.where(at > 2 * length, at - len(grid), at)
        x, y = np.meshgrid(at, at, indexing="ij")
        top = np.sort(np.stack([x, y, np.zeros_like(x)]), axis=0)
        mass = np.where(grid > tol, grid, 0.0)
        ticks = np.bincount((top[2] - top[1]).ravel(), weights=mass.ravel())[: 2 * length + 1]
        out = pd.DataFrame({"deficit": np.arange(len(ticks)) / 2.0, "prob": ticks / ticks.sum()})
        for k in keys:
            out[k] = rows[k].iloc[0]
        return out[[*keys, "deficit", "prob"]]

    schema = one_site.select(*keys, F.lit(0.0).alias("deficit"), F.lit(0.0).alias("prob")).schema
    return one_site.groupBy(*keys).applyInPandas(one, schema)


def uniform_pair_sum_law(spark: SparkSession, k: int) -> DataFrame:
    """The pair-sum law of k equally likely symbols in closed form: ``k, s1, s2, s3, prob``."""
    if k < 2:
        raise ValueError("need at least two symbols")
    total = float(k**3)
    cells = {(0, 0, 0): 1.0, (1, 1, 1): 4.0 * (k - 1), (2, 2, 2): float((k - 1) * (k - 2) * (k - 3))}
    for at in range(3):
        cells[tuple(0 if i == at else 2 for i in range(3))] = float(k - 1)
        cells[tuple(1 if i == at else 2 for i in range(3))] = 2.0 * (k - 1) * (k - 2)
    if abs(sum(cells.values()) / total - 1) > 1e-9:
        raise ArithmeticError("the law does not sum to 1")
    return spark.createDataFrame([(k, *c, p / total) for c, p in cells.items() if p], "k int, s1 int, s2 int, s3 int, prob double")


def clt_mass(values: DataFrame, k: int, length: int, x: str = "deficit", restricted: bool = True) -> DataFrame:
    """Add ``mass``: the normal approximation of the deficit's law for k equally likely symbols.

    Half of the mass at 0 counts; ``restricted=False`` continues the density to negative values.
    """
    scale = math.sqrt(2.0 * (k - 1) / k**2 * length)
    spacing = 1.0 if k == 2 else 0.5
    d = F.lit(2.0 / scale) * F.col(x)
    density = F.lit(3.0 / math.sqrt(math.pi)) * F.exp(-d * d / 4) * normal_cdf_column(-d / F.lit(math.sqrt(6.0)))
    edge = F.when(F.col(x) > 0, 1.0).when(F.col(x) == 0, 0.5).otherwise(0.0) if restricted else F.lit(1.0)
    return values.withColumn("mass", edge * F.lit(2.0 * spacing / scale) * density)


def model_persistence(spark: SparkSession, patterns: list[tuple[int, ...]], probabilities: list[float], length: int, samples: int, seed: int, mode: str = "numpy", partitions: int | None = None) -> DataFrame:
    """Births and lifetimes of ``samples`` quadruples of a product measure: ``birth, lifetime, cnt``; the row (0, 0) holds those without a class.

    A quadruple's six distances are sums of site patterns, so the counts of
    patterns are drawn and no sequence is built: multinomially by blocks of
    1,024 with ``numpy``, site by site from hashes with ``md5``.
    """
    names = [distance_name(a, b) for a, b in pairs(4)]
    if mode == "numpy":
        table, pr = np.array(patterns, np.int64), np.array(probabilities) / sum(probabilities)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for block in b.column(0).to_pylist():
                    rng = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(block,)))
                    d = rng.multinomial(length, pr, min(1024, samples - block * 1024)) @ table
                    yield pa.RecordBatch.from_arrays([pa.array(d[:, k].astype(np.float64)) for k in range(6)], names=names)

        rows = spark.range(0, -(-samples // 1024), 1, partitions or spark.sparkContext.defaultParallelism).mapInArrow(run, ", ".join(f"{n} double" for n in names))
    else:
        edges, total = [], 0.0
        for p in probabilities[:-1]:
            total += p / sum(probabilities)
            edges.append(F.lit(total))
        u = hex_word(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("t").cast("string"), F.col("site").cast("string")))) / F.lit(float(WORD))
        sites = spark.range(0, samples, 1, partitions or spark.sparkContext.defaultParallelism).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("site"))
        index = F.aggregate(F.array(*edges), F.lit(1), lambda s, e: s + F.when(u >= e, 1).otherwise(0))
        cells = [F.element_at(F.array(*(F.lit(float(p[k])) for p in patterns)), index) for k in range(6)]
        rows = sites.select("t", *(c.alias(n) for c, n in zip(cells, names))).groupBy("t").agg(*(F.sum(n).alias(n) for n in names))
    birth, death = vr_persistence(4)({p: F.col(distance_name(*p)) for p in pairs(4)})
    diagrams = rows.select(birth.cast("int").alias("birth"), (death - birth).cast("int").alias("lifetime"))
    return diagrams.groupBy("birth", "lifetime").agg(F.count("*").alias("cnt"))
