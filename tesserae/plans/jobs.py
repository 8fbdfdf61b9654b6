"""Whole jobs: sequences to sliced histograms and their statistics, and model layers.

``python -m tesserae.plans.jobs sequences | mds | summary | model``. Each stage is
written once under the output folder and read from there by the next; a broken
run is taken up where it stopped.
"""

from __future__ import annotations

import argparse
import math
import time
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import bounds, laws
from tesserae.functions.invariants import HYPERBOLICITY_DEFICIT, PAIRWISE_DISTANCE, VR_PERSISTENCE_4_1, distance_name, pairs
from tesserae.functions.metrics import hamming_packed, pack_symbols
from tesserae.operators import alignment, distributions, draws, histograms, mds, slices, tiles
from tesserae.operators.progress import progress
from tesserae.operators.space import space
from tesserae.sources import fasta, tables
from tesserae.sources.shared import scratch, stored

ALL = (PAIRWISE_DISTANCE, HYPERBOLICITY_DEFICIT, VR_PERSISTENCE_4_1)


def display_time(seconds: float) -> str:
    """H:MM:SS.ss."""
    hundredths = round(seconds * 100)
    return f"{hundredths // 360_000}:{hundredths // 6000 % 60:02d}:{hundredths // 100 % 60:02d}.{hundredths % 100:02d}"


#: Seeds of the two kinds of jobs.
SLICE_SEED, MODEL_SEED = 11, 12


def prepare(spark: SparkSession, path: str, out: str, theta: float = 0.0005, min_count: int = 1, overwrite: bool = False, expected: int | None = None) -> tuple[DataFrame, DataFrame]:
    """FASTA to ``records`` (rec_no, epi_isl, date, uid) and ``forms`` (uid, seq of polymorphic columns, multiplicity, first_seen).

    ``report`` gets one row: records read, dropped by reason and kept, and the
    widths before and after the gap columns went. Drops are counted while the
    stages are written, not in passes of their own. ``expected``: an error
    unless so many records are complete.
    """
    seen, gaps = Observation("complete"), Observation("ungapped")
    told = {"complete": seen, "ungapped": gaps}
    fresh = {k: overwrite or not tables.finished(spark, f"{out}/{k}") for k in told}
    complete = tables.once(spark, f"{out}/complete", lambda: alignment.complete(fasta.read_fasta(spark, path), seen), overwrite)
    width = alignment.width_of(complete, expected)
    kept = tables.once(spark, f"{out}/ungapped", lambda: alignment.ungapped(complete, theta, gaps), overwrite)
    if all(fresh.values()):  # what was written in an earlier run was counted then
        counts = seen.get | gaps.get
        rows = [(*(counts[k] for k in ("records", "bad_characters", "no_date", "gap")), counts["aligned"] - counts["gap"], width, alignment.width_of(kept))]
        spark.createDataFrame(rows, "records long, bad_characters long, no_date long, gap long, kept long, width long, ungapped_width long").write.mode("overwrite").parquet(f"{out}/report")
    forms = tables.once(spark, f"{out}/distinct", lambda: slices.deduplicated(kept, ["seq"], min_count=min_count, date="date"), overwrite)
    records = tables.once(spark, f"{out}/records", lambda: slices.tagged(kept, forms, ["seq"]).select("rec_no", "epi_isl", "date", "uid"), overwrite)
    return records, tables.once(spark, f"{out}/forms", lambda: alignment.compacted(forms), overwrite)


def slice_accuracy(n_samples: int, n: int, p: float, alpha: float, n_events: int) -> dict[str, float]:
    """Accuracies that hold together with probability ``alpha`` for ``n_events`` statements on samples of this size."""
    one = 1 - (1 - alpha) / n_events
    line = bounds.wasserstein_bound(n_samples, one, 2, p)
    return {"alpha_event": one, "epsilon_persistence": bounds.wasserstein_bound(n_samples, one, n, p), "epsilon_distance": line, "epsilon_hyperbolicity": line}


def write_slice_histograms(spark: SparkSession, records: DataFrame, forms: DataFrame, cutoffs: Sequence[str], out: str, n_samples: int, epsilon: float = 0.1, alpha: float = 0.95, p: float = 1.0, seed: int = SLICE_SEED, mode: str = "xx", overwrite: bool = False, n_sites: int | None = None, report: bool = False) -> None:
    """Joint histograms of each cumulative slice and a metadata row, under ``out``; a slice that is there stays.

    Slices without records are left out. ``report``: progress on stderr.
    """
    ends = spark.createDataFrame([(c,) for c in cutoffs], "cutoff string").select(F.col("cutoff").cast("date").alias("cutoff"))
    width = n_sites if n_sites is not None else alignment.width_of(forms)
    with scratch(spark):
        weights = stored(slices.cumulative_slices(records, ends), "slice-weights")
        points = stored(forms.select(F.col("uid").alias("pid"), pack_symbols(F.col("seq")).alias("x")), "slice-points")
        sizes = {r.cutoff: r for r in slices.slice_sizes(weights).collect()}  # a row a cutoff
        n_points, n_events = points.count(), 3 * len(cutoffs)
        for k, cutoff in enumerate(sorted(sizes)):
            at = f"{out}/histograms/cutoff={cutoff}"
            if not overwrite and tables.finished(spark, at) and tables.finished(spark, f"{out}/metadata/cutoff={cutoff}"):
                continue
            began, started = time.time(), datetime.now().isoformat(timespec="seconds")
            own = points.join(weights.where(F.col("cutoff") == cutoff).select(F.col("uid").alias("pid"), "weight"), "pid", "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long"))
            s = space(own, F.col("x"), hamming_packed, weight="weight", check=False, n_points=n_points)
            with progress(spark, str(cutoff), report):
                distributions.distributions(s, ALL, 4, n_samples, seed=seed + k, mode=mode).write.mode("overwrite").parquet(at)
            diam = spark.read.parquet(at).where(F.col("invariant") == PAIRWISE_DISTANCE.name).agg(F.max("v0")).first()[0]
            row = {"n_sequences": sizes[cutoff].n_records, "n_haplotypes": sizes[cutoff].n_forms, "n_sites": width, "diam": int(diam), "n_samples": n_samples}
            row |= {f"n_samples_{x}": n_samples for x in ("distance", "hyperbolicity", "persistence")}
            row |= {"lip_hyperbolicity": 2.0, "lip_persistence": 1.0, "lip_distance": 1.0, "seed": seed + k, "mode": mode, "p": float(p), "q": math.inf, "m": math.inf, "n": 4, "epsilon": float(epsilon), "alpha": float(alpha), "n_events": n_events}
            row |= slice_accuracy(n_samples, 4, p, alpha, n_events)
            row |= {"runtime_seconds": time.time() - began, "started": started, "finished": datetime.now().isoformat(timespec="seconds"), "n_cores": spark.sparkContext.defaultParallelism}
            spark.createDataFrame([row]).write.mode("overwrite").parquet(f"{out}/metadata/cutoff={cutoff}")


def summary(hist: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row a slice: its size and the statistics of its three histograms."""

    def of(f: object) -> DataFrame:
        return hist.where(F.col("invariant") == f.name)

    by = ["cutoff"]
    out = metadata.select("cutoff", "n_sequences", "n_haplotypes")
    for part in (histograms.distance_stats(of(PAIRWISE_DISTANCE), by), histograms.deficit_stats(of(HYPERBOLICITY_DEFICIT), by), histograms.persistence_stats(of(VR_PERSISTENCE_4_1), by)):
        out = out.join(part, by, "left")
    return out


def run_sequences(spark: SparkSession, path: str, out: str, cutoffs: Sequence[str], epsilon: float = 0.1, alpha: float = 0.95, p: float = 1.0, n_samples: int | None = None, theta: float = 0.0005, min_count: int = 1, seed: int = SLICE_SEED, overwrite: bool = False, report: bool = False) -> DataFrame:
    """FASTA to the summary of each slice; the sample size follows from the accuracy unless given.

    ``alpha``: the probability with which the three statements of every slice hold together.
    """
    records, forms = prepare(spark, path, out, theta, min_count, overwrite)
    size = n_samples or bounds.sample_size(epsilon, 1 - (1 - alpha) / (3 * len(cutoffs)), 4, p)
    told = tables.read_if_there(spark, f"{out}/report")
    sites = told.first().width if told is not None else None
    write_slice_histograms(spark, records, forms, cutoffs, f"{out}/slices", size, epsilon, alpha, p, seed, overwrite=overwrite, n_sites=sites, report=report)
    return summary(*tables.read_slices(spark, f"{out}/slices"))


def embed_forms(spark: SparkSession, out: str, accession: str | None = None, max_points: int = 50_000, n_init: int = 4, max_iter: int = 300, seed: int = SLICE_SEED) -> DataFrame:
    """MDS of at most ``max_points`` prepared forms, that of ``accession`` always in: ``uid, x, y, stress, first_seen, is_reference``, also as CSV."""
    records, forms = (spark.read.parquet(f"{out}/{name}") for name in ("records", "forms"))
    pin = slices.reference_form(records, accession).first().uid if accession else None
    if accession and pin is None:
        print(f"no kept record of {accession}; embedded without it")
    points = forms.select(F.col("uid").alias("pid"), pack_symbols(F.col("seq")).alias("x"))
    s = space(points, F.col("x"), hamming_packed, check=False)
    chosen = draws.subsample(s.points, max_points, seed, pin=pin)
    e = mds.embed(tiles.distance_tiles(chosen, s), n_init=n_init, max_iter=max_iter, seed=seed)
    own = e.select(F.col("pid").alias("uid"), F.col("x0").alias("x"), F.col("x1").alias("y"), "stress")
    full = own.join(forms.select("uid", "first_seen"), "uid").withColumn("is_reference", F.col("uid").eqNullSafe(F.lit(pin)))
    tables.write_embedding(full.orderBy("uid"), f"{out}/mds_embedding_max{max_points}")
    return full


def run_model(spark: SparkSession, out: str, length: int = 100, k: int = 4, beta: float = 1.0, times: Sequence[float] = (0.05, 0.1, 0.5, 1.0), phi: Sequence[float] = (0.0, 0.0, -10.0, -10.0), samples: int = 117_207_232, mds_samples: int = 160, mds_n_init: int = 1, mds_max_iter: int = 500, seed: int = MODEL_SEED, report: bool = False) -> None:
    """Exact distance and deficit laws and sampled persistence of all layers, and an embedding a family of ``mds_samples`` sequences a layer, under ``out``."""
    if length < 1 or k < 2 or len(phi) != k or beta <= 0 or min(times) < 0 or min(samples, mds_samples, mds_n_init, mds_max_iter) < 1:
        raise ValueError("need a positive length, at least two symbols with a fitness each, a positive rate, times of at least 0, and samples, starts and steps")
    layers = laws.model_layers(spark, k, beta, times, phi)
    keys = ["family", "time"]
    laws.binomial_pmf(laws.mismatch(layers).drop("rho"), length).write.mode("overwrite").parquet(f"{out}/distance")
    laws.hyperbolicity_law(laws.pair_sum_law(layers), length, keys).write.mode("overwrite").parquet(f"{out}/hyperbolicity")
    names = [distance_name(a, b) for a, b in pairs(4)]
    found: dict[tuple, list] = {}
    for r in laws.pattern_law(layers).collect():  # at most 64 rows a layer
        found.setdefault((r.family, r.time), []).append((tuple(r[c] for c in names), r.prob))
    every = []
    for i, ((family, t), rows) in enumerate(sorted(found.items())):
        patterns, probs = zip(*sorted(rows))
        h = laws.model_persistence(spark, list(patterns), list(probs), length, samples, seed + 1 + i)
        every.append(h.select(F.lit(family).alias("family"), F.lit(float(t)).alias("time"), "*"))
    with progress(spark, "persistence", report):
        reduce(DataFrame.unionByName, every).write.mode("overwrite").parquet(f"{out}/persistence")  # all layers at once, or none
    own_layers, every = layers.collect(), []  # ten rows
    for f, family in enumerate(("JC", "HB")):
        points = None
        for i, r in enumerate(r for r in own_layers if r.family == family):
            s = draws.sequences(spark, list(r.rho), length, mds_samples, seed + 100 * (f + 1) + i, "xx").select((F.col("t") + i * mds_samples).alias("pid"), F.col("symbols").alias("x"))
            points = s if points is None else points.unionByName(s)
        own = space(points, "x", "hamming")
        e = mds.embed(tiles.distance_tiles(own.points, own, own.n_points), n_init=mds_n_init, max_iter=mds_max_iter, seed=seed)
        every.append(e.select(F.lit(family).alias("family"), F.floor(F.col("pid") / mds_samples).cast("int").alias("layer_index"), "*"))
    reduce(DataFrame.unionByName, every).write.mode("overwrite").parquet(f"{out}/embedding")


def main(argv: Sequence[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tesserae-jobs")
    jobs = top.add_subparsers(dest="job", required=True)
    a = jobs.add_parser("sequences", help="aligned FASTA to sliced histograms and statistics")
    a.add_argument("fasta")
    a.add_argument("out")
    a.add_argument("--cutoff", action="append", required=True, help="YYYY-MM-DD; may be given more than once")
    a.add_argument("--samples", type=lambda s: int(float(s)), help="quadruples a slice (from the accuracy by default)")
    a.add_argument("--theta", type=float, default=0.0005, help="largest gap share of a kept column")
    a.add_argument("--min-count", type=int, default=1, help="fewest records of a kept form")
    a.add_argument("--overwrite", action="store_true", help="make every stage and slice anew")
    e = jobs.add_parser("mds", help="embedding of the forms that the sequences job wrote")
    e.add_argument("out")
    e.add_argument("--reference", help="accession of a record whose form is always in")
    e.add_argument("--max-points", type=int, default=50_000)
    b = jobs.add_parser("summary", help="statistics of written slices")
    b.add_argument("out")
    c = jobs.add_parser("model", help="laws and samples of substitution models")
    c.add_argument("out")
    c.add_argument("--length", type=int, default=100)
    c.add_argument("--alphabet-size", type=int, default=4)
    c.add_argument("--beta", type=float, default=1.0)
    c.add_argument("--times", default="0.05,0.1,0.5,1.0")
    c.add_argument("--phi", default="0,0,-10,-10")
    c.add_argument("--persistence-samples", type=lambda s: int(float(s)), default=117_207_232)
    c.add_argument("--mds-samples", type=int, default=160, help="sequences a layer")
    c.add_argument("--mds-n-init", type=int, default=1)
    c.add_argument("--mds-max-iter", type=int, default=500)
    for x, seed in ((a, SLICE_SEED), (e, SLICE_SEED), (c, MODEL_SEED)):
        x.add_argument("--seed", type=int, default=seed)
    for x in (a, c):
        x.add_argument("--progress", action="store_true", help="print how far the sampling is to stderr")
    args = top.parse_args(argv)
    spark, began = SparkSession.builder.getOrCreate(), time.time()
    if args.job == "sequences":
        run_sequences(spark, args.fasta, args.out, args.cutoff, n_samples=args.samples, theta=args.theta, min_count=args.min_count, seed=args.seed, overwrite=args.overwrite, report=args.progress).orderBy("cutoff").show(truncate=False)
    elif args.job == "mds":
        print(f"{embed_forms(spark, args.out, args.reference, args.max_points, seed=args.seed).count()} forms embedded")
    elif args.job == "summary":
        summary(*tables.read_slices(spark, f"{args.out}/slices")).orderBy("cutoff").show(truncate=False)
    else:
        numbers = [[float(x) for x in text.split(",")] for text in (args.times, args.phi)]
        if not all(math.isfinite(x) for x in numbers[0]):
            raise SystemExit("times must be finite; the limit is always added")
        run_model(spark, args.out, args.length, args.alphabet_size, args.beta, *numbers, args.persistence_samples, args.mds_samples, args.mds_n_init, args.mds_max_iter, args.seed, args.progress)
    print(f"done in {display_time(time.time() - began)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
