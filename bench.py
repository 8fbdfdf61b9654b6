"""Times the headline queries, three times each after a warm-up, and prints one JSON line of medians.

``machine`` times a fixed piece of work, to compare runs on machines of different
speed. Wide points have as many columns as the published alignment.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tesserae.functions.invariants import HYPERBOLICITY_DEFICIT, PAIRWISE_DISTANCE, VR_PERSISTENCE_4_1
from tesserae.functions.metrics import hamming_packed
from tesserae.operators import distributions, tiles
from tesserae.operators.space import space
from tesserae.plans import catalogue
from tesserae.sources.shared import stored

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
#: Runs of each query.
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
#: Wide points: how many, their columns, and quadruples and pairs among them.
WIDE_POINTS, COLUMNS = 4096, 27_000
WIDE_QUADRUPLES = int(os.environ.get("BENCH_WIDE_QUADRUPLES", "400000"))
#: Quadruples of the throughput query: one sample, three invariants.
QUADRUPLES = int(os.environ.get("BENCH_QUADRUPLES", "10000000"))

HEADLINE = [
    "q02_curvature_measure_hamming",
    "q03_pairwise_histogram",
    "q04_hyperbolicity_histogram",
    "q05_persistence_histogram",
    "q06_joint_histograms",
    "q08_persistence_six_points",
    "q10_euclidean_rounded",
    "q12_weighted_draws",
    "q13_dedup_multiplicity",
    "q15_date_slices",
    "q16_sliced_hyperbolicity",
    "q21_gap_columns",
    "q32_all_pairs_distance",
    "q38_sample_size_wb",
    "q43_hyperbolicity_exact_law",
    "q45_model_persistence",
]
#: Timed once and not part of the total, which stays comparable between rounds.
MORE = ["q29_weighted_median", "q55_wide_points_by_column_blocks", "q56_all_pairs_of_wide_points"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(make, repeats: int = REPEATS) -> float:  # noqa: ANN001
        found = []
        for _ in range(repeats):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            found.append(time.perf_counter() - began)
        return round(median(found), 3)

    def joint():  # noqa: ANN202
        s = catalogue.parts(spark, SF_DIR)
        return distributions.distributions(s, (PAIRWISE_DISTANCE, HYPERBOLICITY_DEFICIT, VR_PERSISTENCE_4_1), 4, QUADRUPLES, seed=1, mode="xx")

    words = F.transform(F.sequence(F.lit(0), F.lit(-(-COLUMNS // 32) - 1)), lambda k: F.xxhash64("id", k))
    wide = space(stored(spark.range(0, WIDE_POINTS, 1, CPUS).select(F.col("id").alias("pid"), words.alias("x")), "wide"), "x", hamming_packed)

    def quadruples():  # noqa: ANN202
        return distributions.distributions(wide, (PAIRWISE_DISTANCE, HYPERBOLICITY_DEFICIT, VR_PERSISTENCE_4_1), 4, WIDE_QUADRUPLES, seed=1, mode="xx")

    def pairs():  # noqa: ANN202
        return tiles.tile_histogram(tiles.distance_tiles(wide.points, wide, WIDE_POINTS))

    timed(lambda: catalogue.q06_joint_histograms(spark, SF_DIR))  # warm-up
    machine = timed(lambda: spark.range(0, 200_000_000, 1, CPUS).agg(F.max(F.xxhash64("id"))))
    times = {name: timed(lambda name=name: catalogue.QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    times["joint_histograms_quadruples"] = timed(joint)
    total = round(sum(times.values()), 3)
    times |= {name: timed(lambda name=name: catalogue.QUERIES[name](spark, SF_DIR), 1) for name in MORE}
    times["wide_quadruples"], times["wide_pairs"] = timed(quadruples, 1), timed(pairs, 1)
    rate = QUADRUPLES / times["joint_histograms_quadruples"]
    wide_rates = {"columns": COLUMNS, "wide_points": WIDE_POINTS, "wide_quadruples_per_sec_per_core": round(WIDE_QUADRUPLES / times["wide_quadruples"] / CPUS), "wide_pairs_per_sec_per_core": round(WIDE_POINTS * (WIDE_POINTS - 1) / 2 / times["wide_pairs"] / CPUS)}
    print(json.dumps({"metric": "total seconds of headline queries", "value": total, "unit": "sec", "queries": times, "sf": SF_DIR, "cpus": CPUS, "quadruples": QUADRUPLES, "quadruples_per_sec": round(rate), "quadruples_per_sec_per_core": round(rate / CPUS), "machine": machine, "repeats": REPEATS, **wide_rates}))
    spark.stop()


if __name__ == "__main__":
    main()
