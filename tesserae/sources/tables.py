"""Record tables as TSV, results as partitioned Parquet and CSV, and stages that run once."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """``epi_isl, date`` of a TSV with a header row; an empty date is null.

    Lines are split here: the CSV reader would skip a line of two empty fields.
    """
    lines = spark.read.text(path).where(F.col("value") != "epi_isl\tdate").select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"))
    return lines.select(F.get("f", F.lit(0)).alias("epi_isl"), F.try_to_date(F.nullif(F.get("f", F.lit(1)), F.lit("")), "yyyy-MM-dd").alias("date"))


def write_dates(records: DataFrame, path: str) -> None:
    """``epi_isl`` and ``date`` as TSV with a header row; a null date is empty."""
    records.select("epi_isl", F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")).alias("date")).write.csv(path, sep="\t", header=True, emptyValue="")


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet result, or None if nothing was written there; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The result at ``path``, made and written only if a finished one isn't there.

    Spark commits a result as a whole, so a broken run leaves nothing that reads as finished.
    """
    if overwrite or not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a committed result."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, none if it isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []


def write_slices(histograms: DataFrame, metadata: DataFrame, path: str) -> None:
    """Histograms partitioned by cutoff, and one metadata row a cutoff, written after them."""
    histograms.repartition("cutoff").write.mode("overwrite").partitionBy("cutoff").parquet(f"{path}/histograms")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def read_slices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Histograms with the share of each value within its cutoff and invariant, and the metadata."""
    from tesserae.operators.histograms import pmf

    return pmf(spark.read.parquet(f"{path}/histograms"), ["cutoff", "invariant"]), spark.read.parquet(f"{path}/metadata")


def write_embedding(embedding: DataFrame, path: str) -> None:
    """Coordinates with eight decimals as CSV, the rest as it is."""
    cells = [F.format_string("%.8f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in embedding.dtypes]
    embedding.select(*cells).write.mode("overwrite").csv(path, header=True)


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The results of a model job by name, those of ``distance``, ``hyperbolicity``, ``persistence`` and ``embedding`` that are there.

    Sampled persistence gets the share ``prob`` of each value within its layer.
    """
    from tesserae.operators.histograms import pmf

    found = {k: read_if_there(spark, f"{path}/{k}") for k in ("distance", "hyperbolicity", "persistence", "embedding")}
    found = {k: v for k, v in found.items() if v is not None}
    if "persistence" in found:
        found["persistence"] = pmf(found["persistence"], ["family", "time"])
    return found


def largest_embedding(spark: SparkSession, path: str) -> DataFrame | None:
    """The finished embedding of the most points among ``mds_embedding_max<N>`` under ``path``, or None."""
    names = children(spark, path)
    sizes = sorted((int(m[1]) for m in (re.fullmatch(r"mds_embedding_max(\d+)", x) for x in names) if m and finished(spark, f"{path}/{m[0]}")), reverse=True)
    return spark.read.csv(f"{path}/mds_embedding_max{sizes[0]}", header=True, inferSchema=True) if sizes else None
