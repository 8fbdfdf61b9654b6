"""Running totals and dense numbers of whole tables, without one task that sees all rows.

Rows are dealt to strides; totals of strides are summed over the small stride
table, and the rest happens within each stride. Keys that are nearly dense are
cut at fixed places; others by Spark's range partitioning, written once so
that every later step sees the same strides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.sources.shared import stored

STRIDE = 1 << 16


def _totals(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``_stride`` and ``_value`` to running sums ``name`` of the values of smaller keys."""
    sums = rows.groupBy("_stride").agg(F.sum("_value").alias("_sum"))
    before = sums.withColumn("_base", F.sum("_sum").over(Window.orderBy("_stride").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    within = F.sum("_value").over(Window.partitionBy("_stride").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0).cast(rows.schema["_value"].dataType)
    out = rows.withColumn("_within", F.coalesce(within, zero)).join(before, "_stride")
    return out.withColumn(name, F.col("_within") + F.coalesce("_base", zero)).drop("_stride", "_value", "_within", "_base")


def running_total(df: DataFrame, key: str, value: Column, name: str, stride: int = STRIDE) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows of smaller ``key`` (a nearly dense long; distinct)."""
    return _totals(df.withColumn("_stride", F.floor(F.col(key) / stride)).withColumn("_value", value), key, name)


def ranged_total(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``running_total`` for any sortable distinct key: each stride is one range partition. ``df`` is written once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.withColumn("_value", value).repartitionByRange(n, key).withColumn("_stride", F.spark_partition_id()), "ranges")
    return _totals(rows, key, name)


def dense_index(df: DataFrame, key: str, name: str = "pid") -> DataFrame:
    """Add ``name``: 0, 1, ... in the order of the distinct ``key``."""
    return ranged_total(df, key, F.lit(1).cast("long"), name)


def cumulated(df: DataFrame, by: Sequence[str], key: str, value: Column, name: str, descending: bool = False, following: str | None = None) -> DataFrame:
    """Add ``name``: within ``by``, the sum of ``value`` over the rows up to and including this one in the order of ``key``.

    Keys are distinct within ``by``. ``following``: also add the next key, null
    for the last. Rows are cut to ranges of (by, key), written once; a window sees
    one range, and only totals of ranges are summed beyond them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by, order = list(by), F.desc(key) if descending else F.asc(key)
    rows = stored(df.withColumn("_value", value).repartitionByRange(n, *by, order).withColumn("_stride", F.spark_partition_id()), "ranges")
    first = F.max(key) if descending else F.min(key)
    sums = rows.groupBy(*by, "_stride").agg(F.sum("_value").alias("_sum"), first.alias("_first"))
    zero = F.lit(0).cast(rows.schema["_value"].dataType)
    if by:
        own = Window.partitionBy(*by).orderBy("_stride")
        before = sums.withColumns({"_base": F.coalesce(F.sum("_sum").over(own.rowsBetween(Window.unboundedPreceding, -1)), zero), "_then": F.lead("_first").over(own)})
    else:  # one row a range
        found, held = sums.orderBy("_stride").collect(), []
        total = type(found[0]["_sum"])(0) if found else 0
        for k, r in enumerate(found):
            held.append((r["_stride"], total, found[k + 1]["_first"] if k + 1 < len(found) else None))
            total += r["_sum"]
        schema = T.StructType([T.StructField("_stride", T.IntegerType()), T.StructField("_base", sums.schema["_sum"].dataType), T.StructField("_then", sums.schema["_first"].dataType)])
        before = df.sparkSession.createDataFrame(held, schema)
    within = Window.partitionBy(*by, "_stride").orderBy(order)
    out = rows.withColumn("_within", F.sum("_value").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    if following:
        out = out.withColumn("_next", F.lead(key).over(within))
    told = before.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_stride").alias("_of"), "_base", "_then")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col("_stride") == F.col("_of"))
    out = out.join(told, same).withColumn(name, F.col("_within") + F.col("_base"))
    if following:
        out = out.withColumn(following, F.coalesce("_next", "_then"))
    return out.select(*df.columns, name, *([following] if following else []))
