"""Records, their distinct forms with multiplicity, and cumulative date slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.ordering import dense_index


def deduplicated(records: DataFrame, keys: Sequence[str], rec_no: str = "rec_no", min_count: int = 1, date: str | None = None) -> DataFrame:
    """Distinct ``keys`` with ``multiplicity``, first record, and a dense ``uid`` in the order of first occurrence.

    Forms of fewer than ``min_count`` records are dropped before numbering.
    ``date``: add ``first_seen``, its least value.
    """
    extra = [F.min(date).alias("first_seen")] if date else []
    forms = records.groupBy(*keys).agg(F.min(F.col(rec_no).cast("long")).alias("first_rec"), F.count("*").alias("multiplicity"), *extra).where(F.col("multiplicity") >= min_count)
    return dense_index(forms, "first_rec", "uid")


def tagged(records: DataFrame, forms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records with the ``uid`` of their form; those of dropped forms leave."""
    own = forms.select("uid", *(F.col(k).alias(f"_form_{k}") for k in keys))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_form_{k}"))
    return records.join(own, cond).select(*records.columns, "uid")


def first_seen(records: DataFrame, uid: str | Sequence[str] = "uid", date: str = "date") -> DataFrame:
    """Least date by form (its ``uid``, or its key columns); a form without any date is an error."""
    by = [uid] if isinstance(uid, str) else list(uid)
    least = records.groupBy(*by).agg(F.min(date).alias("first_seen"))
    undated = F.raise_error(F.concat(F.lit("no dated record of form "), F.concat_ws(" ", *by)))
    return least.withColumn("first_seen", F.coalesce("first_seen", undated.cast(least.schema["first_seen"].dataType)))


def _next_cutoff(df: DataFrame, date: str, cutoffs: DataFrame) -> DataFrame:
    """Add ``_at``: the first cutoff not before ``date``, null after the last one and without a date.

    Both are calendar days. Each day from the first cutoff to the last one is a
    row of a map (fewer than four million in all), earlier days count as the
    first cutoff; so this is an equality join with a table of bounded size.
    """
    ends = cutoffs.select(F.col("cutoff").cast("date").alias("_at")).where("_at IS NOT NULL").distinct()
    first = ends.agg(F.min("_at")).first()[0]
    before = F.lag("_at").over(Window.orderBy("_at"))
    days = ends.withColumn("_from", F.coalesce(F.date_add(before, 1), "_at")).select("_at", F.explode(F.sequence("_from", "_at")).alias("_day"))
    day = F.when(F.col(date).isNotNull(), F.greatest(F.col(date).cast("date"), F.lit(first).cast("date")))
    return df.withColumn("_day", day).join(F.broadcast(days), "_day", "left").drop("_day")


def cumulative_slices(records: DataFrame, cutoffs: DataFrame, uid: str | Sequence[str] = "uid", date: str = "date") -> DataFrame:
    """Counts of each form (its ``uid``, or its key columns) among the records dated up to each cutoff: ``cutoff, .., weight``.

    Dates and cutoffs are calendar days. Records count once at the first cutoff
    not before their date, in the scan's own tasks; sums over cutoffs follow, so
    no record is repeated for each slice. Undated ones and those after the last
    cutoff are in no slice.
    """
    by = [uid] if isinstance(uid, str) else list(uid)
    new = _next_cutoff(records.select(*by, F.col(date).alias("_date")), "_date", cutoffs).where("_at IS NOT NULL").groupBy(*by, "_at").agg(F.count("*").alias("_new"))
    ends = cutoffs.select(F.col("cutoff").cast("date").alias("cutoff")).distinct()
    later = new.join(F.broadcast(ends), F.col("cutoff") >= F.col("_at"))
    return later.groupBy("cutoff", *by).agg(F.sum("_new").cast("long").alias("weight"))


def slice_sizes(slices: DataFrame) -> DataFrame:
    """``n_records`` and ``n_forms`` by cutoff; slices without records have no row."""
    return slices.groupBy("cutoff").agg(F.sum("weight").cast("long").alias("n_records"), F.count_if(F.col("weight") > 0).alias("n_forms"))


def slice_measure(slices: DataFrame) -> DataFrame:
    """Add ``share``: each form's part of its slice."""
    return slices.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("cutoff")))


def first_slice(forms: DataFrame, cutoffs: DataFrame, date: str = "first_seen") -> DataFrame:
    """Add ``slice``: the first cutoff not before ``date`` (both calendar days), or else, or without a date, the last one."""
    last = cutoffs.agg(F.max(F.col("cutoff").cast("date")).alias("_last"))
    return _next_cutoff(forms, date, cutoffs).join(F.broadcast(last)).select(*forms.columns, F.coalesce("_at", "_last").alias("slice"))


def reference_form(records: DataFrame, accession: str, column: str = "epi_isl") -> DataFrame:
    """The form of the first record with the accession: one row ``uid``, null if there is none."""
    return records.where(F.col(column) == accession).agg(F.min_by("uid", "rec_no").alias("uid"))
