"""Aligned sequences: filters, gap columns, column projection.

Sequences are strings of one width. Counts by column go through per-task
vectors on Arrow batches, which Spark adds up by position: the shuffle carries
one row a column and task, not one a symbol.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

ALLOWED = "ACGTacgt-"


def fields(header: Column) -> Column:
    return F.split(F.rtrim(header), "[|]")


def accession(header: Column) -> Column:
    """The second field, empty if there is none."""
    return F.coalesce(F.get(fields(header), F.lit(1)), F.lit(""))


def complete_date(header: Column) -> Column:
    """The third field as a date if it is a full YYYY-MM-DD of the calendar, else null."""
    text = F.get(fields(header), F.lit(2))
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def clean(seq: Column, allowed: str = ALLOWED) -> Column:
    """Whether the sequence has no other characters than the allowed ones."""
    return F.length(F.translate(seq, allowed, "")) == 0


def verdict(header: Column, seq: Column) -> Column:
    """"bad characters", else "no date", else "complete"; the first that holds."""
    return F.when(~clean(seq), "bad characters").when(complete_date(header).isNull(), "no date").otherwise("complete")


def complete(records: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Records that are clean and dated, with ``epi_isl`` and ``date``.

    ``seen``: an observation that counts, in the pass that computes the result,
    all ``records`` and how many of them were dropped for ``bad_characters`` and
    for ``no_date``.
    """
    own = records.withColumn("_verdict", verdict(F.col("header"), F.col("seq")))
    if seen is not None:
        dropped = {k: F.count_if(F.col("_verdict") == k.replace("_", " ")).alias(k) for k in ("bad_characters", "no_date")}
        own = own.observe(seen, F.count("*").alias("records"), *dropped.values())
    own = own.where(F.col("_verdict") == "complete").drop("_verdict")
    return own.withColumns({"epi_isl": accession(F.col("header")), "date": complete_date(F.col("header"))})


def _symbols(seqs: pa.Array, width: int | None) -> np.ndarray:
    """A matrix of bytes; an error if the widths differ."""
    rows = seqs.cast(pa.binary()).to_pylist()
    sizes = {*map(len, rows)} | ({width} if width is not None else set())
    if len(sizes) > 1:
        raise ValueError(f"not a fixed-width alignment: rows of {sorted(sizes)} symbols")
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def width_of(records: DataFrame, expected: int | None = None) -> int:
    """The common width; an error if rows differ, if there are none, or not the ``expected`` number of them."""
    r = records.agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi"), F.count("*").alias("n")).first()
    if expected is not None and r.n != expected:
        raise ValueError(f"the alignment has {r.n} records, not {expected}")
    if r.lo is None:
        raise ValueError("the alignment has no records")
    if r.lo != r.hi:
        raise ValueError(f"not a fixed-width alignment: rows of {r.lo} to {r.hi} symbols")
    return r.lo


def _column_counts(records: DataFrame, count) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, width = None, 0, None
        for b in batches:
            if b.num_rows:
                x = _symbols(b.column(0), width)
                width, rows = x.shape[1], rows + len(x)
                new = count(x)
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total), pa.array(np.full(width, rows))], names=["pos", "cnt", "n"])

    return records.select("seq").mapInArrow(run, "pos long, cnt long, n long").groupBy("pos").agg(F.sum("cnt").cast("long").alias("cnt"), F.sum("n").cast("long").alias("n"))


def gap_columns(records: DataFrame) -> DataFrame:
    """By column: ``pos`` from 0, ``dashes``, ``n_rows``, ``frac``."""
    counts = _column_counts(records, lambda x: (x == ord("-")).sum(0).astype(np.int64))
    return counts.select("pos", F.col("cnt").alias("dashes"), F.col("n").alias("n_rows"), (F.col("cnt") / F.col("n")).alias("frac"))


def _table(columns: DataFrame, value: str) -> np.ndarray:
    """One value a column of the alignment, in order; an alignment's width bounds it."""
    rows = columns.select("pos", value).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r[0]] = r[1]
    return out


def gap_rows(records: DataFrame, columns: DataFrame) -> DataFrame:
    """Add ``min_frac``: the least gap share of the columns a row has a dash in, infinite without dashes.

    A row is kept at threshold theta iff this exceeds theta.
    """
    told = records.sparkSession.sparkContext.broadcast(_table(columns, "frac"))
    names, schema = [*records.columns, "min_frac"], records.withColumn("min_frac", F.lit(0.0)).schema
    at = records.columns.index("seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _symbols(b.column(at), len(told.value))
                low = np.where(x == ord("-"), told.value, np.inf).min(1, initial=np.inf)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low)], names=names)

    return records.mapInArrow(run, schema)


def gap_profile(columns: DataFrame, rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """How many columns and rows each threshold keeps: ``threshold, columns_kept, rows_kept``."""

    def kept(df: DataFrame, holds, name: str) -> DataFrame:  # noqa: ANN001
        counts = df.agg(*(F.count_if(holds(th)).alias(f"c{k}") for k, th in enumerate(thresholds)))
        cells = [x for k, th in enumerate(thresholds) for x in (F.lit(float(th)), F.col(f"c{k}"))]
        return counts.select(F.stack(F.lit(len(thresholds)), *cells).alias("threshold", name))

    a = kept(columns, lambda th: F.col("frac") <= th, "columns_kept")
    return a.join(kept(rows, lambda th: F.col("min_frac") > th, "rows_kept"), "threshold")


def project(records: DataFrame, keep: Sequence[int]) -> DataFrame:
    """``seq`` cut to the columns ``keep``, on Arrow batches."""
    names, at, chosen = records.columns, records.columns.index("seq"), np.array(sorted(keep), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cut = np.ascontiguousarray(_symbols(b.column(at), None)[:, chosen])
                ends = np.arange(len(cut) + 1, dtype=np.int32) * len(chosen)
                text = pa.Array.from_buffers(pa.string(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(cut.tobytes())])
                yield pa.RecordBatch.from_arrays([text if k == at else c for k, c in enumerate(b.columns)], names=names)

    return records.mapInArrow(run, records.schema)


def ungapped(records: DataFrame, theta: float = 0.0005, seen: Observation | None = None) -> DataFrame:
    """Columns with a gap share of at most ``theta``, rows without a dash left in them.

    ``seen`` counts rows dropped for a gap (``gap``) while the result is computed.
    """
    columns = gap_columns(records)
    keep = [r.pos for r in columns.where(F.col("frac") <= theta).select("pos").collect()]
    cut = project(records, keep)
    if seen is not None:
        cut = cut.observe(seen, F.count_if(F.contains("seq", F.lit("-"))).alias("gap"), F.count("*").alias("aligned"))
    return cut.where(~F.contains("seq", F.lit("-")))


def polymorphic_columns(records: DataFrame) -> DataFrame:
    """Columns in which some rows differ: ``pos``, its least and greatest symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                x = _symbols(b.column(0), None if low is None else len(low))
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64))], names=["pos", "lo", "hi"])

    per = records.select("seq").mapInArrow(run, "pos long, lo long, hi long").groupBy("pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return per.where("lo <> hi").select("pos", F.char(F.col("lo")).alias("least"), F.char(F.col("hi")).alias("greatest"))


def compacted(records: DataFrame) -> DataFrame:
    """Records cut to their polymorphic columns; Hamming distances stay as they are."""
    return project(records, [r.pos for r in polymorphic_columns(records).select("pos").collect()])
