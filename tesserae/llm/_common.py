"""Shared helpers: table access, joins of hot keys, words and code points."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.sources.shared import shared_dir, shipped, stored

__all__ = ["shared_dir", "stored"]

#: Bytes that continue a UTF-8 code point; deleting them leaves one byte each.
CONTINUATION = bytes(range(0x80, 0xC0))
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The same words as ``bytes.split()``: runs of anything but space and \x09-\x0D.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reachable(spark: SparkSession) -> None:
    """Make the session fit for texts.

    Python workers get this package. Arrow batches hold 1,000 rows, unless the
    session was given a number of its own: whole texts are large rows.
    """
    shipped(spark)
    if BATCH_ROWS not in spark.conf.getAll:
        spark.conf.set(BATCH_ROWS, "1000")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed within goes to Python in batches of at most ``rows``: for rows that hold whole sets."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``, read by Spark."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than this share of all rows is hot; so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 1024


def join_counted(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: str = "n_rows") -> DataFrame:
    """``left`` joined to ``right``, which has one row a key and the number of left rows of it in ``rows``.

    Rows of hot keys meet their key where they are: fewer than 1,024 rows of
    ``right`` are sent to all executors. The rest is shuffled, and no key of it
    holds more than a thousandth of all rows. ``left`` is read twice, so pass a
    stored table or a cheap plan. Null keys match nothing. Without ``rows`` in
    the result; ``how``: inner or left.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    is_hot = F.col(rows) > F.lit(total * HOT_SHARE)
    hot, cold = F.broadcast(right.where(is_hot).drop(rows)), right.where(~is_hot).drop(rows)
    near = left.join(hot, on)
    far = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return near.unionByName(far)


def text_sample(df: DataFrame, text: str, rows: int, most: int = 1 << 16, seed: int = 1) -> list[str]:
    """About ``rows`` texts of at most ``most`` bytes, drawn row by row over the whole table; null is empty.

    At most ``2 * rows`` texts come to the driver, ``2 * rows * most`` bytes.
    """
    n = df.count()
    own = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).sample(min(1.0, rows / max(n, 1)), seed)
    return [r.t for r in own.where(F.octet_length("t") <= most).limit(2 * rows).collect()]


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def arrow_type(name: str) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}[name]


def schema_of(fields: list[tuple[str, str]]) -> T.StructType:
    """A Spark schema from ``(name, type)`` pairs."""
    return T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))


def batch_of(rows: list[tuple], fields: list[tuple[str, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [() for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=arrow_type(t)) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def emitted(rows: Iterator[tuple], fields: list[tuple[str, str]], size: int = 4096, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of at most ``size``, closed once their binary values exceed ``most`` bytes."""
    held: list[tuple] = []
    binary, weight = [k for k, (_, t) in enumerate(fields) if t == "binary"], 0
    for row in rows:
        held.append(row)
        for k in binary:
            weight += len(row[k] or b"")
        if len(held) >= size or weight > most:
            yield batch_of(held, fields)
            held, weight = [], 0
    if held:
        yield batch_of(held, fields)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one the worker gives unused memory back, as it lives on for other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``n_keys`` integer columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[-1].column(c)[0].as_py() != b.column(c)[0].as_py() for c in range(n_keys)):
            yield pa.Table.from_batches(held)
            held = []
        key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(n_keys)])
        edges = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()
        for s, e in zip([0, *edges], [*edges, b.num_rows]):
            if s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)
