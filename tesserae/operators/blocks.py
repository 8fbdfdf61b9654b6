"""Distances within tuples of wide points, by blocks of columns.

The columns of all points are cut to blocks that fit in a task's memory. A key
(block, split) gets that block of every point, and then the tuples of its split,
packed by some thousands; it counts the differences in its columns for every
wanted pair. Counts of the blocks are added by tuple. So what is shuffled for a
tuple is its ids and one number a pair for each block, whatever the number of
columns in a block; a heavy point travels no more often than any other. Where
tuples ask for fewer ids than there are points, only points that some tuple asks for
travel. Points go packed by pieces too, and each key has a task of its own, so a
task reads a block and its tuples and no more.

Packed tuples are written once, so what belongs together stays so when a task is
run again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.invariants import distance_name
from tesserae.functions.kernels import Codes, Kernel, kernel_of
from tesserae.operators.space import Space
from tesserae.sources.shared import shipped, stored

#: Bytes of a block of columns of all points, which one task holds; elements of points from which blocks pay.
BLOCK_BYTES, WIDE = 128 << 20, 64
#: Packed rows of tuples (an Arrow batch each) of a split, and bytes of coordinates compared at once.
SPLIT_ROWS, AT_ONCE = 512, 16 << 20
#: Bytes of coordinates in a packed piece of points, and ids asked for at most that are sent to all executors.
PIECE_BYTES, ASKED = 4 << 20, 1 << 20
#: Number types of elements.
_TYPES = {"byte": "<i1", "short": "<i2", "integer": "<i4", "long": "<i8"}


def width_of(space: Space) -> int:
    """Elements of the widest point."""
    return (space.point_bytes - 64) // 8


def blockwise(space: Space) -> Kernel | None:
    """The kernel, if the space's points are wide, its metric adds up over columns, and one column of all points fits in a block."""
    own = kernel_of(space.metric, space.points.schema["x"].dataType)
    return own if own and own.rows and width_of(space) >= WIDE and 8 * space.n_points <= BLOCK_BYTES else None


def block_distances(space: Space, drawn: DataFrame, wanted: Sequence[tuple[int, int]], kernel: Kernel) -> DataFrame:
    """``drawn`` (``t`` and ids ``i0``, ``i1``, ...) with the distance columns of the ``wanted`` pairs of ids."""
    spark, names = space.spark, drawn.columns
    shipped(spark)
    used = sorted({k for p in wanted for k in p})
    width = width_of(space)
    id_type = "<i4" if space.n_points < 1 << 31 else "<i8"  # the smallest number types that hold an id, and below a count within a block
    types = {c: "<i8" if c == "t" else id_type for c in names}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.column(c).to_numpy().astype(types[c]).tobytes()], pa.binary()) for c in names], names=names)

    packed = stored(drawn.mapInArrow(pack, ", ".join(f"`{c}` binary" for c in names)).withColumn("key", F.monotonically_increasing_id()), "tuples")
    found = packed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()
    asked = [f"i{k}" for k in used]
    most = found.bytes // 8 * len(asked)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.frombuffer(v, id_type) for v in row.values()])).astype(np.int64))], names=["pid"])

    own = space.points.select("pid", "x")
    if most < space.n_points:
        ids = packed.select(*asked).mapInArrow(named, "pid long").distinct()
        own = own.join(F.broadcast(ids) if most <= ASKED else ids, "pid", "left_semi")
    per = max(1, min(width, BLOCK_BYTES // (8 * max(1, min(most, space.n_points)))))
    blocks = -(-width // per)
    part_type = kernel.code(per)
    splits = max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks), -(-found.n // SPLIT_ROWS))
    x_type = _TYPES[space.points.schema["x"].dataType.elementType.typeName()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PIECE_BYTES // (8 * width))
        for b in batches:
            for k in range(0, b.num_rows, step):
                piece = b.slice(k, step)
                ids, x = piece.column("pid").to_numpy(), Codes().matrix(piece.column("x")).astype(x_type, copy=False)
                for at in range(blocks):
                    cells = [ids.astype(id_type).tobytes(), x[:, at * per : (at + 1) * per].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([int(ids[0])], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["b", "key", "ids", "x"])

    none = F.lit(None).cast("binary")
    packed_points = own.mapInArrow(pieces, "b int, key long, ids binary, x binary")
    points = packed_points.select("b", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("s"), F.lit(0).alias("kind"), "key", "ids", "x", *(none.alias(c) for c in asked))
    tuples = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("key"), F.lit(splits)).cast("int").alias("s"), F.lit(1).alias("kind"), "key", none.alias("ids"), none.alias("x"), *asked)
    slot = {k: j for j, k in enumerate(used)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, order, x = None, [], None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("b", "s", "kind")])
            edges = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()
            for s, e in zip([0, *edges], [*edges, b.num_rows]):
                part, where = b.slice(s, e - s), tuple(keys[:2, s])
                if where != at:
                    at, held, ids, order, x = where, [], None, None, None
                if not keys[2, s]:
                    for row in part.select(["ids", "x"]).to_pylist():
                        own = np.frombuffer(row["ids"], id_type)
                        held.append((own, np.frombuffer(row["x"], x_type).reshape(len(own), -1)))
                    continue
                if x is None:
                    ids, x = (np.concatenate([h[j] for h in held]) for j in (0, 1))
                    held, order = [], np.argsort(ids)
                for row in part.to_pylist():
                    where_at = [order[np.searchsorted(ids, np.frombuffer(row[c], id_type), sorter=order)] for c in asked]
                    n = len(where_at[0])
                    out, step = np.zeros((len(wanted), n), part_type), max(1, AT_ONCE // max(1, x.itemsize * x.shape[1]))
                    for k in range(0, n, step):
                        for j, (p, q) in enumerate(wanted):
                            out[j, k : k + step] = kernel.rows(x[where_at[slot[p]][k : k + step]], x[where_at[slot[q]][k : k + step]])
                    yield pa.RecordBatch.from_arrays([pa.array([row["key"]], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["key", "part"])

    parts = points.unionByName(tuples).repartitionById(blocks * splits, F.expr(f"b * {splits} + s")).sortWithinPartitions("b", "s", "kind", "key").mapInArrow(count, "key long, part binary")
    distances = [distance_name(*p) for p in wanted]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                columns = [np.frombuffer(now[c], types[c]).astype(np.int64) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, *sums.reshape(len(wanted), -1).astype(np.float64)]], names=[*names, *distances])

        for b in batches:
            for row in b.to_pylist():
                if row["part"] is None:
                    yield from done()
                    now, sums = row, np.zeros(len(row[names[0]]) // np.dtype(types[names[0]]).itemsize * len(wanted), np.int64)
                else:
                    sums += np.frombuffer(row["part"], part_type)
        yield from done()

    every = packed.select("key", none.alias("part"), *names).unionByName(parts.select("key", "part", *(none.alias(c) for c in names)))
    schema = ", ".join([*(f"`{c}` long" for c in names), *(f"{d} double" for d in distances)])
    return every.repartition("key").sortWithinPartitions("key", F.col("part").isNotNull()).mapInArrow(total, schema)
