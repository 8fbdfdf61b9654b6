"""Near-duplicate vectors by lattice hashing.

Each table projects unit vectors at random into blocks of eight dimensions and
decodes each block to its nearest point of the E8 lattice; the points are the
vector's cell. A vector also probes the ``probes`` neighbouring cells that are
next nearest, a step to one of the 240 minimal vectors of E8 in one block. Two
vectors meet in a cell that is home to one of them and home or probed to the
other, and are linked if their cosine in double precision is at least the
threshold.

Cells are finer, and tables more, the more vectors there are (``shape``), so an
unrelated vector is met far more seldom than in proportion to the table; each
shape finds a pair at cosine 0.9 in 0.95 and more of all cases, and closer ones
more surely, whatever the data; tests measure it against brute force.

Equal vectors are one class with a count. What meets in cells is slim: a class
id and a sketch of 128 signs of random projections. Only rows with a partner
whose sketch is near enough go on (a pair at the threshold differs in that many
signs in fewer than one of 10^7 cases), and only they meet their vectors, once.
Within a cell, sketches and cosines are compared as matrices; pairs never become
rows. A pair that meets more than once counts in its first cell only, which both
vectors' cell codes tell. A cell of more than ``BLOCK`` rows is split into pairs
of blocks, which are tasks of their own. A cell sends link counts by class, and
links that join its components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and neither do vectors of different lengths;
null ids take part and are no smallest id unless all are null; repeated rows are
other vectors of one class; an empty table gives an empty table; other columns
are not read. Classes are told by 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._common import emitted, grouped, join_counted, schema_of, stored
from tesserae.llm.components import components

PROBES, BLOCK, SKETCH_BITS = 4, 2048, 128
#: Up to so many vectors: tables, blocks a table, cell width. Measured at cosine 0.9: a table brings a pair
#: together in 0.40, 0.15 and 0.11 of all cases, and unrelated vectors in 4e-4, 4e-6 and 1e-6 or fewer.
SHAPES = ((1 << 17, 8, 2, 2.25), (1 << 23, 26, 2, 1.6), (1 << 62, 36, 4, 2.6))
#: Crowded cells are told to all executors up to this size.
SENT_BYTES = 64 << 20


def shape(n: int) -> tuple[int, int, float]:
    """Tables, blocks and cell width for ``n`` vectors."""
    return next(s[1:] for s in SHAPES if n <= s[0])


def sketch_limit(cosine: float) -> int:
    """In how many signs the sketches of a pair at ``cosine`` differ at most, but for one pair in 10^7."""
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return int(np.ceil(SKETCH_BITS * p + 5.3 * np.sqrt(SKETCH_BITS * p * (1 - p))))


def e8_minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    out = np.rint(x)
    odd = np.flatnonzero(out.sum(-1) % 2)
    off = x[odd] - out[odd]
    at = np.abs(off).argmax(-1)
    out[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1.0, -1.0)
    return out


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight: the nearer one of D8 and D8 shifted by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1)
    return np.where(nearer[:, None], a, b)


class Lattice:
    """Cell codes of unit vectors of one length: ``codes(x)[i, t]`` is the home cell and the probed ones."""

    def __init__(self, dim: int, tables: int, probes: int, blocks: int, width: float, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.tables, self.probes, self.blocks, self.steps = tables, probes, blocks, e8_minimal()
        self.project = rng.standard_normal((dim, tables * blocks * 8)) / width
        self.shift = rng.random(tables * blocks * 8) * 2
        self.mix = rng.integers(1, 1 << 63, (tables, blocks, 8), dtype=np.uint64) | np.uint64(1)
        self.planes = np.random.default_rng([seed, dim, 1]).standard_normal((dim, SKETCH_BITS))
        twice = (2 * self.steps).astype(np.int64).astype(np.uint64)
        self.moved = np.concatenate([twice @ m for m in self.mix.reshape(-1, 8)]).reshape(tables, -1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        y = (x @ self.project + self.shift).reshape(n, self.tables, self.blocks, 8)
        p = e8_nearest(y.reshape(-1, 8)).reshape(y.shape)
        home = ((2 * p).astype(np.int64).astype(np.uint64) * self.mix).sum((2, 3), dtype=np.uint64)
        out = np.empty((n, self.tables, 1 + self.probes), np.uint64)
        out[:, :, 0] = home
        for t in range(self.tables):  # all steps are equally long: the nearest cells lie most in the residual's direction
            gain = ((y[:, t] - p[:, t]).reshape(-1, 8) @ self.steps.T).reshape(n, -1)
            near = np.argpartition(-gain, self.probes, 1)[:, : self.probes] if self.probes else np.empty((n, 0), int)
            out[:, t, 1:] = home[:, t, None] + self.moved[t][near]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        return (out >> np.uint64(32)).astype(np.uint32)

    def sketches(self, x: np.ndarray) -> np.ndarray:
        """Signs of random projections, packed: (n, SKETCH_BITS / 8) bytes."""
        return np.packbits(x @ self.planes > 0, axis=1)


def raw(vector: list | None) -> bytes | None:
    """Components as 32-bit floats where those are exact, else as 64-bit ones; None if the vector can't link."""
    if not vector or None in vector:
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return short.tobytes() if (short == x).all() else x.tobytes()


def unit(values: list[bytes], dim: int) -> np.ndarray:
    """Rows of length 1 in double precision."""
    if len(values[0]) == 4 * dim and len({*map(len, values)}) == 1:
        x = np.frombuffer(b"".join(values), np.float32).astype(np.float64).reshape(-1, dim)
    else:
        x = np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in values], np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _blobs(a: np.ndarray) -> pa.Array:
    """Rows of a contiguous array as binary values."""
    a = np.ascontiguousarray(a)
    size = a.itemsize * int(np.prod(a.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, (len(a) + 1) * size, size, dtype=np.int32)), pa.py_buffer(a.tobytes())])


def _classes(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows ``id, cid, dim, x`` of every row; all but the id null if the vector can't link."""
    fields = [("id", "long"), ("cid", "long"), ("dim", "int"), ("x", "binary")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    x = raw(v)
                    yield (key, None, None, None) if x is None else (key, xxhash.xxh3_64_intdigest(x, len(v)) - (1 << 63), len(v), x)

        return emitted(rows(), fields, 4096)

    return df.select(F.col(id_col).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, schema_of(fields))


CODED = [("cid", "long"), ("mult", "long"), ("dim", "int"), ("x", "binary"), ("sketch", "binary"), ("codes", "array<int>")]


def _coded(classes: DataFrame, tables: int, probes: int, blocks: int, width: float, seed: int) -> DataFrame:
    """Classes ``cid, mult, dim, x`` with their sketch and cell codes, ``1 + probes`` a table."""
    made: dict[int, Lattice] = {}
    per = tables * (1 + probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, xs = b.column(2).to_pylist(), b.column(3).to_pylist()
            for dim in sorted({*dims}):
                at = [k for k, d in enumerate(dims) if d == dim]
                if dim not in made:
                    made[dim] = Lattice(dim, tables, probes, blocks, width, seed)
                for s in range(0, len(at), max(1, 40_000 // per)):
                    part = at[s : s + max(1, 40_000 // per)]
                    x = unit([xs[k] for k in part], dim)
                    codes = made[dim].codes(x).reshape(-1).view(np.int32)
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * per)
                    heads = [c.take(pa.array(part, pa.int32())) for c in b.columns[:4]]
                    yield pa.RecordBatch.from_arrays([*heads, _blobs(made[dim].sketches(x)), pa.ListArray.from_arrays(ends, pa.array(codes))], names=[f for f, _ in CODED])

    return classes.select("cid", "mult", "dim", "x").mapInArrow(run, schema_of(CODED))


def _first_meeting(t: int, cell: int, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Whether rows of codes meet first in ``cell`` of table ``t``; shapes (pairs, tables, 1 + probes)."""
    in_x = (cx == cy[:, :, :1]).any(2)  # the home of y is a cell of x
    in_y = (cy == cx[:, :, :1]).any(2)
    before = (in_x[:, :t] | in_y[:, :t]).any(1)
    hx, hy = cx[:, t, 0], cy[:, t, 0]
    first = np.where(in_x[:, t] & in_y[:, t], np.minimum(hx, hy), np.where(in_x[:, t], hy, hx))
    return ~before & (first == cell & 0xFFFFFFFF)


class _Cell:
    """Rows of one cell, or of two of its blocks, and the links among them."""

    def __init__(self, tables: int, probes: int, cosine: float) -> None:
        self.shape, self.cosine, self.limit = (tables, 1 + probes), cosine, sketch_limit(cosine)

    def likely(self, home: np.ndarray, part: np.ndarray, pair: tuple[int, int], sketches: list[bytes]) -> np.ndarray:
        """Which rows have a partner whose sketch is near enough."""
        s = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
        found, rows = np.zeros(len(s), bool), np.flatnonzero(home)
        for at in range(0, len(rows), 256):
            i = rows[at : at + 256]
            ok = sum(np.bitwise_count(s[i, None, k] ^ s[None, :, k]).astype(np.int16) for k in range(s.shape[1])) <= self.limit
            ok[np.arange(len(i)), i] = False
            if pair[0] != pair[1]:
                ok &= part[i][:, None] != part[None, :]
            found |= ok.any(0)
            found[i] |= ok.any(1)
        return found

    def links(self, t: int, cell: int, home: np.ndarray, cid: np.ndarray, mult: np.ndarray, part: np.ndarray, pair: tuple[int, int], xs: list[bytes], codes: np.ndarray) -> Iterator[tuple]:
        x = unit(xs, cell >> 32)
        c = codes.view(np.uint32).reshape(len(xs), *self.shape)
        # Homes against all; a pair of homes once. Cells over two blocks: only pairs across them.
        rows = np.flatnonzero(home)
        hits_i, hits_j = [], []
        for s in range(0, len(rows), 512):
            i = rows[s : s + 512]
            ok = x[i] @ x.T >= self.cosine
            ok &= ~home[None, :] | (i[:, None] < np.arange(len(x))[None, :])
            if pair[0] != pair[1]:
                ok &= part[i][:, None] != part[None, :]
            a, b = np.nonzero(ok)
            hits_i.append(i[a])
            hits_j.append(b)
        i, j = np.concatenate(hits_i), np.concatenate(hits_j)
        first = np.concatenate([_first_meeting(t, cell, c[i[s : s + 65536]], c[j[s : s + 65536]]) for s in range(0, len(i), 65536)]) if len(i) else np.empty(0, bool)
        i, j = i[first], j[first]
        if not len(i):
            return
        n = np.zeros(len(x), np.int64)
        np.add.at(n, i, mult[j])
        np.add.at(n, j, mult[i])
        root = np.arange(len(x))
        while True:  # smallest linked row, until nothing changes
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        for k in np.flatnonzero(n):
            yield int(cid[k]), int(n[k]), int(cid[root[k]])


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, tables: int | None = None, probes: int = PROBES, blocks: int | None = None, width: float | None = None, seed: int = 11) -> DataFrame:
    """One row per row of ``df``: id, ``n_links``, ``component_id``, ``kept``. Tables, blocks and width follow from the number of vectors unless given."""
    rows = stored(_classes(df, id_col, vector), "vectors")
    usual = shape(rows.where("cid IS NOT NULL").count())
    tables, blocks, width = tables or usual[0], blocks or usual[1], width or usual[2]
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("mult"), F.first("dim").alias("dim"), F.first("x").alias("x"))
    coded = stored(_coded(classes, tables, probes, blocks, width, seed), "coded-vectors")

    each = coded.select("cid", "sketch", "dim", F.posexplode("codes").alias("_at", "_code"))
    cell = F.shiftleft(F.pmod("dim", F.lit(1 << 24)).cast("long"), 32).bitwiseOR(F.col("_code").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    slim = each.select("cid", "sketch", F.floor(F.col("_at") / (1 + probes)).cast("int").alias("t"), cell.alias("cell"), (F.col("_at") % (1 + probes) == 0).alias("home"))
    crowded = slim.groupBy("t", "cell").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("t", "cell", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    crowded = stored(crowded, "crowded")
    met = slim.join(F.broadcast(crowded) if 48 * crowded.count() <= SENT_BYTES else crowded, ["t", "cell"], "left")
    met = met.withColumn("part", F.pmod(F.xxhash64("cid"), F.coalesce("parts", F.lit(1))).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = met.select("t", "cell", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"), "home", "cid", "part", "sketch")
    names, n = ["t", "cell", "lo", "hi"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kernel, fields = _Cell(tables, probes, cosine), [("cid", "long"), ("n", "long"), ("to", "long")]

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, 4):
            home = g.column("home").to_numpy()
            if g.num_rows > 1 and home.any():
                found = kernel.likely(home, g.column("part").to_numpy(), (g.column("lo")[0].as_py(), g.column("hi")[0].as_py()), g.column("sketch").to_pylist())
                if found.any():
                    yield from g.drop_columns(["sketch"]).filter(pa.array(found)).combine_chunks().to_batches()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple]:
            for g in grouped(batches, 4):
                home = g.column("home").to_numpy()
                t, c, lo, hi = (g.column(k)[0].as_py() for k in range(4))
                cid, mult, part = (g.column(k).to_numpy() for k in ("cid", "mult", "part"))
                codes = np.ascontiguousarray(pa.compute.list_flatten(g.column("codes")).to_numpy())
                yield from kernel.links(t, c, home, cid, mult, part, (lo, hi), g.column("x").to_pylist(), codes)

        return emitted(links(), fields)

    likely_schema = met.drop("sketch").schema
    near = met.repartition(n, *names).sortWithinPartitions(*names).mapInArrow(likely, likely_schema)
    near = stored(near, "likely-vectors").join(coded.select("cid", "mult", "x", "codes"), "cid").select(*names, "home", "cid", "part", "mult", "x", "codes")
    found = stored(near.repartition(n, *names).sortWithinPartitions(*names).mapInArrow(join, schema_of(fields)), "vector-links")

    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b")).where("a <> b").distinct())
    own = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("mult"), F.min("id").alias("first"))
    own = own.join(counts, "cid", "left").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
    own = stored(own.select("cid", F.coalesce("label", "cid").alias("label"), "mult", "first", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "vector-classes")
    least = stored(own.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n_rows")), "vector-components")
    own = join_counted(own, least, ["label"]).select("cid", "n_links", "component_id", F.col("mult").alias("n_rows"))
    out = join_counted(rows.select("id", "cid"), stored(own, "vector-verdicts"), ["cid"], "left")
    out = out.withColumn("component_id", F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
