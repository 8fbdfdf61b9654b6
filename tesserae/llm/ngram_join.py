"""N-gram Jaccard self-join: rare-first prefixes, length, positional and suffix filters.

1. Sets. Each text becomes the sorted hashes of its distinct shingles, once; the
   sets are written and all later steps read those. Equal sets are one class
   (key and size); only classes are joined.
2. Order. Occurrences are counted over the whole corpus in hash cells, about one
   for 20 shingles; how frequent a shingle's cell is, then its hash, is the
   global order, rare first. Any order gives the same links; a good one gives
   short lists. At most 2^25 cells, so with a very large corpus what stands out
   are shingles more frequent than the noise of a cell.
3. Prefixes. A class enters the lists of its first n - ceil(t n) + 1 shingles.
   Lists of one class are dropped, and lists of mostly the same members are put
   together, so that near copies share one list instead of hundreds. Shingles
   ``CROWDED`` more frequent than the mean travel as rows, not as lists, so no
   task holds a long list.
4. Candidates are members of one list that pass the length filter (t), the
   positional filter, and the suffix filter: both sets are partitioned by hash
   range, and the sum of the smaller counts bounds the overlap. The positional
   filter takes the shared shingle for the first one of the pair, so that all of
   the overlap lies from there on: a linked pair passes it in the list of its
   first shared shingle. In a list that took in others a member has the least of
   its places, with which no such pair is lost.
5. Verification intersects the two sets, once a pair; pairs are remembered. The
   set met by many others is sent once for each 512 of them.

Only links that change components are needed, so pairs are proposed in rounds:
members of a list against one member whose component differs, first the one
with most neighbours, then one drawn anew in each round, as long as many such
pairs are left and links are found; then all pairs of different components.
Copies and members of one component are never paired, and no link between
components is missed.

Lists, classes and components with a large part of all rows are joined apart
(``join_counted``), so they fill no task.

Defined cases: null and empty texts and texts without words have empty sets
and link with nothing; null ids take part and are no smallest id unless all are
null; repeated rows are one class; an empty table gives an empty table; other
columns are not read. Two different sets of the same size are taken for one if
their 64-bit keys collide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._common import as_bytes, batches_of, emitted, free_name, grouped, join_counted, schema_of, stored, trimmed
from tesserae.llm.components import components
from tesserae.llm.shingles import CellCounts, cell_bits, cells, rarity, set_key, shingle_set
from tesserae.sources.shared import scratch

#: Cells that hold so many shingles more than the mean send theirs as rows.
CROWDED = 20_000
#: Rounds against a drawn member end when all remaining pairs are fewer than so many times the list entries.
PAIRS_PER_ENTRY, MAX_ROUNDS = 16, 8
FLUSH, BLOCK, MERGED = 250_000, 2048, 100_000
#: Lists of so many tasks meet once more to be put together, so no task sees all lists of a large group.
MET_TASKS = 1024
#: Up to so many classes are told to all executors when sets are fetched: 24 MB; more are joined.
SENT_CLASSES = 1_000_000
#: Bytes of text for each task that gathers lists.
TASK_BYTES = 128 << 20
#: Rows with a set in an Arrow batch.
SET_ROWS = 256
#: Members of a pairing that share one copy of the set they are compared with.
FAN = 512


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _rarest(a: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    """Indices of the first ``size`` hashes by count, then hash."""
    if size < len(a):
        bound = np.partition(c, size - 1)[size - 1]
        at = np.flatnonzero(c <= bound)  # a is sorted, so a stable sort by count does
        return at[np.argsort(c[at], kind="stable")][:size]
    return np.argsort(c, kind="stable")


def _sets(df: DataFrame, id_col: str, text: str, width: int, bits: int) -> DataFrame:
    """Rows ``id, n, key, text_hash, set`` of every document, and ``slice, set`` of the cell counts of a task.

    A task writes the set of a class once; its other documents have a null one.
    """
    fields = [("id", "long"), ("n", "int"), ("key", "long"), ("text_hash", "long"), ("slice", "int"), ("set", "binary")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = CellCounts(bits), set()

        def rows() -> Iterator[tuple]:
            for b in batches:
                for key, t, h in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist()):
                    a = shingle_set(t, width)
                    for k, blob in counts.add(a):
                        yield None, None, None, None, k, blob
                    head = (len(a), set_key(a))
                    yield key, *head, h, None, a.tobytes() if len(a) and head not in seen else None
                    seen.add(head)
            for k, blob in counts.end():
                yield None, None, None, None, k, blob

        return trimmed(emitted(rows(), fields))

    return stored(df.select(F.col(id_col).cast("long"), F.col(text).cast("string"), F.xxhash64(text)).mapInArrow(run, schema_of(fields)), "sets")


def _bins(a: np.ndarray) -> bytes:
    """Counts of the set by hash range, a power of two of ranges with one or two hashes each; empty if one is crowded."""
    bits = len(a).bit_length() - 1
    c = np.bincount((a >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64), minlength=1 << bits)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else b""


def _overlap_bound(x: bytes, y: bytes) -> int | None:
    """At most so many hashes are in both sets; None if not known."""
    if not x or not y:
        return None
    if len(x) < len(y):
        x, y = y, x
    u, v = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8)
    return int(np.minimum(u.reshape(len(y), -1).sum(1), v).sum())


#: Rows of lists: kind g: a = least key, n members, pos = which tasks' lists it meets; kind h: a = shingle, one member; kind s: key, n, bins.
ENTRY = [("kind", "string"), ("a", "long"), ("key", "long"), ("n", "int"), ("pos", "int"), ("blob", "binary")]
_POST = np.dtype([("tok", "<u4"), ("bucket", "<u4"), ("key", "<i8"), ("n", "<u4"), ("pos", "<u4")])


_MEMBER = np.dtype([("key", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("deg", "<u8")])
#: A list joins a longer one that holds this share of its members.
SHARED = 0.8


def _merged(lists: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Lists put together where one holds most of another's members, ``MERGED`` members at a time."""
    held, size = [], 0
    for rows in lists:
        held.append(rows)
        size += len(rows)
        if size >= MERGED:
            yield from _put_together(held)
            held, size = [], 0
    yield from _put_together(held)


def _put_together(lists: list[np.ndarray]) -> list[np.ndarray]:
    """Each pair of members of a list is in one of the results, each member with the
    least of its places in the lists that it stands for. Degrees of a member add up.
    """
    kept: list[dict[tuple[int, int], list[int]]] = []
    home: dict[tuple[int, int], int] = {}
    for rows in sorted(lists, key=lambda x: (-len(x), x["key"].tolist())):
        heads = list(zip(rows["key"].tolist(), rows["n"].tolist()))
        votes = Counter(home[h] for h in heads if h in home)
        best, most = min(votes.items(), key=lambda v: (-v[1], v[0]), default=(None, 0))
        # ``votes`` only sees each member's first list; the best one is then counted in full.
        if best is not None and most and sum(h in kept[best] for h in heads) >= SHARED * len(heads):
            own = kept[best]
        else:
            best, own = len(kept), {}
            kept.append(own)
        for h, p, d in zip(heads, rows["pos"].tolist(), rows["deg"].tolist()):
            if h in own:
                own[h] = [min(own[h][0], p), own[h][1] + d]
            else:
                own[h] = [p, d]
            home.setdefault(h, best)
    out = []
    for own in kept:
        rows = np.array([(k, n, p, d) for (k, n), (p, d) in own.items()], _MEMBER)
        out.append(rows[np.lexsort((rows["n"], rows["key"]))])
    return out


def _prefixes(sets: DataFrame, rare: np.ndarray, crowd: int, bits: int, n_parts: int, percent: int) -> DataFrame:
    """Lists of at least two classes, entries of crowded shingles, and the bins of all classes."""
    n_buckets, told = n_parts * 8, sets.sparkSession.sparkContext.broadcast(rare)
    fields = [("bucket", "int"), *ENTRY]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, counted = 0, told.value

        def flush() -> Iterator[tuple]:
            nonlocal size
            if held:
                posts = np.concatenate(held)
                posts = posts[np.argsort(posts["bucket"], kind="stable")]
                at = np.flatnonzero(np.r_[True, posts["bucket"][1:] != posts["bucket"][:-1], True])
                for s, e in zip(at[:-1], at[1:]):
                    cols = b"".join(np.ascontiguousarray(posts[c][s:e]).tobytes() for c in ("tok", "key", "n", "pos"))
                    yield int(posts["bucket"][s]), "p", None, None, int(e - s), None, cols
            held.clear()
            size = 0

        def rows() -> Iterator[tuple]:
            nonlocal size
            for b in batches:
                for key, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    a = np.frombuffer(data.as_buffer(), np.uint64)
                    c = counted[cells(a, bits)]
                    order = _rarest(a, c, prefix_length(n, percent))
                    tokens, crowded = a[order], c[order] >= crowd
                    posts = np.empty(len(order), _POST)
                    posts["tok"], posts["bucket"], posts["key"], posts["n"], posts["pos"] = tokens >> np.uint64(32), tokens % np.uint64(n_buckets), key, n, np.arange(len(order))
                    for k in np.flatnonzero(crowded).tolist():
                        yield (key + k) % n_buckets, "h", int(tokens[k].astype(np.int64)), key, n, k, None
                    held.append(posts[~crowded])
                    size += len(order)
                    yield key % n_buckets, "s", None, key, n, None, _bins(a)
                    if size >= FLUSH:
                        yield from flush()
            yield from flush()

        return trimmed(emitted(rows(), fields, 2048))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def lists() -> Iterator[tuple]:
            if not held:
                return
            p = np.concatenate(held)
            held.clear()
            p = p[np.lexsort((p["key"], p["tok"], p["bucket"]))]
            fresh = np.r_[True, (p["bucket"][1:] != p["bucket"][:-1]) | (p["tok"][1:] != p["tok"][:-1])]
            again = ~fresh & np.r_[False, (p["key"][1:] == p["key"][:-1]) & (p["n"][1:] == p["n"][:-1])]
            p, fresh = p[~again], fresh[~again]
            at = np.flatnonzero(np.r_[fresh, True])
            found: list[np.ndarray] = []
            for k in np.flatnonzero(np.diff(at) > 1).tolist():
                rows = np.empty(at[k + 1] - at[k], _MEMBER)
                for c in ("key", "n", "pos"):
                    rows[c] = p[c][at[k] : at[k + 1]]
                rows["deg"] = len(rows)
                found.append(rows)
            found.sort(key=lambda x: int(x["key"][0]))
            for rows in _merged(iter(found)):
                yield "g", int(rows["key"][0]), None, len(rows), TaskContext.get().partitionId() // MET_TASKS, rows.tobytes()

        def rows() -> Iterator[tuple]:
            for b in batches:
                kinds = b.column(1).to_pylist()
                for k, kind in enumerate(kinds):
                    if kind == "p":
                        n, blob, at = b.column(4)[k].as_py(), b.column(6)[k].as_py(), 0
                        posts = np.empty(n, _POST)
                        posts["bucket"] = b.column(0)[k].as_py()
                        for c in ("tok", "key", "n", "pos"):
                            posts[c] = np.frombuffer(blob, _POST[c], n, at)
                            at += n * _POST[c].itemsize
                        held.append(posts)
                    else:
                        yield tuple(b.column(c)[k].as_py() for c in range(1, 7))
            yield from lists()

        return trimmed(emitted(rows(), ENTRY, 1024))

    posted = sets.select("key", "n", "set").mapInArrow(emit, schema_of(fields))
    with batches_of(sets.sparkSession, SET_ROWS):
        return stored(posted.repartition(n_parts, "bucket").mapInArrow(gather, schema_of(ENTRY)), "prefixes")


def _members(lists: DataFrame, n_parts: int) -> DataFrame:
    """One row a list and member: ``g, key, n, pos, degree``; ``degree`` adds up to the sizes of all lists a member was in."""
    fields = [("g", "long"), ("key", "long"), ("n", "int"), ("pos", "int"), ("degree", "long")]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _merged(np.frombuffer(blob, _MEMBER) for b in batches for blob in b.column(1).to_pylist()):
            gid = set_key(np.ascontiguousarray(rows["key"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), gid)), *(pa.array(rows[c].astype(t)) for c, t in (("key", np.int64), ("n", np.int32), ("pos", np.int32), ("deg", np.int64)))], names=[f for f, _ in fields])

    grouped_lists = lists.where("kind = 'g'").select("a", "blob", "pos").repartition(n_parts, "a", "pos").sortWithinPartitions("a", "pos").mapInArrow(spread, schema_of(fields))
    crowded = lists.where("kind = 'h'").select(F.col("a").alias("g"), "key", "n", "pos").distinct().withColumn("degree", F.lit(1).cast("long"))
    rows = stored(grouped_lists.unionByName(crowded), "entries")
    degree = rows.groupBy("key", "n").agg(F.sum("degree").alias("degree"))
    return stored(rows.drop("degree").join(degree, ["key", "n"]), "members")


def _possible(percent: int) -> F.Column:
    """Length and positional filter of the columns n, pos (of a) and m, at (of b)."""
    need = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("n") - F.col("pos") >= need) & (F.col("m") - F.col("at") >= need)


def _need(n: int, m: int, percent: int) -> int:
    """The overlap at which 100 |A and B| >= percent |A or B|."""
    return -(-percent * (n + m) // (100 + percent))


class _List:
    """Members of one list, or of two of its blocks, as arrays."""

    def __init__(self, rows: pa.Table) -> None:
        self.key, self.n, self.pos, self.label, self.part = (rows.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "pos", "label", "part"))
        self.bins = rows.column("blob").to_pylist()
        self.folds: dict[tuple[int, int], np.ndarray] = {}

    def folded(self, k: int, size: int) -> np.ndarray:
        if (k, size) not in self.folds:
            self.folds[k, size] = np.frombuffer(self.bins[k], np.uint8).astype(np.uint16).reshape(size, -1).sum(1, dtype=np.uint16)
        return self.folds[k, size]

    def pairs(self, across: bool, percent: int) -> Iterator[tuple[int, int, int, int]]:
        """Pairs of different components that pass the length, positional and suffix filters."""
        n, pos = self.n, self.pos
        size = np.array([len(b) for b in self.bins])
        for i in range(len(n) - 1):
            m, at = n[i + 1 :], pos[i + 1 :]
            need = -(-percent * (n[i] + m) // (100 + percent))
            ok = (self.label[i + 1 :] != self.label[i]) & (100 * np.minimum(n[i], m) >= percent * np.maximum(n[i], m)) & (n[i] - pos[i] >= need) & (m - at >= need)
            if across:
                ok &= self.part[i + 1 :] != self.part[i]
            hits = np.flatnonzero(ok)
            for width in np.unique(np.minimum(size[hits + i + 1], size[i])).tolist():
                own = hits[np.minimum(size[hits + i + 1], size[i]) == width]
                if width:
                    y = np.stack([self.folded(j, width) for j in (own + i + 1).tolist()])
                    own = own[np.minimum(y, self.folded(i, width)).sum(1, dtype=np.int64) >= need[own]]
                for j in (own + i + 1).tolist():
                    a, b = (i, j) if (self.key[i], n[i]) < (self.key[j], n[j]) else (j, i)
                    yield int(self.key[a]), int(n[a]), int(self.key[b]), int(n[b])


def _pairs_within(members: DataFrame, percent: int, n_parts: int) -> DataFrame:
    """Candidates ``a, n, b, m`` among list members ``g, s, key, n, pos, label, blob``; lists of more than ``BLOCK`` in pairs of blocks."""
    parts = F.ceil(F.col("s") / BLOCK).cast("int")
    rows = members.withColumn("label", F.xxhash64("label")).withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    names, fields = ["g", "lo", "hi"], [("a", "long"), ("n", "int"), ("b", "long"), ("m", "int")]
    rows = rows.select("g", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"), "part", "key", "n", "pos", "label", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple] = set()

        def pairs() -> Iterator[tuple]:
            for rows in grouped(batches, 3):
                for pair in _List(rows).pairs(rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py(), percent):
                    if pair not in told:
                        if len(told) > FLUSH:
                            told.clear()
                        told.add(pair)
                        yield pair

        return trimmed(emitted(pairs(), fields))

    return rows.repartition(n_parts, *names).sortWithinPartitions(*names).mapInArrow(run, schema_of(fields))


def _ends() -> tuple[F.Column, F.Column]:
    """The two classes of a pair ``a, n, b, m``."""
    return F.struct(F.col("a").alias("key"), "n"), F.struct(F.col("b").alias("key"), F.col("m").alias("n"))


def _overlapping(n: int, m: int, x: bytes, y: bytes, percent: int) -> bool:
    """The suffix filter on two bins."""
    most = _overlap_bound(x, y)
    return most is None or most >= _need(n, m, percent)


def _linked(n: int, m: int, x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets reach the threshold."""
    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
    return 100 * both >= percent * (n + m - both)


class _Join:
    """Verifies pairs of classes ``a, n, b, m`` and remembers them."""

    def __init__(self, sets: DataFrame, lists: DataFrame, percent: int, n_parts: int) -> None:
        self.sets, self.percent, self.n_parts = sets, percent, n_parts
        self.bins = lists.where("kind = 's'").select("key", "n", "blob").dropDuplicates(["key", "n"])
        self.fetched: DataFrame | None = None
        self.known: DataFrame | None = None

    def new(self, pairs: DataFrame) -> DataFrame:
        """Pairs that were not verified before."""
        if self.known is None:
            return pairs
        keyed = pairs.withColumns({"lo": F.least(*_ends()), "hi": F.greatest(*_ends())})
        return keyed.join(self.known, ["lo", "hi"], "left_anti").drop("lo", "hi")

    def wanted(self, ends: DataFrame) -> DataFrame:
        """``key, n, blob``: the sets of at least the classes ``ends``; those of earlier rounds are kept."""
        new = stored(ends if self.fetched is None else ends.join(self.fetched.select("key", "n"), ["key", "n"], "left_anti"), "wanted")
        size = new.count()
        if size or self.fetched is None:
            asked = F.broadcast(new) if size <= SENT_CLASSES else new
            found = self.sets.join(asked, ["key", "n"], "left_semi").dropDuplicates(["key", "n"]).withColumnRenamed("set", "blob")
            found = stored(found, "fetched")
            self.fetched = found if self.fetched is None else self.fetched.unionByName(found)
        return self.fetched

    def against(self, pairs: DataFrame, table: DataFrame, holds: Callable[..., bool], kind: str) -> DataFrame:
        """The pairs for which ``holds(n, m, blob of a, blob of b)``; the blob of b comes once for each ``FAN`` pairs of it."""
        fields, percent = [("a", "long"), ("n", "int"), ("b", "long"), ("m", "int")], self.percent
        fans = stored(pairs.groupBy("b", "m").agg(F.count("*").alias("n_rows")).withColumn("fans", F.ceil(F.col("n_rows") / FAN).cast("int")), "fans")
        members = join_counted(pairs, fans, ["b", "m"]).withColumn("fan", F.pmod(F.xxhash64("a"), "fans").cast("int"))
        members = members.join(table.select(F.col("key").alias("a"), "n", "blob"), ["a", "n"]).select("b", "m", "fan", F.lit(1).alias("kind"), "a", "n", "blob")
        hubs = fans.join(table.select(F.col("key").alias("b"), F.col("n").alias("m"), "blob"), ["b", "m"]).withColumn("fan", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)))
        hubs = hubs.select("b", "m", "fan", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("n"), "blob")
        dealt = members.unionByName(hubs).repartition(self.n_parts, "b", "m", "fan").sortWithinPartitions("b", "m", "fan", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                hub, y = None, b""
                for batch in batches:
                    heads = zip(*(batch.column(c).to_pylist() for c in range(6)))
                    for (b, m, fan, of, a, n), x in zip(heads, batch.column(6)):
                        if of == 0:
                            hub, y = (b, m, fan), x.as_py()
                        elif hub != (b, m, fan):
                            raise ValueError("a pair without the set of its second class")
                        elif holds(n, m, x.as_py(), y, percent):
                            yield a, n, b, m

            return trimmed(emitted(rows(), fields))

        with batches_of(pairs.sparkSession, SET_ROWS):
            return stored(dealt.mapInArrow(run, schema_of(fields)), kind)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links among new distinct pairs: suffix filter, then the sets themselves."""
        pairs = stored(pairs, "pairs")
        left = self.against(pairs, self.bins, _overlapping, "candidates")
        ends = left.select(F.col("a").alias("key"), "n").unionByName(left.select(F.col("b").alias("key"), F.col("m").alias("n"))).distinct()
        links = self.against(left, self.wanted(ends), _linked, "links")
        told = pairs.select(F.least(*_ends()).alias("lo"), F.greatest(*_ends()).alias("hi"))
        self.known = told if self.known is None else self.known.unionByName(told)
        return links


def _labelled(df: DataFrame, id_col: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``id, n, key, text_hash`` of every document, and ``key, n, label, n_rows`` of every class; a label is one of its component's classes.

    Both are tables of their own; sets, lists and pairs are removed.
    """
    with scratch(df.sparkSession) as keep:
        docs, classes = _classes(df, id_col, text, width, percent)
        return keep(docs, "documents"), keep(classes, "classes")


def _classes(df: DataFrame, id_col: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    n_bytes = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    n_parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))
    bits = cell_bits(n_bytes)
    made = _sets(df, id_col, text, width, bits)
    docs, sets = made.where("slice IS NULL").select("id", "n", "key", "text_hash"), made.where("slice IS NULL AND set IS NOT NULL").select("key", "n", "set")
    rare, mean = rarity(made.where("slice IS NOT NULL").select("slice", F.col("set").alias("blob")), bits)
    lists = _prefixes(sets, rare, int(4 * np.sqrt(mean + CROWDED)), bits, n_parts, percent)
    members, join = _members(lists, n_parts), _Join(sets, lists, percent, n_parts)
    entries, links, labels, most, few = members.count(), None, None, 0, False
    own_label = F.struct("key", "n")

    def labelled() -> DataFrame:
        if labels is None:
            return members.withColumn("label", own_label)
        return members.join(labels.select("node.key", "node.n", "label"), ["key", "n"], "left").withColumn("label", F.coalesce("label", own_label))

    for turn in range(MAX_ROUNDS + 1):
        own = stored(labelled(), "labelled")
        # Lists whose members are not yet one component, and the pairs left in them.
        per = own.groupBy("g", "label").agg(F.count("*").alias("c"))
        open_lists = stored(per.groupBy("g").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("d")).where("d > 1").select("g", "s", "q", F.col("s").alias("n_rows")), "open")
        left = open_lists.agg(F.coalesce(F.sum((F.col("s").cast("double") * F.col("s") - F.col("q")) / 2), F.lit(0.0))).first()[0]
        last = left <= PAIRS_PER_ENTRY * entries or few or turn == MAX_ROUNDS
        if last:
            within = join_counted(own, open_lists.select("g", "s", "n_rows"), ["g"]).join(join.bins, ["key", "n"])
            pairs = join.new(_pairs_within(within, percent, n_parts).distinct())
        else:
            rank = F.struct("degree", "key") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "key"), "key")
            drawn = F.max_by(F.struct(F.col("key").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("label").alias("other")), rank)
            heads = own.groupBy("g").agg(drawn.alias("h")).join(open_lists.select("g", "n_rows"), "g")
            met = join_counted(own, stored(heads.select("g", "h.*", "n_rows"), "heads"), ["g"])
            pairs = met.where((F.col("label") != F.col("other")) & _possible(percent)).withColumnRenamed("key", "a").groupBy("a", "n", "b", "m").agg(F.count("*").alias("c"))
            best = join.new(pairs).groupBy("a", "n").agg(F.max_by(F.struct("b", "m"), F.struct("c", "b")).alias("h"))
            pairs = best.select("a", "n", "h.b", "h.m")
        found = join.verified(pairs).select(*(c.alias(x) for c, x in zip(_ends(), "ab")))
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        if last:
            break
        size = found.count()
        most, few = max(most, size), 20 * size <= most
    classes = docs.where("n > 0").groupBy("key", "n").agg(F.count("*").alias("n_rows"))
    classes = classes.join(labels.select("node.key", "node.n", "label"), ["key", "n"], "left").withColumn("label", F.coalesce("label", own_label))
    return docs, classes


def _with_least(docs: DataFrame, classes: DataFrame, least: F.Column) -> DataFrame:
    """``docs`` with ``least``, an aggregate of the rows of their component; null for empty sets."""
    own = docs.where("n > 0").groupBy("key", "n").agg(least.alias("least")).join(classes, ["key", "n"])
    own = stored(own, "class-least")
    per = stored(own.groupBy("label").agg(F.min("least").alias("of_all"), F.count("*").alias("n_rows")), "component-least")
    own = join_counted(own.select("key", "n", "label", F.col("n_rows").alias("docs")), per, ["label"])
    return join_counted(docs, stored(own.select("key", "n", F.col("of_all").alias("least"), F.col("docs").alias("n_rows")), "class-told"), ["key", "n"], "left")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id`` (smallest id of the component).

    Links: 100 |A and B| >= ``percent`` |A or B| of the sets of ``width``-word shingles.
    """
    out = _with_least(*_labelled(df, id_col, text, width, percent), F.min("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def representatives(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``df`` with one row of each component left: that of the smallest id, then text hash.

    A null id is the last choice. Rows without words link with nothing and all
    stay; of rows that agree in id and text, one stays.
    """
    docs, classes = _labelled(df, id_col, text, width, percent)
    docs = docs.where("n > 0")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    key, code = (free_name(df.columns, n) for n in ("kept_id", "kept_hash"))
    named = _with_least(docs, classes, F.min(own))
    lost = named.where(~own.eqNullSafe(F.col("least"))).select(F.col("id").alias(key), F.col("text_hash").alias(code)).distinct()
    again = stored(docs.groupBy("id", "text_hash").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias(key), F.col("text_hash").alias(code)), "again")

    def same(other: DataFrame) -> F.Column:
        return df[id_col].cast("long").eqNullSafe(other[key]) & (F.xxhash64(df[text]) == other[code])

    rows = df.join(lost, same(lost), "left_anti")
    if not again.limit(1).count():
        return rows
    return rows.join(again, same(again), "left_anti").unionByName(rows.join(again, same(again), "left_semi").dropDuplicates([id_col, text]))
