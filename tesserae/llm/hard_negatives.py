"""Hard negatives of anchors by bit-sliced integer products.

Components are scaled and floored to integers, so scores are exact. A row's
components, shifted to be nonnegative, are B bit planes. Products of an anchor
with the planes are added from the most significant one down; what the planes
below can still add lies between sums of the anchor's negative and of its
positive components, so each pair has an interval of possible scores that halves
with every plane. A pair is dropped once its interval cannot reach what counts:

* positives: the score of the anchor's fifth best row of its label so far;
* negatives: one of the windows that its positives' scores open, or the third
  best row found in each so far.

Once few pairs of a batch are left, the planes below are added for these alone.

Anchors are a stated query set and meet all rows in blocks: rows are dealt to
parts and anchors to groups of about ``GROUP``, and each (group, part) is a key
of its own that streams through one task, its anchors first and its rows in the
order of their ids (so a later row never wins a tie). What a task holds is one
group of anchors, one Arrow batch and a few best rows an anchor; what leaves it are
those best rows, merged by anchor afterwards. Nothing is broadcast.

Defined cases: rows without id, label or vector, with null or non-finite
components, or whose squared integer norm is 2^62 or more (their scores would not
fit a long) take no part; of rows of one id the least (label, vector) stands for
all; vectors of different lengths never meet; empty vectors have score 0; equal
scores go by id; an anchor without positives, or a positive without negatives,
has no rows; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm._common import batches_of, reachable, stored, trimmed
from tesserae.sources.shared import scratch

#: Anchors of a group, and rows of a part: what one task holds, and what streams through it.
GROUP, PART = 1024, 1 << 17
#: Rows of an Arrow batch: a batch and a group make this many scores at a time.
BATCH = 1024
#: Pairs left, as a share of all pairs of a batch, below which planes are added pair by pair; and so many at once.
FEW, AT_ONCE = 1 / 16, 1 << 16
_LOWEST = -(1 << 62)

_FOUND = "anchor_id long, slot int, row_id long, score long"


def usable(rows: DataFrame, scale: int = 256, shift_every: int | None = 7, n_labels: int = 10, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, label, q`` of the rows that take part: integer components; every ``shift_every``-th id moves to the next label."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale))).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < F.lit(float(1 << 62))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & fits)
    if shift_every:
        own = own.withColumn("label", F.when(F.col("id") % shift_every == 0, (F.col("label") + 1) % n_labels).otherwise(F.col("label")))
    own = own.select("id", F.struct("label", F.transform("v", lambda x: F.floor(x).cast("int")).alias("q")).alias("r"))
    return own.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.q")


class Best:
    """The best ``keep`` rows of each of ``n`` slots: higher score, then smaller id."""

    def __init__(self, n: int, keep: int) -> None:
        self.ids, self.scores = np.zeros((n, keep), np.int64), np.full((n, keep), _LOWEST, np.int64)
        self.count, self.keep = np.zeros(n, np.int64), keep

    @property
    def least(self) -> np.ndarray:
        """What a later row must exceed to get into each slot."""
        return self.scores[:, -1]

    def add(self, slots: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(slots):
            return
        touched = np.unique(slots)
        held = np.arange(self.keep)[None] < self.count[touched][:, None]
        slots = np.concatenate([slots, np.repeat(touched, self.keep)[held.ravel()]])
        ids, scores = np.concatenate([ids, self.ids[touched][held]]), np.concatenate([scores, self.scores[touched][held]])
        order = np.lexsort((ids, -scores, slots))
        slots, ids, scores = slots[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        place = np.arange(len(slots)) - np.repeat(first, np.diff(np.r_[first, len(slots)]))
        top = place < self.keep
        self.ids[slots[top], place[top]], self.scores[slots[top], place[top]] = ids[top], scores[top]
        self.count[touched] = np.bincount(slots[top], minlength=len(self.count))[touched]


class Search:
    """Anchors of one group against a stream of rows in the order of their ids.

    Each anchor has the same number of windows ``low[a, w] <= score <= high[a, w]``
    (empty where low > high); ``same``: rows of the anchor's label count, else
    rows of all others.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int, same: bool) -> None:
        self.ids, self.labels, self.q, self.same = ids, labels, q, same
        self.low, self.high, self.windows = low, high, low.shape[1]
        self.best = Best(low.size, keep)
        self.size = int(np.abs(q).sum(1).max(initial=0))  # of the largest anchor, the sum of absolute components
        self.below, self.above = np.minimum(q, 0).sum(1), np.maximum(q, 0).sum(1)
        self.kinds: dict = {}

    def _exact(self, kind: type) -> tuple[np.ndarray, ...]:
        """Anchors and their bounds in a number type."""
        if kind not in self.kinds:
            self.kinds[kind] = tuple(x.astype(kind) for x in (self.q, self.q.sum(1), self.below, self.above))
        return self.kinds[kind]

    def _needs(self) -> tuple[np.ndarray, np.ndarray]:
        """Per window what a row must reach, and per anchor whether it still looks for rows."""
        need = np.where(self.best.count.reshape(self.low.shape) == self.best.keep, np.maximum(self.low, self.best.least.reshape(self.low.shape) + 1), self.low)
        return need, need <= self.high

    def add(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        need, alive = self._needs()
        least = np.where(alive, need, 1 << 62).min(1)
        most = np.where(alive, self.high, _LOWEST).max(1)
        own = np.flatnonzero(alive.any(1))
        if not len(own) or not len(ids):
            return
        a, r, s = self._products(own, least[own], most[own], ids, labels, q)
        for w in range(self.windows):
            hit = (s >= need[a, w]) & (s <= self.high[a, w])
            self.best.add(a[hit] * self.windows + w, ids[r[hit]], s[hit])

    def _products(self, own: np.ndarray, least: np.ndarray, most: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of all pairs with ``least <= score <= most`` (and a few outside)."""
        left = (self.labels[own][:, None] == labels[None]) == self.same
        if self.same:
            left &= self.ids[own][:, None] != ids[None]
        planes = int(np.abs(q.astype(np.int64)).max(initial=0)).bit_length() + 1
        span = self.size << planes
        if span >= 1 << 52:  # no float holds the sums; exact integers without planes
            a, r = np.nonzero(left)
            return own[a], r, self._pairs(own[a], r, q.astype(np.int64))
        kind = np.float32 if span < 1 << 23 else np.float64
        anchors, total, below, above = (x[own] for x in self._exact(kind))
        # Bounds beyond what scores can be are moved within, so the number type holds them.
        least, most = (np.clip(x, -span, span).astype(kind)[:, None] for x in (least, most))
        bits = (q.astype(np.int64) + (1 << planes - 1)).T
        sums = np.repeat(-total[:, None] * kind(1 << planes - 1), len(ids), axis=1)
        for b in range(planes - 1, -1, -1):
            sums += (anchors * kind(1 << b)) @ ((bits >> b) & 1).astype(kind)
            rest = kind((1 << b) - 1)
            left &= sums >= least - (rest * above)[:, None]
            left &= sums <= most - (rest * below)[:, None]
            if b and np.count_nonzero(left) <= FEW * left.size:
                return self._finish(own, left, sums, b, bits, least[:, 0], most[:, 0], below, above)
        a, r = np.nonzero(left)
        return own[a], r, sums[a, r].astype(np.int64)

    def _finish(self, own: np.ndarray, left: np.ndarray, sums: np.ndarray, b: int, bits: np.ndarray, least: np.ndarray, most: np.ndarray, below: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The planes under ``b`` for the pairs that are left, again from the top."""
        a, r = np.nonzero(left)
        s, rows, anchors = sums[a, r], bits.T, self._exact(sums.dtype.type)[0][own]
        while b and len(a):
            b -= 1
            for at in range(0, len(a), AT_ONCE):
                x, y = a[at : at + AT_ONCE], r[at : at + AT_ONCE]
                s[at : at + AT_ONCE] += np.einsum("ij,ij->i", anchors[x], ((rows[y] >> b) & 1).astype(s.dtype)) * s.dtype.type(1 << b)
            rest = s.dtype.type((1 << b) - 1)
            keep = (s >= least[a] - rest * above[a]) & (s <= most[a] - rest * below[a])
            a, r, s = a[keep], r[keep], s[keep]
        return own[a], r, s.astype(np.int64)

    def _pairs(self, a: np.ndarray, r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.einsum("ij,ij->i", self.q[a[at : at + AT_ONCE]], rows[r[at : at + AT_ONCE]]) for at in range(0, len(a), AT_ONCE)] or [np.zeros(0, np.int64)])

    def found(self) -> Iterator[pa.RecordBatch]:
        """The best rows of each anchor and window: ``_FOUND``."""
        at = np.arange(self.best.keep)[None] < self.best.count[:, None]
        slots = np.repeat(np.arange(len(at)), self.best.count)
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[slots // self.windows]), pa.array((slots % self.windows).astype(np.int32)), pa.array(self.best.ids[at]), pa.array(self.best.scores[at])], names=["anchor_id", "slot", "row_id", "score"])


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    x = b.column("q").flatten().to_numpy()
    return x.reshape(b.num_rows, len(x) // b.num_rows if b.num_rows else 0)


def search(rows: DataFrame, anchors: DataFrame, keep: int, same: bool, n_rows: int, n_anchors: int) -> DataFrame:
    """The ``keep`` best rows of each anchor and window: ``anchor_id, slot, row_id, score, place``.

    ``rows``: ``id, label, q``. ``anchors``: these and ``low, high`` (arrays of
    longs, one entry a window, as many for all).
    """
    spark = rows.sparkSession
    groups = max(1, -(-n_anchors // GROUP))
    parts = max(1, -(-n_rows // PART), 4 * spark.sparkContext.defaultParallelism)
    none = F.lit(None).cast("array<bigint>")
    key = ["dim", "g", "p", "kind"]
    streamed = rows.select(F.size("q").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("p"), F.lit(1).alias("kind"), "id", "label", "q", none.alias("low"), none.alias("high"))
    asked = anchors.select(F.size("q").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.lit(0).alias("kind"), "id", "label", "q", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, now = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in key])
            edges = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()
            for s, e in zip([0, *edges], [*edges, b.num_rows]):
                part, where = b.slice(s, e - s), tuple(keys[:3, s])
                if where != at:
                    if now:
                        yield from now.found()
                    at, held, now = where, [], None
                if not keys[3, s]:
                    held.append(part)
                    continue
                if held and now is None:
                    ids, labels = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("id", "label"))
                    low, high = (np.concatenate([h.column(c).flatten().to_numpy() for h in held]).reshape(len(ids), -1) for c in ("low", "high"))
                    now = Search(ids, labels, np.concatenate([_matrix(h) for h in held]).astype(np.int64), low, high, keep, same)
                if now:
                    now.add(part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part))
        if now:
            yield from now.found()

    dealt = streamed.unionByName(asked).repartition(*key[:3]).sortWithinPartitions(*key, "id")
    found = dealt.mapInArrow(lambda batches: trimmed(run(batches)), _FOUND)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "row_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def hard_negatives(rows: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, shift_every: int | None = 7, n_labels: int = 10, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. For each of an
    anchor's ``n_positives`` best other rows of its label come the
    ``n_negatives`` best rows of other labels whose score is from ``low`` to
    ``high`` hundredths of the positive's; ``low`` must be less than ``high``,
    so a positive of negative score has none.
    """
    spark = rows.sparkSession
    reachable(spark)
    with scratch(spark) as keep, batches_of(spark, BATCH):
        table = stored(usable(rows, scale, shift_every, n_labels, id_col, vector, label), "integer-vectors")
        anchors = table.where(F.col("id") % every == 0)
        n = table.agg(F.count("*").alias("rows"), F.count_if(F.col("id") % every == 0).alias("anchors")).first()
        all_of = F.array(F.lit(_LOWEST + 1)), F.array(F.lit(1 << 62))
        positives = keep(search(table, anchors.withColumns({"low": all_of[0], "high": all_of[1]}), n_positives, True, n.rows, n.anchors), "positives")
        # One window a positive: low <= 100 * score / positive <= high, in integers; empty where an anchor has fewer.
        own = positives.groupBy("anchor_id").agg(*(F.max(F.when(F.col("place") == k + 1, F.col("score"))).alias(f"s{k}") for k in range(n_positives)))
        there = [F.col(f"s{k}") >= 0 for k in range(n_positives)]
        lows = F.array(*(F.coalesce(F.when(ok, F.expr(f"s{k} div 100 * {low} + (s{k} % 100 * {low} + 99) div 100")), F.lit(1)) for k, ok in enumerate(there)))
        highs = F.array(*(F.coalesce(F.when(ok, F.expr(f"s{k} div 100 * {high} + s{k} % 100 * {high} div 100")), F.lit(0)) for k, ok in enumerate(there)))
        asked = anchors.join(own.select(F.col("anchor_id").alias("id"), lows.alias("low"), highs.alias("high")), "id")
        negatives = keep(search(table, asked, n_negatives, False, n.rows, n.anchors), "negatives")
    negatives = negatives.select("anchor_id", (F.col("slot") + 1).alias("at"), F.col("place").alias("rank"), F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    positives = positives.select("anchor_id", F.col("place").alias("at"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(positives, ["anchor_id", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
