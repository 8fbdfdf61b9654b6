"""Mixing sources to target weights through a hypergeometric splitting tree.

1. Targets: the words of all sources are shared by weight; a target stops at
   ``max_epochs`` times its source's words and the excess is shared anew. The
   capped sources are those with the least words a weight, so running sums in
   that order give the level at which the sharing stops.
2. Blocks: a source's documents fall by hash into a power of two of blocks of at
   most ``block_words`` words or so; a seeded affine permutation orders them.
   A target of q whole passes and a remainder draws every block q times, then
   blocks in permuted order while they fit, then documents of the next block
   that still fit.
3. Shards: the draws of all sources are dealt to output shards by a binary
   tree. At each node the exact quotas of its shards are split between its
   halves by a multivariate hypergeometric draw, seeded by the node. A shard's
   blocks are the next ones of each source's draws, so no two shards share a
   draw; a task walks the tree above its own shards only, and a node keeps the
   sources it has draws of. Rows are shuffled within their shard by hash.

Sources stay in a table, of any number. The tree knows at most ``MAX_UNITS``
units, 8 MB of quotas: one a source, or, for more sources, one a large source
and shared ones for the rest, whose draws come in a permuted order.

Defined cases: null text has no words; a null source comes last; identical rows
(id, text, source) are drawn alike; a source without words has target 0 and is
not drawn; an empty table gives an empty mix; other columns pass through,
whatever their names; a very long document is a block of its own size. Reruns
agree. A source's words miss their target by less than half of its shortest
document where the last block holds enough documents, else by what its
documents leave; a document is never cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm._common import as_bytes, free_name, join_counted, schema_of, stored
from tesserae.operators.ordering import ranged_total

MAX_UNITS = 1 << 20
#: Blocks in all stay below this, so that the quotas can be split by exact draws.
MAX_BLOCKS = 1 << 28
BLOCK_WORDS, BLOCK_ROWS, SHARD_BLOCKS, STRIDE = 1 << 16, 1 << 14, 64, 4096


def targets(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """Add ``target`` to rows ``k, words, weight`` of any number: shares of all words by weight, none above ``cap`` times its words."""
    total = sources.agg(F.sum("words"), F.sum("weight")).first()
    rows = sources.withColumn("_ratio", F.struct((cap * F.col("words") / F.col("weight")).alias("r"), F.col("k").alias("k")))
    rows = ranged_total(rows, "_ratio", cap * F.col("words"), "_capped")
    rows = ranged_total(rows, "_ratio", F.col("weight"), "_above")
    level = (F.lit(float(total[0] or 0)) - F.col("_capped")) / (F.lit(float(total[1] or 0)) - F.col("_above"))
    # The first source, in this order, that the level does not fill up; all are full if there is none.
    found = rows.withColumn("_level", level).where("_ratio.r >= _level").agg(F.min_by("_level", "_ratio")).first()[0]
    share = F.lit(float("inf") if found is None else found) * F.col("weight")
    return rows.withColumn("target", F.least(cap * F.col("words"), share).cast("double")).select(*sources.columns, "target")


def fitted(words: list[int], goal: float, last: int = 64) -> list[bool]:
    """Which items to take so that their sum comes near ``goal``.

    First fit in order; then the last ``last`` items are chosen anew, as the
    subset whose sum is nearest (the smaller of two).
    """
    left, take = goal, []
    for w in words:
        take.append(0 < w <= left)
        left -= w if take[-1] else 0
    tail = [k for k, w in enumerate(words) if w][-last:]
    left += sum(words[k] for k in tail if take[k])
    tail = [k for k in tail if words[k] <= 2 * left]  # longer ones are further off than none
    for k, w in enumerate(words):
        take[k] = take[k] and w <= 2 * left
    most = (1 << 2 * int(left) + 2) - 1
    sums = [1]  # bit s: some subset of the items so far has the sum s
    for k in tail:
        sums.append((sums[-1] | sums[-1] << words[k]) & most)
    below = sums[-1] & ((1 << int(left) + 1) - 1)
    at, above = below.bit_length() - 1, sums[-1] >> int(left) + 1
    if above and (over := int(left) + (above & -above).bit_length()) - left < left - at:
        at = over
    for k, had in zip(reversed(tail), reversed(sums[:-1])):
        take[k] = not had >> at & 1
        at -= words[k] if take[k] else 0
    return take


def shard_quotas(quotas: np.ndarray, n_shards: int, shards: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the sorted ``shards``: (shard, units, draws before it, draws in it), by the splitting tree above them."""
    total, at = int(quotas.sum()), np.flatnonzero(quotas)
    todo = [(0, n_shards, at, quotas[at], np.zeros(len(at), np.int64))]
    while todo:
        lo, hi, units, q, before = todo.pop()
        if np.searchsorted(shards, lo) == np.searchsorted(shards, hi):
            continue
        if hi - lo == 1:
            yield lo, units, before, q
            continue
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, total * mid // n_shards - total * lo // n_shards, method="marginals")
        for part, own, first in (((mid, hi), q - left, before + left), ((lo, mid), left, before)):
            some = own > 0
            todo.append((*part, units[some], own[some], first[some]))


def sized(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Slim units: ``id, source, hash, size, copies``; identical rows are one unit."""
    fields = [("id", "long"), ("source", "string"), ("hash", "long"), ("size", "long")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(t.split()) for t in as_bytes(b.column(3))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n], names=[f for f, _ in fields])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, schema_of(fields)).groupBy("id", "source", "hash", "size").agg(F.count("*").alias("copies"))


def _sources(units: DataFrame, weights: tuple[float, ...], cap: float, seed: int, block_words: int) -> DataFrame:
    """One row a source: ``k, s_null, s_text, n_rows, source_size, target, blocks, passes, rest, step, shift``."""
    name = F.struct(F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s_text"))
    found = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("words"), F.count("*").alias("n_rows")).withColumn("_name", name).drop("source")
    found = ranged_total(found, "_name", F.lit(1).cast("long"), "k")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights)).cast("int") + 1)
    found = targets(found.withColumn("weight", weight), cap)
    least = F.greatest(F.ceil(F.col("words") / block_words), F.ceil(F.col("n_rows") / BLOCK_ROWS), F.lit(1))
    found = found.withColumn("blocks", F.pow(F.lit(2.0), F.ceil(F.log2(least.cast("double")) - 1e-12)).cast("long"))
    passes = F.when(F.col("words") > 0, F.least(F.floor(F.col("target") / F.col("words")), F.lit(int(cap)))).otherwise(0).cast("long")
    found = found.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("words"))
    # Odd steps run through all blocks, whose number is a power of two.
    step = F.pmod(F.xxhash64(F.lit(seed), "k"), F.col("blocks")).bitwiseOR(F.lit(1).cast("long"))
    shift = F.pmod(F.xxhash64(F.lit(seed + 2), "k"), F.col("blocks"))
    return stored(found.select("k", "_name.s_null", "_name.s_text", "n_rows", F.col("words").alias("source_size"), "target", "blocks", "passes", "rest", step.alias("step"), shift.alias("shift")), "mix-sources")


def _dealt(spark, sources: DataFrame, drawn: DataFrame, n_sources: int, seed: int, shard_blocks: int) -> DataFrame:  # noqa: ANN001
    """``k, draw, shard`` of every draw of a block."""
    quotas = stored(sources.select("k", "passes", "blocks").join(drawn, "k", "left").select("k", (F.col("passes") * F.col("blocks") + F.coalesce("n", F.lit(0))).alias("quota")).where("quota > 0"), "mix-quotas")
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    if n_sources <= MAX_UNITS:
        keyed = quotas.withColumn("unit", F.col("k"))
    else:
        # Fewer than MAX_UNITS / 2 sources have a larger part of the draws than 2 / MAX_UNITS.
        half = MAX_UNITS // 2
        heavy = stored(quotas.where(F.col("quota") > F.lit(total / half)).withColumn("unit", F.row_number().over(Window.orderBy("k")).cast("long") + F.lit(half - 1)), "mix-heavy")
        light = quotas.join(F.broadcast(heavy.select("k")), "k", "left_anti").withColumn("unit", F.pmod(F.xxhash64(F.lit(seed + 3), "k"), F.lit(half)))
        keyed = heavy.unionByName(light)
    rows = keyed.groupBy("unit").agg(F.sum("quota").alias("quota")).collect()  # at most MAX_UNITS
    dense = np.zeros(max((r.unit for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        dense[r.unit] = r.quota
    told, n_shards, names = spark.sparkContext.broadcast(dense), max(1, math.ceil(total / shard_blocks)), [("unit", "long"), ("at", "long"), ("shard", "long")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.sort(np.concatenate([np.empty(0, np.int64), *(b.column(0).to_numpy() for b in batches)]))
        for shard, units, before, own in shard_quotas(told.value, n_shards, wanted, seed):
            at = np.repeat(before - np.cumsum(own) + own, own) + np.arange(own.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(units, own)), pa.array(at), pa.array(np.full(len(at), shard))], names=[n for n, _ in names])

    shards = spark.range(n_shards).mapInArrow(deal, schema_of(names))
    if n_sources <= MAX_UNITS:
        return shards.select(F.col("unit").alias("k"), F.col("at").alias("draw"), "shard")
    own = keyed.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)))
    alone = own.where(F.col("unit") >= MAX_UNITS // 2).withColumn("at", F.col("draw"))
    order = Window.partitionBy("unit").orderBy(F.xxhash64(F.lit(seed + 4), "k", "draw"), "k", "draw")
    rest = own.where(F.col("unit") < MAX_UNITS // 2).withColumn("at", (F.row_number().over(order) - 1).cast("long"))
    return alone.unionByName(rest).join(shards, ["unit", "at"]).select("k", "draw", "shard")


def plan_mix(df: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, **columns: str) -> DataFrame:
    """One row a unit: ``id, source, hash, size, copies, source_size, target, draws``.

    ``draws`` lists (epoch, shard) of each time it is taken. The k-th source by
    code point, null last, has the weight ``weights[k % len(weights)]``.
    """
    spark = df.sparkSession
    units = stored(sized(df, **columns), "mix-units")
    words = units.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    sources = _sources(units, weights, cap, seed, max(block_words, math.ceil(words * cap / MAX_BLOCKS)))
    n_sources = sources.count()
    keyed = units.withColumns({"s_null": F.col("source").isNull(), "s_text": F.coalesce("source", F.lit(""))})
    place = F.pmod(F.pmod(F.xxhash64(F.lit(seed), "id", "hash"), F.col("blocks")) * F.col("step") + F.col("shift"), F.col("blocks"))
    placed = join_counted(keyed, sources, ["s_null", "s_text"]).drop("s_null", "s_text")
    placed = placed.withColumn("place", place).withColumn("stride", F.floor(F.col("place") / STRIDE))

    # Words before each block in permuted order: sums of strides first, then blocks within a stride.
    blocks = placed.groupBy("k", "stride", "place", "rest").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    strides = blocks.groupBy("k", "stride").agg(F.sum("words").alias("w")).withColumn("base", F.sum("w").over(Window.partitionBy("k").orderBy("stride")) - F.col("w")).drop("w")
    within = F.sum("words").over(Window.partitionBy("k", "stride").orderBy("place")) - F.col("words")
    blocks = blocks.withColumn("before", within).join(strides, ["k", "stride"]).withColumn("before", F.col("before") + F.col("base"))
    # Blocks of the remainder: whole ones, and the one in which it ends.
    rest = F.when(F.col("before") + F.col("words") <= F.col("rest"), F.lit(None).cast("double")).otherwise(F.col("rest") - F.col("before"))
    blocks = stored(blocks.where(F.col("before") < F.col("rest")).select("k", "place", rest.alias("residual")), "mix-blocks")
    drawn = blocks.groupBy("k").agg((F.max("place") + 1).alias("n"))

    partial = placed.join(blocks, ["k", "place"], "left_semi").join(blocks, ["k", "place"])
    fit = schema_of([("id", "long"), ("hash", "long"), ("k", "long"), ("place", "long"), ("size", "long"), ("taken", "boolean")])

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        """The documents of the block where the remainder ends that are drawn."""
        block = block.sort_values(["order", "id", "hash"], kind="stable")
        return block.assign(taken=fitted(block["words"].tolist(), float(block["residual"].iloc[0])))[["id", "hash", "k", "place", "size", "taken"]]

    ending = partial.where("residual IS NOT NULL").select("id", "hash", "k", "place", "size", "residual", (F.col("size") * F.col("copies")).alias("words"), F.xxhash64(F.lit(seed + 1), "id", "hash").alias("order"))
    ended = ending.groupBy("k", "place").applyInPandas(fill, fit).where("taken").select("id", "hash", "k", F.lit(True).alias("fits"))
    whole = blocks.where("residual IS NULL").select("k", "place", F.lit(True).alias("whole"))
    placed = placed.join(whole, ["k", "place"], "left").join(ended, ["id", "hash", "k"], "left")
    epochs = F.col("passes") + F.when(F.col("whole") | F.col("fits"), 1).otherwise(0)
    units = placed.withColumn("epoch", F.explode_outer(F.when(epochs > 0, F.sequence(F.lit(0).cast("long"), epochs - 1))))
    units = units.withColumn("draw", F.col("epoch") * F.col("blocks") + F.col("place"))

    dealt = units.join(_dealt(spark, sources, drawn, n_sources, seed, shard_blocks), ["k", "draw"], "left")
    draw = F.when(F.col("epoch").isNotNull(), F.struct("epoch", "shard"))
    return dealt.groupBy("id", "source", "hash", "size", "copies", "source_size", "target").agg(F.sort_array(F.collect_list(draw)).alias("draws"))


def mix(df: DataFrame, seed: int = 7, id_col: str = "doc_id", text: str = "text", source: str = "source", **options: object) -> DataFrame:
    """The mixed rows of ``df``, each as often as it is drawn, shuffled within output shards.

    Columns of ``df`` only. A shard's rows lie together in one partition.
    """
    plan = plan_mix(df, seed=seed, id_col=id_col, text=text, source=source, **options)
    names = df.columns
    key, name, code, draw, order, a, b, c = (free_name(names, f"mix_{n}") for n in ("key", "source", "hash", "draw", "order", "id", "of", "code"))
    own = plan.select(F.col("id").alias(a), F.col("source").alias(b), F.col("hash").alias(c), F.explode("draws").alias(draw))
    keyed = df.withColumns({key: F.col(id_col).cast("long"), name: F.col(source).cast("string"), code: F.xxhash64(text)})
    rows = keyed.join(own, keyed[key].eqNullSafe(own[a]) & keyed[name].eqNullSafe(own[b]) & (keyed[code] == own[c]))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shuffled = F.xxhash64(F.lit(seed), F.col(draw)["shard"], F.col(draw)["epoch"], key, code)
    return rows.withColumn(order, shuffled).repartition(n, F.col(draw)["shard"]).sortWithinPartitions(F.col(draw)["shard"], order).select(*names)
