"""Importance resampling of documents towards the distribution of a target text.

Features are runs of words, hashed to buckets. A bucket's gain is the scaled log
ratio of its smoothed shares in the target and in all documents; a document is
scored by one array of gains (the floored mean over its features) plus Gumbel
noise that its id fixes. The highest scores are drawn without replacement:

* scores are integers, so their exact histogram is small, whatever the number of
  documents; its suffix sums give each score's rank offset and the cutoff score;
* only documents at or above the cutoff are numbered, by id within their score,
  each score a group of its own. A score of more than ``SPLIT`` documents is
  numbered by ranges of (score, id) instead, so no task has to hold it.

Each text is cut into features once; buckets and scores are written to the shared
folder, so a lost executor costs a reread. To the driver come one count a bucket
(10,000) and one a score. Scores span at most the range of the gains plus
26,003, about 10^5 values.

Defined cases: a null text has no features and weight 0; a null id gets the noise
of the empty id and comes after all others in a tie; repeated rows are scored and
drawn one by one, in the order of their number of features; an empty table of
documents gives an empty table, an empty target counts nothing; other columns are
not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm._common import reachable, stored
from tesserae.operators.ordering import dense_index
from tesserae.sources.shared import scratch

#: Words of lower-cased texts: runs of ASCII letters and digits and of all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Documents of one score that a single task numbers.
SPLIT = 1 << 20


def words(text: Column) -> Column:
    """The words of a text, in A-Z lower-cased; of a null text none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def features(words: Column, lo: int = 1, hi: int = 1, buckets: int = 10_000) -> Column:
    """The buckets of all runs of ``lo`` to ``hi`` words, an array of ints; the words of a run are joined by one space."""

    def runs(n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")), F.array().cast("array<string>"))

    found = runs(lo) if lo == hi else F.flatten(F.array(*(runs(n) for n in range(lo, hi + 1))))
    return F.transform(found, lambda w: (F.crc32(w) % F.lit(buckets)).cast("int"))


def bucket_counts(rows: DataFrame, column: str, buckets: int) -> list[int]:
    """How often each bucket occurs in the arrays ``column``: one count a bucket comes to the driver."""
    out = [0] * buckets
    for r in rows.select(F.explode(column).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Floored 1000 ln of the ratio of each bucket's smoothed shares in ``target`` and ``source``."""
    b, s, t = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000.0 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(source, target)]


def noise(key: Column, seed: int) -> Column:
    """Integer Gumbel noise that the seed and the id fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, lo: int = 1, hi: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Every row's ``id, n_features, weight, score, rank``; ``carry``: and all its columns as the struct ``doc``.

    Ranks 1, 2, 3, ... go to ``percent`` hundredths (floored) of the rows of at
    least ``min_words`` words; the others' rank is null.
    """
    reachable(docs.sparkSession)
    own, also = F.col("_buckets"), ["doc"] if carry else []
    with scratch(docs.sparkSession) as keep:
        parts = docs.select(F.col(id_col).alias("id"), words(F.col(text)).alias("_words"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []))
        parts = stored(parts.select("id", F.size("_words").alias("n_words"), features(F.col("_words"), lo, hi, buckets).alias("_buckets"), *also), "features")
        aim = bucket_counts(target.select(features(words(F.col(text)), lo, hi, buckets).alias("_buckets")), "_buckets", buckets)
        gain = F.from_json(F.lit(str(gains(bucket_counts(parts, "_buckets", buckets), aim))), "array<bigint>")  # folded to one literal

        n = F.size(own).cast("long")
        total = F.aggregate(own, F.lit(0).cast("long"), lambda s, b: s + F.get(gain, b))
        weight = F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long")
        rows = parts.select("id", n.alias("n_features"), weight.alias("weight"), (F.col("n_words") >= min_words).alias("_in"), F.monotonically_increasing_id().alias("_row"), *also)
        rows = keep(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    return ranked(rows, percent)


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """``rank`` for the highest ``score`` of the rows marked ``_in``, ties to smaller ``id``; without ``_in`` and ``_row``.

    ``rows`` is read several times, so pass a stored table.
    """
    held = sorted(((r.score, r.n) for r in rows.where("_in").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    most, above, hot_above = sum(n for _, n in held) * percent // 100, 0, 0
    offsets: dict[bool, list[tuple[int, int]]] = {False: [], True: []}
    for score, n in held:  # from the highest score down: ``above`` rows have a higher one
        if above >= most:
            break
        cutoff, hot = score, n > SPLIT
        # Hot scores are numbered as one sequence, in which only the hot rows above come before.
        offsets[hot].append((score, above - hot_above if hot else above))
        above, hot_above = above + n, hot_above + hot * n
    plain = [c for c in rows.columns if c not in ("_in", "_row")]
    none = F.lit(None).cast("long").alias("rank")
    if not most:
        return rows.select(*plain, none)
    drawn = F.col("_in") & (F.col("score") >= F.lit(cutoff))
    parts = [rows.where(~drawn).select(*plain, none)]
    for hot, own in offsets.items():
        if own:
            table = rows.sparkSession.createDataFrame(own, "score long, _above long")
            met = rows.where(drawn).join(F.broadcast(table), "score").withColumn("_null", F.col("id").isNull())
            ties = ["_null", "id", "n_features", "_row"]
            if hot:
                met = dense_index(met.withColumn("_key", F.struct(-F.col("score"), *ties)), "_key", "_at").withColumn("_at", F.col("_at") + 1)
            else:
                met = met.withColumn("_at", F.row_number().over(Window.partitionBy("score").orderBy(*ties)))
            parts.append(met.withColumn("rank", (F.col("_above") + F.col("_at")).cast("long")).select(*plain, F.when(F.col("rank") <= F.lit(most), F.col("rank")).alias("rank")))
    return reduce(DataFrame.unionByName, parts)


def importance_ranks(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """``id, n_features, weight, score, rank`` of every row of ``docs`` (longs; ``rank`` null if undrawn); options as in ``scored``."""
    rows = scored(docs, target, id_col=id_col, **options)
    return rows.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, **options: object) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; options as in ``scored``."""
    return scored(docs, target, carry=True, **options).where("rank IS NOT NULL").select("doc.*")
