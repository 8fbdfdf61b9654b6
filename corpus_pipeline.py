"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each one's result and reads it again as the next one's documents. All
but the last return the columns of ``documents``.

Every stage takes any further columns along, whatever their names, gives an
empty table for an empty one, and works on whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import mixing, ngram_join, packing, quality, secret_scan
from tesserae.llm._common import reachable, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    A null or empty text has no words and is rejected; repeated rows are judged
    one by one; nulls in other columns pass.
    """
    reachable(spark)
    return quality.quality_filter(docs, quality.CORPUS_RULES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    A null id is the last choice, ties of an id are settled by a hash of the text,
    of rows that agree in id and text one stays, and texts without words all stay.
    """
    reachable(spark)
    return ngram_join.representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every reported secret replaced by its kind.

    Null texts stay null; a null source is an owner of its own; repeated rows
    change alike; ``n_chars`` is counted anew where the text changes.
    """
    reachable(spark)
    return secret_scan.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its shards.

    A null source is the last one; documents without words are not taken;
    repeated rows are taken alike.
    """
    reachable(spark)
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of sequences of 1024 token ids.

    A null text is its end id alone; a null id is kept; repeated rows are packed
    one by one.
    """
    reachable(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secrets", secrets), ("source mix", source_mix), ("packing", packed)]

#: Tokenizing and the seeded draws of the mix have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark, f"stage-{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    return out
