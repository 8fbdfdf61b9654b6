"""Connected components of a link table, by contraction in DataFrames.

Each round gives every node the neighbour of least hash as parent, jumps one step
further, and replaces the links by links between parents, until none is left.
Nodes are ordered by hash, so chains of any order take a number of rounds like
the logarithm of their length. Each round's tables are written to the shared
folder, so lineage stays short, and nodes with a large part of all links or
labels don't fill a task of their own (``join_counted``). Nothing but counts
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm._common import join_counted, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node with a link to another; the label is one of its component's nodes, the same for all.

    ``links`` holds each link once or more, in either direction; links of a
    node to itself and null ends are ignored.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = None

    def rank(c: str) -> F.Column:
        return F.struct(F.xxhash64(c), F.col(c))

    while edges.limit(1).count():
        up = edges.groupBy("a").agg(F.min_by("b", rank("b")).alias("m"), F.count("*").alias("n_rows"))
        up = stored(up.select(F.col("a").alias("node"), F.when(rank("m") < rank("a"), F.col("m")).otherwise(F.col("a")).alias("up"), "n_rows"), "cc-parents")
        # How many nodes have a parent, for the jump from parent to parent.
        fans = stored(up.groupBy("up").agg(F.count("*").alias("n_rows")).join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up"), "cc-fans")
        top = stored(join_counted(up.select("node", "up", F.col("n_rows").alias("n_links")), fans, ["up"]).select("node", "top", F.col("n_links").alias("n_rows")), "cc-jumps")
        if labels is None:
            labels = top.select("node", F.col("top").alias("label"))
        else:
            held = labels.groupBy("label").agg(F.count("*").alias("n_rows")).join(top.select(F.col("node").alias("label"), "top"), "label")
            moved = join_counted(labels, stored(held, "cc-held"), ["label"], "left")
            labels = stored(moved.select("node", F.coalesce("top", "label").alias("label")), "cc-labels")
        ends = join_counted(edges, top.select(F.col("node").alias("a"), F.col("top").alias("x"), "n_rows"), ["a"])
        ends = join_counted(stored(ends.select("b", "x").distinct(), "cc-half"), top.select(F.col("node").alias("b"), F.col("top").alias("y"), "n_rows"), ["b"])
        edges = stored(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "cc-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
