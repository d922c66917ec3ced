"""Connected components of an edge table, and ranks in linked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import drop_written, written


def roots(parents: DataFrame) -> DataFrame:
    """(node, p) with p moved up to the top of each tree: paths halve each round. Only whether any moved comes to the driver."""
    spark = parents.sparkSession
    parents = written(parents.select("node", "p"), "parents")
    while True:
        up = parents.select(F.col("node").alias("p"), F.col("p").alias("q"))
        new = written(parents.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("p"), F.col("p").alias("was")), "parents")
        drop_written(spark, parents)
        parents = new.select("node", "p")
        if new.filter("p != was").isEmpty():
            return parents


def list_ranks(cells: DataFrame) -> DataFrame:
    """(e, last, rank) of cells (e, nxt) of linked lists: the end of a cell's list and the steps to it. Cells of rings, which have no end, are left out.

    Each round doubles how far a cell looks, so rounds grow with the logarithm of the longest list; only how many have found their end comes to the driver.
    """
    spark = cells.sparkSession
    ahead = F.col("nxt").isNotNull()
    cells = written(cells.select("e", ahead.cast("long").alias("rank"), F.coalesce("nxt", "e").alias("last"), ahead.alias("open")), "cells")
    before, closed = -1, cells.filter("not open").count()
    while closed != before:
        far = cells.select(F.col("e").alias("last"), F.col("last").alias("far"), F.col("rank").alias("more"), F.col("open").alias("on"))
        new = cells.filter("open").join(far, "last").select("e", (F.col("rank") + F.col("more")).alias("rank"), F.col("far").alias("last"), F.col("on").alias("open"))
        new = written(cells.filter("not open").select("e", "rank", "last", "open").unionByName(new), "cells")
        drop_written(spark, cells)
        cells, before, closed = new, closed, new.filter("not open").count()
    return cells.filter("not open").select("e", "last", "rank")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node reachable over edges taken both ways.

    Nodes may be of any ordered type. Nodes given but on no edge are components of their own; nulls are left out. Each
    round hangs every node under its smallest neighbour, if that is smaller, takes each tree as one node named by its top, and keeps
    the edges between trees. Every node with an edge joins another, so nodes at least halve each round and edges only shrink.
    Rounds are written tables.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src != dst")
    pairs = written(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")
    ids = pairs.select(F.col("src").alias("node")).union(pairs.select("dst"))
    if nodes is not None:
        ids = ids.union(nodes.select(F.col(nodes.columns[0]).alias("node")).filter("node is not null"))
    labels = written(ids.distinct().withColumn("component", F.col("node")), "labels")
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("dst", "src")).toDF("node", "near")
        top = roots(both.groupBy("node").agg(F.least("node", F.min("near")).alias("p")))
        new = written(labels.join(top.toDF("component", "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        left = pairs.join(top.toDF("src", "a"), "src").join(top.toDF("dst", "b"), "dst").filter("a != b")
        rest = written(left.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "pairs")
        drop_written(spark, labels, pairs, top)
        labels, pairs = new, rest
    return labels
