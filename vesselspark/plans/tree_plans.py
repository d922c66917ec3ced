"""Queries of rooted trees (G31, G32) on trees made of `customer`, and their SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from ..session import written
from .fixtures import POINTS, points, table, with_ctes
from .profile_plans import rounded


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, nodes, roots): a tree for every 300 customers, node k hanging under one of the four before it; its root is the node nearest to a place inside."""
    k, case = (F.col("c_custkey") % 300).cast("int"), F.floor(F.col("c_custkey") / 300).cast("int")
    rows = table(spark, sf_dir, "customer").select(case.alias("case_id"), k.alias("k"), ((F.col("c_custkey") * 7 + F.floor("c_acctbal")) % 4).alias("back"), *(p.cast("double").alias(f"p{n}") for n, p in enumerate((k, F.abs(F.floor("c_acctbal")) % 50, F.col("c_custkey") * 13 % 29))), (0.3 + F.col("c_custkey") * 31 % 17 / 10).alias("radius_mm"))
    node = F.struct("case_id", "k")
    nodes = rows.select("case_id", node.alias("node"), "p0", "p1", "p2", "radius_mm")
    above = rows.select("case_id", F.greatest(F.lit(0), F.col("k") - 1 - F.abs("back")).cast("int").alias("k"), F.col("k").alias("own"))
    down = above.filter("own > 0").join(rows.select("case_id", "k"), ["case_id", "k"]).select(node.alias("src"), F.struct("case_id", F.col("own").alias("k")).alias("dst"))
    places = rows.select("case_id").distinct().select("case_id", F.lit(140.0).alias("x0"), F.lit(25.0).alias("x1"), F.lit(14.0).alias("x2"))
    return down.unionByName(down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), nodes, trees.nearest_roots(nodes, places)


def rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(trees.rooted_trees(*tree(spark, sf_dir)), "trees")


def g31_rooted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rooted(spark, sf_dir)
    return rounded(rows.select("case_id", F.col("node.k").alias("node"), F.col("parent.k").alias("parent"), "depth", "distance_mm", "on_main"))


def g32_major_bifurcations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.major_bifurcations(rooted(spark, sf_dir), 0.6).select("node.case_id", "node.k")


def g32_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every node."""
    rows = rooted(spark, sf_dir)
    return rounded(trees.directions(rows, rows.select("root", "node"), 7).select("node.case_id", "node.k", "d0", "d1", "d2"))


def g32_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, and their length along the tree, below every node; and the smallest node of each subtree."""
    rows = rooted(spark, sf_dir)
    starts = rows.select("root", "node")
    sums = trees.subtree_sums(rows, starts, F.col("distance_mm")).join(trees.subtree_sums(rows, starts, F.lit(1)).withColumnRenamed("total", "n"), ["root", "node"])
    least = trees.subtrees(rows, starts).groupBy("root", F.col("start").alias("node")).agg(F.min("node.k").alias("least"))
    return rounded(sums.join(least, ["root", "node"]).select("node.case_id", "node.k", "n", "total", "least"))


def g32_node_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trees.node_segments(points(spark, sf_dir).select("seg_id", F.struct("case_id", "p0", "p1").alias("node")))
    return rows.select("node.case_id", "node.p0", "node.p1", "seg_id")


QUERIES = {f.__name__: f for f in (g31_rooted_trees, g32_major_bifurcations, g32_directions, g32_subtrees, g32_node_segments)}


@cache
def tree_sql(*more: str, select: str) -> str:
    return with_ctes(
        "n AS (SELECT c_custkey // 300 AS case_id, c_custkey % 300 AS k, abs((c_custkey * 7 + floor(c_acctbal)::BIGINT) % 4) AS back, abs(floor(c_acctbal)::BIGINT) % 50 AS y, c_custkey * 13 % 29 AS z, 0.3::DOUBLE + c_custkey * 31 % 17 / 10.0::DOUBLE AS r FROM customer)",
        "down AS (SELECT a.case_id, a.k AS a, b.k AS b, sqrt((a.k - b.k)^2 + (a.y - b.y)^2 + (a.z - b.z)^2) * 0.5::DOUBLE AS len FROM n a JOIN n b ON b.case_id = a.case_id AND b.k > 0 AND a.k = greatest(0, b.k - 1 - b.back))",
        "links AS (SELECT * FROM down UNION ALL SELECT case_id, b, a, len FROM down)",
        "roots AS (SELECT case_id, arg_min(k, ((k - 140)^2 + (y - 25)^2 + (z - 14)^2) * 1000 + k) AS k FROM n GROUP BY case_id)",
        "t AS (SELECT case_id, k, NULL::BIGINT AS parent, 0 AS depth, 0.0::DOUBLE AS dist FROM roots UNION ALL SELECT l.case_id, l.b, l.a, depth + 1, dist + len FROM t JOIN links l ON l.case_id = t.case_id AND l.a = t.k AND (t.parent IS NULL OR l.b <> t.parent))",
        "kids AS (SELECT t.case_id, parent, t.k, r, row_number() OVER (PARTITION BY t.case_id, parent ORDER BY r DESC, t.k) AS turn FROM t JOIN n ON n.case_id = t.case_id AND n.k = t.k WHERE parent IS NOT NULL)",
        "main AS (SELECT case_id, k, 0 AS depth FROM roots UNION ALL SELECT c.case_id, c.k, depth + 1 FROM main m JOIN kids c ON c.case_id = m.case_id AND c.parent = m.k AND turn = 1)",
        *more,
        select=select,
    ).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES = {
    "g31_rooted_trees": tree_sql(select="SELECT case_id, k AS node, parent, depth, round(dist, 6) AS distance_mm, (case_id, k) IN (SELECT (case_id, k) FROM main) AS on_main FROM t"),
    "g32_major_bifurcations": tree_sql(
        select="""SELECT case_id, arg_min(k, depth) AS k FROM (SELECT m.case_id, m.k, m.depth FROM main m JOIN n USING (case_id, k) JOIN kids c ON c.case_id = m.case_id AND c.parent = m.k AND c.r >= 0.6 * n.r GROUP BY ALL HAVING count(*) >= 2) GROUP BY case_id"""
    ),
    "g32_directions": tree_sql(
        "way AS (SELECT case_id, k AS start, k, 0 AS step FROM n UNION ALL SELECT w.case_id, start, c.k, step + 1 FROM way w JOIN kids c ON c.case_id = w.case_id AND c.parent = w.k AND turn = 1 WHERE step < 7)",
        "e AS (SELECT case_id, start AS k, arg_max(k, step) AS last FROM way GROUP BY ALL)",
        "g AS (SELECT e.case_id, e.k, b.k - a.k AS x, b.y - a.y AS y, b.z - a.z AS z, sqrt((b.k - a.k)^2 + (b.y - a.y)^2 + (b.z - a.z)^2) AS norm FROM e JOIN n a ON a.case_id = e.case_id AND a.k = e.k JOIN n b ON b.case_id = e.case_id AND b.k = e.last)",
        select="SELECT case_id, k, coalesce(round(x / nullif(norm, 0), 6), 0) AS d0, coalesce(round(y / nullif(norm, 0), 6), 0) AS d1, coalesce(round(z / nullif(norm, 0), 6), 0) AS d2 FROM g",
    ),
    "g32_subtrees": tree_sql(
        "up AS (SELECT case_id, k AS start, k, dist FROM t UNION ALL SELECT u.case_id, u.start, t.parent, u.dist FROM up u JOIN t ON t.case_id = u.case_id AND t.k = u.k WHERE t.parent IS NOT NULL)",
        select="SELECT case_id, k, count(*) AS n, round(sum(dist), 6) AS total, min(start) AS least FROM up GROUP BY ALL",
    ),
    "g32_node_segments": with_ctes(POINTS, select="SELECT case_id, p0, p1, min(seg_id) AS seg_id FROM points GROUP BY ALL"),
}
