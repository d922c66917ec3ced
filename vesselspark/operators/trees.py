"""Rooted vessel trees: an Euler tour ranks the nodes, so that a subtree is an interval of numbers and sums along ways are running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..components import connected_components, list_ranks
from ..session import written
from . import graph


def nearest_roots(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(case_id, node): the node nearest to each case's place (case_id, x0..x2), ties to the smaller node. nodes: case_id, node, p0..p2."""
    rows = nodes.join(places, "case_id")
    far = sum(((F.col(f"p{k}") - F.col(f"x{k}")) ** 2 for k in range(1, 3)), (F.col("p0") - F.col("x0")) ** 2)
    return rows.groupBy("case_id").agg(F.min_by("node", F.struct(far, "node")).alias("node"))


def tree_links(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (src, dst), both ways, of the trees that a search over the fewest hops from the roots makes. A part without a cycle is its own tree and needs no search."""
    links = written(links.select("src", "dst").distinct(), "links")
    parts = written(connected_components(links.filter("src < dst")), "parts")
    size = parts.groupBy("component").agg(F.count("*").alias("nodes"))
    of = parts.withColumnRenamed("node", "src")
    count = links.join(of, "src").groupBy("component").agg((F.count("*") / 2).alias("edges"))
    rings = written(size.join(count, "component").filter("edges >= nodes").join(parts, "component").select(F.col("node").alias("src")), "rings")
    if rings.isEmpty():
        return links
    cyclic = links.join(rings, "src", "left_semi")
    ways = graph.bfs(cyclic, roots.select(F.col("node").alias("path_id"), "node")).filter("node <> parent")
    ways = ways.select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    return links.join(rings, "src", "left_anti").unionByName(ways).unionByName(ways.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def euler_tours(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, parent, enter, leave, first, size, depth) of the trees that have a root: links (src, dst) both ways, without cycles.

    A tour goes from each link on to the next link, in order, out of where it leads, and passes each link once down and once up; cut before the
    root's first link it is a list, which list ranking puts in order. enter and leave are the tour's steps into and out of a node's subtree, first numbers nodes
    by enter from 0, so that a subtree is first to first + size - 1.
    """
    links = written(links.select("src", "dst").distinct(), "links")
    order = Window.partitionBy("src").orderBy("dst")
    after = links.withColumn("to", F.coalesce(F.lead("dst").over(order), F.first("dst").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    begins = links.join(roots.select(F.col("node").alias("src")).distinct(), "src").groupBy("src").agg(F.min("dst").alias("begin"))
    after = after.join(begins, "src", "left")
    # after the link dst -> src in `after` the tour turns to src -> to
    cells = after.select(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")).alias("e"), F.when(F.col("begin").isNull() | (F.col("begin") != F.col("to")), F.struct("src", F.col("to").alias("dst"))).alias("nxt"))
    ranks = written(list_ranks(cells).select(F.col("last.dst").alias("root"), F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), "rank"), "ranks")
    pair = ranks.groupBy("root", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    # the way down comes first, so it is farther from the end
    pair = pair.agg(F.max(F.struct("rank", "src", "dst")).alias("down"), F.min("rank").alias("up"))
    steps = ranks.groupBy("root").agg(F.count("*").alias("steps"))
    rows = pair.join(steps, "root").select("root", F.col("down.dst").alias("node"), F.col("down.src").alias("parent"), (F.col("steps") - 1 - F.col("down.rank")).alias("enter"), (F.col("steps") - 1 - F.col("up")).alias("leave"))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("root").orderBy("enter")).cast("long"))
    # of enter + 1 steps so far `first` went down, the others up
    rows = rows.withColumns({"size": F.floor((F.col("leave") - F.col("enter") + 1) / 2), "depth": 2 * F.col("first") - F.col("enter") - 1})
    zero = F.lit(0).cast("long")
    tops = roots.select(F.col("node").alias("root")).distinct().join(steps, "root", "left").withColumn("steps", F.coalesce("steps", zero))
    tops = tops.select("root", F.col("root").alias("node"), F.when(F.lit(False), F.col("root")).alias("parent"), (zero - 1).alias("enter"), F.col("steps").alias("leave"), zero.alias("first"), F.floor(F.col("steps") / 2 + 1).alias("size"), zero.alias("depth"))
    return rows.unionByName(tops)


def along_ways(tours: DataFrame, **weights: Column) -> DataFrame:
    """tours with the sum of each weight over the nodes from below the root down to each node: a running sum of the tour that adds a node's weight on the way in and takes it off on the way out."""
    steps = F.explode(F.array(F.struct(F.col("enter").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("leave").alias("at"), F.lit(-1).alias("sign"))))
    rows = tours.withColumns({f"__{n}": F.when(F.col("parent").isNull(), 0).otherwise(w) for n, w in weights.items()}).withColumn("step", steps)
    order = Window.partitionBy("root").orderBy("step.at")
    rows = rows.withColumns({n: F.sum(F.col(f"__{n}") * F.col("step.sign")).over(order) for n in weights})
    return rows.filter("step.sign = 1").select(*tours.columns, *weights)


def rooted_trees(links: DataFrame, nodes: DataFrame, roots: DataFrame, spacing: float = 0.5) -> DataFrame:
    """(case_id, node, parent, depth, distance_mm, radius_mm, p0..p2, first, size, on_main) of every node that a case's root reaches.

    links: src, dst, both ways; nodes: case_id, node, p0..p2, radius_mm; roots: case_id, node. Parents lie on the way of the fewest hops, distance_mm is that
    way's length. first numbers a tree's nodes so that each is followed by its thickest child (ties to the smaller node), so subtrees are
    intervals and the way along thickest children is a stretch of numbers; on_main tells the root's own such way. Lists are ranked in a
    logarithmic number of rounds; all else are running sums of a tree.
    """
    tours = written(euler_tours(tree_links(links, roots), roots), "tours")
    place = [f"p{k}" for k in range(3)]
    above = nodes.select(F.col("node").alias("parent"), *(F.col(p).alias(f"q{k}") for k, p in enumerate(place)))
    rows = tours.join(nodes.select("case_id", "node", "radius_mm", *place), "node").join(above, "parent", "left")
    length = F.sqrt(sum(((F.col(f"p{k}") - F.col(f"q{k}")) ** 2 for k in range(1, 3)), (F.col("p0") - F.col("q0")) ** 2)) * spacing
    siblings = Window.partitionBy("root", "parent").orderBy(F.desc("radius_mm"), "node")
    rows = rows.withColumns({"length": length, "turn": F.row_number().over(siblings), "before": F.coalesce(F.sum("size").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    sums = along_ways(rows, distance_mm=F.col("length"), number=F.col("before") + 1, side=(F.col("turn") > 1).cast("int"))
    return sums.select("case_id", "root", "node", "parent", "depth", "distance_mm", "radius_mm", *place, F.col("number").alias("first"), "size", (F.col("side") == 0).alias("on_main"))


def major_bifurcations(trees: DataFrame, least_ratio: float = 0.35) -> DataFrame:
    """(root, node): the first node on the way along thickest children from each root that has two children or more of at least least_ratio of its radius; roots without one are left out."""
    child = trees.filter("parent is not null").select("root", F.col("parent").alias("node"), F.col("radius_mm").alias("child_mm"))
    large = child.join(trees.filter("on_main").select("root", "node", "radius_mm", "depth"), ["root", "node"]).filter(F.col("child_mm") >= least_ratio * F.col("radius_mm"))
    split = large.groupBy("root", "node", "depth").agg(F.count("*").alias("n")).filter("n >= 2")
    return split.groupBy("root").agg(F.min_by("node", "depth").alias("node"))


def directions(trees: DataFrame, starts: DataFrame, steps: int = 20) -> DataFrame:
    """(root, node, d0..d2): from each start (root, node) the unit vector to where up to `steps` thickest children lead; zero where nothing leads on.

    That way has the numbers after the start's, each one deeper than the one before, so all its nodes come by one join on numbers.
    """
    place = [f"p{k}" for k in range(3)]
    own = starts.join(trees, ["root", "node"]).select("root", "node", "depth", *(F.col(p).alias(f"s{k}") for k, p in enumerate(place)), F.explode(F.sequence(F.col("first"), F.col("first") + steps)).alias("at"), F.col("first").alias("base"))
    on = trees.select("root", F.col("first").alias("at"), F.col("depth").alias("deep"), *place)
    rows = own.join(on, ["root", "at"]).filter("deep - depth = at - base")
    ends = rows.groupBy("root", "node", *(f"s{k}" for k in range(3))).agg(F.max(F.struct("at", *place)).alias("end"))
    gap = [F.col(f"end.p{k}") - F.col(f"s{k}") for k in range(3)]
    norm = F.sqrt(gap[0] ** 2 + gap[1] ** 2 + gap[2] ** 2)
    return ends.select("root", "node", *(F.when(norm > 0, g / norm).otherwise(0.0).alias(f"d{k}") for k, g in enumerate(gap)))


def subtrees(trees: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, start, node) of every node in the subtree of each start (root, node)."""
    spans = starts.join(trees, ["root", "node"]).select("root", F.col("node").alias("start"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("first"))
    return spans.join(trees.select("root", "first", "node"), ["root", "first"]).select("root", "start", "node")


def subtree_sums(trees: DataFrame, starts: DataFrame, value: Column) -> DataFrame:
    """(root, node, total): the sum of value over each start's subtree, as the difference of two running sums by number."""
    upto = trees.select("root", "first", F.sum(value).over(Window.partitionBy("root").orderBy("first")).alias("upto"))
    spans = starts.join(trees, ["root", "node"]).select("root", "node", F.col("first").alias("low"), (F.col("first") + F.col("size") - 1).alias("high"))
    high = upto.select("root", F.col("first").alias("high"), F.col("upto").alias("to_high"))
    low = upto.select("root", (F.col("first") + 1).alias("low"), F.col("upto").alias("to_low"))
    return spans.join(high, ["root", "high"]).join(low, ["root", "low"], "left").select("root", "node", (F.col("to_high") - F.coalesce("to_low", F.lit(0))).alias("total"))


def node_segments(points: DataFrame) -> DataFrame:
    """(node, seg_id): the first segment that holds each node. points: seg_id, node."""
    return points.groupBy("node").agg(F.min("seg_id").alias("seg_id"))
