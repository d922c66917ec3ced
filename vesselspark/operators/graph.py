"""Vessel graphs from skeleton voxels: nodes, segments, labels, tips and gaps. A node is the struct (case_id, a0, a1, a2)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..components import connected_components, list_ranks
from ..functions import scalars
from ..session import drop_written, written
from . import profile
from . import voxels as vox


def node_of(*names: str) -> Column:
    return F.struct("case_id", *(F.col(n).alias(f"a{k}") for k, n in enumerate(names or vox.AXES)))


def neighbours(skeleton: DataFrame) -> DataFrame:
    """G1: (case_id, src, dst) both ways: skeleton voxels that touch by face, edge or corner."""
    rows = vox.moved(skeleton, vox.ALL26).join(skeleton.select(vox.KEY).hint("merge"), vox.KEY, "left_semi")
    return rows.select("case_id", node_of("b0", "b1", "b2").alias("src"), node_of().alias("dst"))


def degrees(skeleton: DataFrame, links: DataFrame) -> DataFrame:
    """(case_id, node, degree, is_endpoint, is_bifurcation)."""
    n = links.groupBy("src").agg(F.count("*").alias("degree"))
    rows = skeleton.select("case_id", node_of().alias("node")).join(n.withColumnRenamed("src", "node"), "node", "left")
    degree = F.coalesce("degree", F.lit(0).cast("long"))
    return rows.select("case_id", "node", degree.alias("degree"), (degree == 1).alias("is_endpoint"), (degree >= 3).alias("is_bifurcation"))


def edge_list(links: DataFrame) -> DataFrame:
    """G4"""
    return links.select("case_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct()


def merge_bifurcations(nodes: DataFrame, links: DataFrame, reach: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Bifurcations within reach become their member of largest radius_mm (ties to the smaller node); links are moved and self-links go.
    nodes: case_id, node, radius_mm, is_bifurcation. Returns (case_id, node, kept) and the new links."""
    spots = nodes.filter("is_bifurcation").select("case_id", "node", *(F.col(f"node.a{k}").cast("double").alias(f"x{k}") for k in range(3)))
    other = spots.select("case_id", F.col("node").alias("near"), *(F.col(f"x{k}").alias(f"y{k}") for k in range(3)))
    pairs = vox.near_pairs(spots, other, reach).filter("node < near")
    groups = connected_components(pairs, src="node", dst="near")
    members = groups.join(nodes.select("node", "radius_mm"), "node")
    best = members.groupBy("component").agg(F.min_by("node", F.struct(-F.col("radius_mm"), F.col("node"))).alias("kept"))
    moves = written(members.join(best, "component").select("node", "kept"), "moves")
    to = lambda c: moves.select(F.col("node").alias(c), F.col("kept").alias(f"{c}_kept"))
    rows = links.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    rows = rows.select("case_id", F.coalesce("src_kept", "src").alias("src"), F.coalesce("dst_kept", "dst").alias("dst")).filter("src <> dst").distinct()
    mapped = nodes.join(moves, "node", "left").select("case_id", "node", F.coalesce("kept", "node").alias("kept"))
    return mapped, rows


def trace_segments(links: DataFrame, least_nodes: int = 10) -> DataFrame:
    """(case_id, seg_id, idx, node, n): maximal chains of degree-2 nodes between end or branch nodes, of at least least_nodes nodes.

    Directed links are the list cells: a link into a degree-2 node goes on with the link out of it. Ranks come from pointer
    doubling, so rounds grow with the logarithm of the longest chain. Pure rings have no end and give no segment. A chain
    found both ways is kept from its smaller end (then smaller second node); seg_id numbers a case's chains by their first nodes.
    """
    links = written(links.select("case_id", "src", "dst").distinct(), "links")
    degree = written(links.groupBy("src").agg(F.count("*").alias("degree")), "degrees")
    inner = degree.filter("degree = 2").select(F.col("src").alias("dst"))
    out = links.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    follow = links.join(inner, "dst").join(out, "dst").filter("to <> src").select(F.struct("src", "dst").alias("e"), F.struct(F.col("dst").alias("src"), F.col("to").alias("dst")).alias("nxt"))
    done = written(list_ranks(links.select(F.struct("src", "dst").alias("e")).join(follow, "e", "left")), "ranks")
    starts = degree.filter("degree <> 2").select("src")
    chains = done.groupBy("last").agg(F.max("rank").alias("top"), F.max_by("e", "rank").alias("first"))
    chains = chains.filter(F.col("top") + 2 >= least_nodes).join(starts, F.col("first.src") == F.col("src"), "left_semi")
    forward = (F.col("first.src") < F.col("last.dst")) | ((F.col("first.src") == F.col("last.dst")) & (F.col("first.dst") <= F.col("last.src")))
    chains = chains.filter(forward).withColumn("case_id", F.col("first.src.case_id"))
    chains = written(chains.withColumn("seg_id", F.row_number().over(Window.partitionBy("case_id").orderBy("first")).cast("long") - 1), "chains")
    rows = done.select("e", "rank", "last").join(chains, "last")
    points = rows.select("case_id", "seg_id", (F.col("top") - F.col("rank")).alias("idx"), F.col("e.src").alias("node"), (F.col("top") + 2).alias("n"))
    ends = chains.select("case_id", "seg_id", (F.col("top") + 1).alias("idx"), F.col("last.dst").alias("node"), (F.col("top") + 2).alias("n"))
    return points.union(ends)


def arc_length(points: DataFrame, spacing: float = 0.5, keys: tuple[str, ...] = ("case_id", "seg_id")) -> DataFrame:
    """Points (keys, idx, p0, p1, p2) with arc_mm from the first and the segment's length_mm."""
    step = Window.partitionBy(*keys).orderBy("idx")
    move = F.sqrt(sum(((F.col(f"p{k}") - F.lag(f"p{k}").over(step)) ** 2 for k in range(1, 3)), (F.col("p0") - F.lag("p0").over(step)) ** 2)) * spacing
    rows = points.withColumn("step", F.coalesce(move, F.lit(0.0)))
    rows = rows.withColumn("arc_mm", F.sum("step").over(step)).drop("step")
    return rows.withColumn("length_mm", F.max("arc_mm").over(Window.partitionBy(*keys)))


def resample_curve(points: DataFrame, step_mm: float = 0.3, keys: tuple[str, ...] = ("case_id", "seg_id")) -> DataFrame:
    """Evenly spaced samples along each curve, max(4, int(length / step)) of them, by linear interpolation; curves of fewer than 4 points stay.
    Each sample is made by the piece of the curve that it lies on, so no join is needed."""
    order = Window.partitionBy(*keys).orderBy("idx")
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = points.withColumn("n", n).withColumns({f"q{k}": F.lead(f"p{k}").over(order) for k in range(3)}).withColumn("arc_next", F.lead("arc_mm").over(order))
    rows = rows.withColumn("m", F.greatest(F.lit(4), F.floor(F.col("length_mm") / step_mm)).cast("int"))
    short = rows.filter("n < 4 or length_mm = 0").select(*keys, F.col("idx").cast("int").alias("idx"), "arc_mm", "p0", "p1", "p2")
    gap = F.col("length_mm") / (F.col("m") - 1)
    low, high = F.ceil(F.col("arc_mm") / gap - 1e-9).cast("int"), F.ceil(F.col("arc_next") / gap - 1e-9).cast("int") - 1
    # the last piece of any length ends the curve
    final = F.col("arc_next") >= F.col("length_mm")
    high = F.when(final, F.col("m") - 1).otherwise(high)
    pieces = rows.filter("n >= 4 and length_mm > 0 and arc_next is not null").withColumn("gap", gap).withColumn("low", low).withColumn("high", high)
    pieces = pieces.filter("low <= high and arc_next > arc_mm").withColumn("j", F.explode(F.sequence("low", "high")))
    at = F.col("j") * F.col("gap")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - F.col("arc_mm")) / (F.col("arc_next") - F.col("arc_mm"))))
    long = pieces.select(*keys, F.col("j").alias("idx"), at.alias("arc_mm"), *((F.col(f"p{k}") + t * (F.col(f"q{k}") - F.col(f"p{k}"))).alias(f"p{k}") for k in range(3)))
    return long.unionByName(short)


def radius_profile(raw: DataFrame, resampled: DataFrame, distance: DataFrame, shapes: DataFrame, spacing: float = 0.5, sigma_mm: float = 1.0) -> DataFrame:
    """Points (case_id, seg_id, idx, p0..p2) with arc_mm, length_mm, radius_mm (the distance map, in voxels, sampled there) and r, that smoothed along the segment.

    A segment's resampled points count, unless one of them lies where the distance is 0 and they are not as many as the raw ones: then the curve has left the mask and the raw
    points count. Segments of fewer than three points are not smoothed.
    """
    place = ["p0", "p1", "p2"]
    blocks = written(vox.value_blocks(distance), "blocks")

    def sampled(points: DataFrame) -> DataFrame:
        points = points.select("case_id", F.struct("seg_id", "idx", *place).alias("point"), *place)
        rows = vox.sample_blocks(points, blocks, shapes, "point", "left")
        return rows.select("case_id", "point.*", F.coalesce(F.col("value") * spacing, F.lit(0.0)).alias("radius_mm"))

    first = written(sampled(resampled), "sampled")
    size = lambda rows, n: rows.groupBy("case_id", "seg_id").agg(F.count("*").alias(n))
    low = first.groupBy("case_id", "seg_id").agg(F.min("radius_mm").alias("low"), F.count("*").alias("n"))
    outside = written(low.join(size(raw, "m"), ["case_id", "seg_id"]).filter("low <= 0 and n <> m").select("case_id", "seg_id"), "outside")
    again = sampled(raw.join(outside, ["case_id", "seg_id"], "left_semi"))
    points = first.join(outside, ["case_id", "seg_id"], "left_anti").unionByName(again)
    rows = profile.smooth(arc_length(points, spacing), "radius_mm", "r", max(1.0, sigma_mm / spacing), ["case_id", "seg_id"])
    n = F.count("*").over(Window.partitionBy("case_id", "seg_id"))
    return rows.withColumn("r", F.when(n >= 3, F.col("r")).otherwise(F.col("radius_mm")))


def tree_summary(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per case total length, segments, bifurcations, endpoints and radii."""
    lengths = points.groupBy("case_id", "seg_id").agg(F.max("length_mm").alias("length_mm")).groupBy("case_id").agg(F.sum("length_mm").alias("total_length_mm"), F.count("*").alias("n_segments"))
    radii = points.groupBy("case_id").agg(F.min("radius_mm").alias("radius_min"), F.max("radius_mm").alias("radius_max"), F.avg("radius_mm").alias("radius_mean"))
    counts = nodes.groupBy("case_id").agg(F.count_if("is_bifurcation").alias("n_bifurcations"), F.count_if("is_endpoint").alias("n_endpoints"))
    return counts.join(lengths, "case_id", "left").join(radii, "case_id", "left")


def segment_component(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """(case_id, seg_id, component): that at the middle point, else the most frequent one at the quarter points (ties to the smaller), else null.
    points: case_id, seg_id, idx, n, p0, p1, p2; labelled: voxels with a component of any type."""
    n = F.col("n")
    tags = F.array(F.struct(F.floor(n / 2).alias("at"), F.lit(True).alias("mid")), F.struct(F.floor(n / 4).alias("at"), F.lit(False).alias("mid")), F.struct(F.floor(n / 2).alias("at"), F.lit(False).alias("mid")), F.struct(F.floor(3 * n / 4).alias("at"), F.lit(False).alias("mid")))
    picks = points.withColumn("tag", F.explode(tags)).filter(F.col("tag.at") == F.col("idx")).withColumn("mid", F.col("tag.mid"))
    at = picks.withColumns({f"a{k}": F.rint(f"p{k}").cast("int") for k in range(3)}).join(labelled.select(*vox.KEY, "component"), vox.KEY, "left")
    middle = at.groupBy("case_id", "seg_id").agg(F.max(F.when(F.col("mid"), F.col("component"))).alias("middle"))
    votes = at.filter("not mid and component is not null").groupBy("case_id", "seg_id", "component").agg(F.count("*").alias("v"))
    mode = votes.groupBy("case_id", "seg_id").agg(F.min_by("component", F.struct(-F.col("v"), F.col("component"))).alias("mode"))
    return middle.join(mode, ["case_id", "seg_id"], "left").select("case_id", "seg_id", F.coalesce("middle", "mode").alias("component"))


def territories(labelled: DataFrame, share: float = 0.05) -> DataFrame:
    """(case_id, component, size, share, territory): components of at least the share are significant. One: Coronary; else the one lowest on
    axis 2 is Right, the highest Left, those between go to the closer (ties Left); small ones Minor; none significant: all Coronary."""
    by, big = Window.partitionBy("case_id"), Window.partitionBy("case_id", "significant")
    rows = labelled.groupBy("case_id", "component").agg(F.count("*").alias("size"), F.avg("a2").alias("centre"))
    rows = rows.withColumn("share", F.col("size") / F.sum("size").over(by)).withColumn("significant", F.col("share") >= share)
    rows = rows.withColumn("n_big", F.count_if("significant").over(by)).withColumn("low", F.min("centre").over(big)).withColumn("high", F.max("centre").over(big))
    rows = rows.withColumn("lowest", F.min_by("component", F.struct("centre", "component")).over(big)).withColumn("highest", F.max_by("component", F.struct("centre", "component")).over(big))
    between = F.when(F.abs(F.col("centre") - F.col("high")) <= F.abs(F.col("centre") - F.col("low")), "Left").otherwise("Right")
    territory = (
        F.when(F.col("n_big") == 0, "Coronary").when(~F.col("significant"), "Minor").when(F.col("n_big") == 1, "Coronary")
        .when(F.col("component") == F.col("lowest"), "Right").when(F.col("component") == F.col("highest"), "Left").otherwise(between)
    )
    return rows.select("case_id", "component", "size", "share", territory.alias("territory"))


def merge_components(labelled: DataFrame, most_mm: float = 8.0, spacing: float = 0.5, share: float = 0.05) -> DataFrame:
    """Labelled voxels with `merged`, the smallest component that a significant one reaches over gaps below most_mm; small ones keep their own."""
    significant = written(territories(labelled, share).filter(F.col("share") >= share).select("case_id", "component"), "significant")
    own = labelled.join(significant, ["case_id", "component"], "left_semi")
    edge = written(vox.surface(own).join(own, vox.KEY).select("case_id", "component", *(F.col(a).cast("double").alias(f"x{k}") for k, a in enumerate(vox.AXES))), "edge")
    other = edge.select("case_id", F.col("component").alias("other"), *(F.col(f"x{k}").alias(f"y{k}") for k in range(3)))
    pairs = vox.near_pairs(edge, other, most_mm / spacing).filter((F.col("distance") * spacing < most_mm) & (F.col("component") < F.col("other")))
    pairs = pairs.select(F.struct("case_id", "component").alias("src"), F.struct("case_id", F.col("other").alias("component")).alias("dst")).distinct()
    groups = connected_components(pairs).select("node.*", F.col("component.component").alias("merged"))
    return labelled.join(groups, ["case_id", "component"], "left").withColumn("merged", F.coalesce("merged", "component"))


def label_segments(segments: DataFrame, areas: DataFrame | None) -> DataFrame:
    """Segments (case_id, seg_id, component) with artery_name, region, tree_side and confidence by their component's share; unmapped ones .4, without a mask .5."""
    if areas is None:
        return segments.withColumns({"artery_name": F.lit("Coronary"), "tree_side": F.lit("Unknown"), "confidence": F.lit(0.5)})
    rows = segments.join(areas.select("case_id", "component", "share", "territory"), ["case_id", "component"], "left")
    confidence = F.when(F.col("territory").isNull(), 0.4).when(F.col("share") >= 0.15, 0.9).when(F.col("share") >= 0.05, 0.7).otherwise(0.6)
    side = F.coalesce("territory", F.lit("Unknown"))
    name = F.when(side.isin("Left", "Right"), F.concat(side, F.lit(" Coronary"))).otherwise(side)
    return rows.select("case_id", "seg_id", "component", name.alias("artery_name"), side.alias("tree_side"), confidence.alias("confidence"))


def contracted(links: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (src, dst, hops) between nodes that have not two links or are kept, over chains of the others; and for each node of a chain both ways out of it
    (node, key, hops). Links must be given both ways; rings without a kept node are left out."""
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    inner = written(degree.filter("degree = 2").select(F.col("src").alias("node")).join(kept.select("node"), "node", "left_anti"), "inner")
    out = links.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    follow = links.withColumnRenamed("dst", "node").join(inner, "node").join(out, "node").filter("to <> src")
    follow = follow.select(F.struct("src", F.col("node").alias("dst")).alias("e"), F.struct(F.col("node").alias("src"), F.col("to").alias("dst")).alias("nxt"))
    ranks = list_ranks(links.select(F.struct("src", "dst").alias("e")).join(follow, "e", "left"))
    ways = ranks.select(F.col("e.src").alias("node"), F.col("last.dst").alias("key"), (F.col("rank") + 1).alias("hops"))
    ways = written(ways.join(inner.withColumn("inside", F.lit(True)), "node", "left"), "ways")
    edges = ways.filter("inside is null").groupBy(F.col("node").alias("src"), F.col("key").alias("dst")).agg(F.min("hops").alias("hops"))
    return written(edges.filter("src <> dst"), "edges"), ways.filter("inside").select("node", "key", "hops")


def depths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(path_id, node, depth): the fewest hops from each path's source over edges (src, dst, hops). A round a link of the way; all paths at once, and only nodes that got nearer go on."""
    spark = edges.sparkSession
    best = written(sources.select("path_id", "node", F.lit(0).cast("long").alias("depth")).distinct(), "best")
    front = best
    while True:
        step = front.withColumnRenamed("node", "src").join(edges, "src").groupBy("path_id", F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("hops")).alias("depth"))
        old = best.withColumnRenamed("depth", "was")
        front = written(step.join(old, ["path_id", "node"], "left").filter("was is null or depth < was").drop("was"), "front")
        if front.isEmpty():
            return best
        merged = written(best.join(front.select("path_id", "node"), ["path_id", "node"], "left_anti").unionByName(front), "best")
        drop_written(spark, best)
        best = merged


def bfs(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(path_id, node, parent, depth) of all nodes reached from each path's source over the fewest links, which must be given both ways;
    parents are the smallest possible, a source is its own.

    Chains of nodes with two links become one link each, so the search takes a round a branching, not a round a hop; nodes of chains
    take the nearer of both ends. A parent is the smallest neighbour that is one hop nearer.
    """
    links = written(links.select("src", "dst").distinct(), "links")
    sources = written(sources.select("path_id", "node"), "sources")
    edges, ways = contracted(links, sources.select("node").distinct())
    found = depths(edges, sources)
    chains = found.withColumnRenamed("node", "key").join(ways, "key").groupBy("path_id", "node").agg(F.min(F.col("depth") + F.col("hops")).alias("depth"))
    reached = written(found.unionByName(chains), "reached")
    near = reached.select("path_id", F.col("node").alias("src"), (F.col("depth") + 1).alias("depth")).join(links, "src")
    parents = near.groupBy("path_id", F.col("dst").alias("node"), "depth").agg(F.min("src").alias("parent"))
    return reached.join(parents, ["path_id", "node", "depth"], "left").select("path_id", "node", F.coalesce("parent", "node").alias("parent"), F.col("depth").cast("int").alias("depth"))


def ways_up(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """(path_id, node) on the ways from starts up to where a node is its own parent; each round knows twice as much of every way."""
    spark = parents.sparkSession
    up = written(parents.select("path_id", "node", "parent"), "up")
    way = written(starts.select("path_id", "node").join(up.select("path_id", "node"), ["path_id", "node"], "left_semi").distinct(), "way")
    while True:
        wider = written(way.union(way.join(up, ["path_id", "node"]).select("path_id", F.col("parent").alias("node"))).distinct(), "way")
        above = up.select("path_id", F.col("node").alias("parent"), F.col("parent").alias("over"))
        further = written(up.join(above, ["path_id", "parent"]).select("path_id", "node", F.col("over").alias("parent"), (F.col("over") != F.col("parent")).alias("moved")), "up")
        drop_written(spark, up, way)
        up, way = further.drop("moved"), wider
        if further.filter("moved").isEmpty():
            return way


def tip_directions(tips: DataFrame, links: DataFrame, steps: int = 5) -> DataFrame:
    """Tips (case_id, node) with the unit vector d0, d1, d2 from the place `steps` voxels back to the tip; null for a lone voxel. At each step the first unvisited neighbour in scan order is taken."""
    links = written(links.select("src", "dst").distinct(), "links")
    walk = tips.select("case_id", "node", F.col("node").alias("here"), F.array("node").alias("path"))
    for _ in range(steps):
        step = walk.join(links, walk["here"] == links["src"]).filter(~F.array_contains("path", F.col("dst")))
        step = step.groupBy("node").agg(F.min("dst").alias("next"))
        walk = walk.join(step, "node", "left").select("case_id", "node", F.coalesce("next", "here").alias("here"), F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"))
        walk = written(walk, "walk")
    gap = [F.col(f"node.a{k}") - F.col(f"here.a{k}") for k in range(3)]
    norm = F.sqrt(gap[0] ** 2 + gap[1] ** 2 + gap[2] ** 2)
    return walk.select("case_id", "node", *(F.when(norm > 0, g / norm).alias(f"d{k}") for k, g in enumerate(gap)))


def look_beyond(tips: DataFrame, voxels: DataFrame, samples: int = 5, stride: int = 2) -> DataFrame:
    """Tips with `beyond`, the mean value at up to `samples` places every `stride` voxels past the tip; null if none is in the volume."""
    rows = tips.filter("d0 is not null").withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    at = [F.rint(F.col(f"node.a{k}") + F.col(f"d{k}") * F.col("s") * stride).cast("int").alias(f"a{k}") for k in range(3)]
    found = rows.select("case_id", "node", *at).join(voxels.select(*vox.KEY, "value"), vox.KEY).groupBy("case_id", "node").agg(F.avg("value").alias("beyond"))
    return tips.join(found, ["case_id", "node"], "left")


def classify_tips(tips: DataFrame, shapes: DataFrame) -> DataFrame:
    """Tips (radius_mm, beyond, beyond_prob, fragment_size, largest_size, fragment_tips) with is_valid, reason and confidence, by the first rule that holds.
    Small fragments have fewer voxels than max(500, a tenth of the largest); with one or two tips they are gaps, with more a thin tip of theirs still is."""
    rows = tips.join(shapes, "case_id")
    edge = scalars.near_boundary([F.col(f"node.a{k}") for k in range(3)], [F.col(f"n{k}") for k in range(3)])
    small, thin = F.col("fragment_size") < F.greatest(F.lit(500), F.floor(F.col("largest_size") * 0.1)), F.col("radius_mm") < 0.8
    # fixed values: verdicts, reasons and confidences
    rules = [
        (edge, True, "boundary", 0.9), (F.col("radius_mm") > 1.5, False, "large_radius_abrupt_stop", 0.8), (F.col("beyond") > 0.5, False, "contrast_continues", 0.7),
        (F.col("beyond_prob") > 0.15, False, "model_prob_continues", 0.65), (small & (F.col("fragment_tips") <= 2), False, "small_component_fragment", 0.65),
        (thin & small, False, "thin_fragment_tip", 0.6), (thin, True, "thin_vessel_tip", 0.75), (F.lit(True), True, "default", 0.5),
    ]
    pick = lambda at: F.coalesce(*(F.when(F.coalesce(r[0], F.lit(False)), F.lit(r[at])) for r in rules))
    return rows.select("case_id", "node", pick(1).alias("is_valid"), pick(2).alias("reason"), pick(3).alias("confidence"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest by Boruvka rounds, of edges (edge_id, src, dst, weight); ties by edge_id. Each round every part takes its lightest edge outwards, so parts at least halve."""
    edges = written(edges.select("edge_id", "src", "dst", "weight"), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = written(nodes.withColumn("part", F.col("node")), "parts")
    chosen = None
    while True:
        to = lambda c: labels.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"))  # noqa: B023, E731
        live = edges.join(to("src"), "src").join(to("dst"), "dst").filter("src_part <> dst_part")
        both = live.select("edge_id", "weight", F.col("src_part").alias("part")).union(live.select("edge_id", "weight", "dst_part"))
        light = written(both.groupBy("part").agg(F.min(F.struct("weight", "edge_id")).alias("m")).select(F.col("m.edge_id").alias("edge_id")).distinct(), "light")
        if light.isEmpty():
            break
        chosen = light if chosen is None else written(chosen.union(light), "chosen")
        taken = edges.join(chosen, "edge_id", "left_semi")
        labels = connected_components(taken, nodes).withColumnRenamed("component", "part")
    return edges.limit(0) if chosen is None else edges.join(chosen, "edge_id", "left_semi")


def gap_pairs(tips: DataFrame, most_mm: float = 10.0, least_alignment: float = 0.15, least_ratio: float = 0.35, spacing: float = 0.5) -> DataFrame:
    """Pairs of invalid tips (case_id, node, component, radius_mm, d0..d2) of different components within range, aligned and alike in radius; of
    them the shortest that join components without a cycle, ties by nodes. That greedy choice is the minimum spanning forest."""
    left = tips.select("case_id", *(F.col(f"node.a{k}").cast("double").alias(f"x{k}") for k in range(3)), F.struct("node", "component", "radius_mm", "d0", "d1", "d2").alias("a"))
    right = left.select("case_id", *(F.col(f"x{k}").alias(f"y{k}") for k in range(3)), F.col("a").alias("b"))
    pairs = vox.near_pairs(left, right, most_mm / spacing).filter("a.node < b.node and a.component <> b.component")
    aligned = scalars.alignment([F.col(f"x{k}") for k in range(3)], [F.col(f"y{k}") for k in range(3)], [F.col(f"a.d{k}") for k in range(3)], [F.col(f"b.d{k}") for k in range(3)])
    pairs = pairs.withColumn("alignment", aligned).withColumn("distance_mm", F.col("distance") * spacing)
    pairs = pairs.filter((F.col("alignment") >= least_alignment) & (scalars.radius_ratio(F.col("a.radius_mm"), F.col("b.radius_mm")) >= least_ratio))
    pairs = written(pairs.select("case_id", F.struct("a.node", F.col("b.node").alias("to")).alias("edge_id"), F.struct("case_id", "a.component").alias("src"), F.struct("case_id", "b.component").alias("dst"), F.col("distance_mm").alias("weight"), "alignment"), "pairs")
    kept = spanning_forest(pairs).select("edge_id")
    return pairs.join(kept, "edge_id", "left_semi").select("case_id", F.col("edge_id.node").alias("a"), F.col("edge_id.to").alias("b"), F.col("weight").alias("distance_mm"), "alignment")


def cycle_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(case_id, cycles): edges - nodes + components of each case's graph."""
    edges = edge_list(links).groupBy("case_id").agg(F.count("*").alias("e"))
    parts = connected_components(links, nodes.select("node")).groupBy(F.col("node.case_id").alias("case_id")).agg(F.count("*").alias("v"), F.count_distinct("component").alias("c"))
    return parts.join(edges, "case_id", "left").select("case_id", (F.coalesce("e", F.lit(0)) - F.col("v") + F.col("c")).alias("cycles"))


def back_edges(links: DataFrame, radius: DataFrame) -> DataFrame:
    """Edges that close a cycle: those outside the spanning forest that prefers thick nodes, with their thinner node. radius: (node, radius_mm)."""
    r = lambda c: radius.select(F.col("node").alias(c), F.col("radius_mm").alias(f"{c}_r"))
    edges = edge_list(links).join(r("src"), "src").join(r("dst"), "dst")
    edges = written(edges.select("case_id", F.struct("src", "dst").alias("edge_id"), "src", "dst", (-F.least("src_r", "dst_r")).alias("weight"), F.when(F.col("src_r") <= F.col("dst_r"), F.col("src")).otherwise(F.col("dst")).alias("thin")), "edges")
    return edges.join(spanning_forest(edges).select("edge_id"), "edge_id", "left_anti").select("case_id", "src", "dst", "thin", (-F.col("weight")).alias("radius_mm"))


def break_cycles(mask: DataFrame, links: DataFrame, radius: DataFrame, thin_mm: float = 0.5, clear_mm: float = 1.0, spacing: float = 0.5) -> DataFrame:
    """The mask without a ball around the thin node of each edge that closes a cycle, where that is thinner than thin_mm."""
    spots = back_edges(links, radius).filter(F.col("radius_mm") < thin_mm).select("thin.*").distinct()
    return mask.select(vox.KEY).join(vox.stamp(spots, round(clear_mm / spacing)), vox.KEY, "left_anti")


def path_checks(points: DataFrame, most_sinuosity: float = 1.8, most_off: float | str = 10.0) -> DataFrame:
    """Per path (case_id, path_id, idx, p0..p2): length over chord, farthest distance from the chord, and whether both are within limits; most_off may name a column of points, each path's own limit."""
    order = Window.partitionBy("case_id", "path_id").orderBy("idx")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = points.withColumns({f"s{k}": F.first(f"p{k}").over(whole) for k in range(3)} | {f"e{k}": F.last(f"p{k}").over(whole) for k in range(3)})
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    chord = [F.col(f"e{k}") - F.col(f"s{k}") for k in range(3)]
    own = [F.col(f"p{k}") - F.col(f"s{k}") for k in range(3)]
    move = [F.col(f"p{k}") - F.lag(f"p{k}").over(order) for k in range(3)]
    along = dot(own, chord) / F.nullif(dot(chord, chord), F.lit(0.0))
    off = F.sqrt(F.greatest(dot(own, own) - along * along * dot(chord, chord), F.lit(0.0)))
    rows = rows.withColumn("move", F.sqrt(dot(move, move))).withColumn("off", off).withColumn("chord", F.sqrt(dot(chord, chord)))
    limit = F.max(most_off) if isinstance(most_off, str) else F.lit(most_off)
    out = rows.groupBy("case_id", "path_id").agg((F.sum("move") / F.nullif(F.max("chord"), F.lit(0.0))).alias("sinuosity"), F.max("off").alias("off_axis"), limit.alias("limit"))
    return out.withColumn("ok", F.coalesce((F.col("sinuosity") <= most_sinuosity) & (F.col("off_axis") <= F.col("limit")), F.lit(False))).drop("limit")


def tube_members(voxels: DataFrame, tubes: DataFrame, extend: float = 6.0, margin: float = 10.0) -> DataFrame:
    """Voxels in each tube (case_id, tube_id, s0..e2, radius, in voxels): ends moved out by extend, radius plus margin, by distance from the axis and place along it.
    A tube whose ends coincide has no axis: its whole box counts, at the distance from that point."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    gap = [F.col(f"e{k}") - F.col(f"s{k}") for k in range(3)]
    rows = tubes.withColumn("len", F.sqrt(dot(gap, gap))).withColumns({f"u{k}": F.when(F.col("len") > 0, g / F.col("len")).otherwise(0.0) for k, g in enumerate(gap)}).withColumn("r", F.col("radius") + margin)
    low = {f"low{k}": F.floor(F.least(f"s{k}", f"e{k}") - F.col("r") - extend) for k in range(3)}
    high = {f"high{k}": F.ceil(F.greatest(f"s{k}", f"e{k}") + F.col("r") + extend) for k in range(3)}
    rows = vox.with_chunks(voxels).join(vox.over_chunks(rows.withColumns(low | high)), ["case_id", *vox.CHUNKS]).filter(" and ".join(f"a{k} between low{k} and high{k}" for k in range(3)))
    own, u = [F.col(f"a{k}") - F.col(f"s{k}") for k in range(3)], [F.col(f"u{k}") for k in range(3)]
    along = dot(own, u)
    rows = rows.withColumn("along", along).withColumn("off", F.sqrt(F.greatest(dot(own, own) - along * along, F.lit(0.0))))
    within = (F.col("along") >= -extend) & (F.col("along") <= F.col("len") + extend) & (F.col("off") <= F.col("r"))
    return rows.filter((F.col("len") == 0) | within).select("case_id", "tube_id", *vox.AXES, "off")


def gap_decision(gaps: DataFrame, least_prob: float = 0.6) -> DataFrame:
    """What to do with each gap, and with what mean probability its path must come.

    Gaps have tube_mean, the main model's mean in the gap's tube (null if unknown), and combined_mean, the mean there of the larger of both
    models' probabilities. Where tube_mean is below 0.03 the gap is skipped; below 0.08 its tier is low_signal and a path needs 0.8 or more, else
    least_prob. Of the rest combined_mean says what is tried first: a bridge at a threshold from 0.15 on (where none is accepted, a
    path), a path from 0.1 on, else nothing. Action is skip, threshold, path or low_signal (nothing was tried).
    """
    tube, both = F.col("tube_mean"), F.coalesce("combined_mean", F.lit(0.0))
    tier = F.when(tube.isNull(), "unknown").when(tube < 0.03, "none").when(tube < 0.08, "low_signal").otherwise("normal")
    needed = F.when(tube < 0.08, F.greatest(F.lit(least_prob), F.lit(0.8))).otherwise(F.lit(least_prob))
    action = F.when(tube < 0.03, "skip").when(both >= 0.15, "threshold").when(both >= 0.1, "path").otherwise("low_signal")
    return gaps.withColumns({"tier": tier, "action": action, "path_needs": needed})


def regions(points: DataFrame, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """Segments in order along their artery (case_id, artery, place, seg_id, length_mm) as proximal, mid or distal by the place of their middle."""
    by = Window.partitionBy("case_id", "artery")
    before = F.sum("length_mm").over(by.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    at = (F.coalesce(before, F.lit(0.0)) + F.col("length_mm") / 2) / F.sum("length_mm").over(by)
    return points.withColumn("at", at).withColumn("region", F.when(F.col("at") < low, "proximal").when(F.col("at") < high, "mid").otherwise("distal"))


def ball_weight(d: Column, sigma: float) -> Column:
    return F.exp(-d * d / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))
