"""Closing gaps between fragments: pairs with larger fragments, bridges through a probability volume, cheapest paths, and whole-case compositions."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import drop_written, keyed_by_part, parts_for, written
from . import arteries, graph, metrics, profile
from . import voxels as vox


def component_boxes(labelled: DataFrame, margin: int = 5) -> DataFrame:
    """The box of each component, wider by margin: (case_id, component, low0..high2)."""
    ends = [f(f"a{k}") + s * margin for k in range(3) for f, s in ((F.min, -1), (F.max, 1))]
    names = [f"{n}{k}" for k in range(3) for n in ("low", "high")]
    return labelled.groupBy("case_id", "component").agg(*(e.alias(n) for e, n in zip(ends, names, strict=True)))


def midpoint_pairs(tips: DataFrame, skeleton: DataFrame, most_mm: float = 10.0, least_ratio: float = 0.35, spacing: float = 0.5) -> DataFrame:
    """For each fragment the shortest way from a tip of it to a skeleton voxel of a strictly larger one.

    tips: case_id, node, component, radius_mm, is_valid; skeleton: case_id, node, component, radius_mm. The fragment must not be the case's largest, and
    must hold less than half of its voxels or the tip be invalid. Ties go to the smaller nodes.
    """
    sizes = skeleton.groupBy("case_id", "component").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("largest", F.max("size").over(Window.partitionBy("case_id")))
    place = lambda p: [F.col(f"node.a{k}").cast("double").alias(f"{p}{k}") for k in range(3)]
    left = tips.join(sizes, ["case_id", "component"]).filter("size < largest and (size < 0.5 * largest or not is_valid)")
    left = left.select("case_id", F.struct("node", "component", "radius_mm", "size").alias("a"), *place("x"))
    right = skeleton.join(sizes, ["case_id", "component"]).select("case_id", F.struct("node", "component", "radius_mm", "size").alias("b"), *place("y"))
    pairs = vox.near_pairs(left, right, most_mm / spacing).filter("b.size > a.size")
    pairs = pairs.filter(scalars.radius_ratio(F.col("a.radius_mm"), F.col("b.radius_mm")) >= least_ratio)
    best = pairs.groupBy("case_id", F.col("a.component").alias("component")).agg(F.min(F.struct("distance", F.col("a.node").alias("tip"), F.col("b.node").alias("to"))).alias("m"))
    return best.select("case_id", "component", F.col("m.tip").alias("a"), F.col("m.to").alias("b"), (F.col("m.distance") * spacing).alias("distance_mm"))


def combine_pairs(pairs: DataFrame, midpoints: DataFrame, labels: DataFrame) -> DataFrame:
    """Tip pairs (case_id, a, b, distance_mm), and of the midpoint pairs those whose fragment no tip pair touches. labels: (node, component)."""
    of = labels.select("node", "component")
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).join(of, "node").select(F.col("node.case_id").alias("case_id"), "component").distinct()
    rest = midpoints.join(used, ["case_id", "component"], "left_anti")
    columns = ["case_id", "a", "b", "distance_mm"]
    return pairs.select(*columns, F.lit(False).alias("is_midpoint")).unionByName(rest.select(*columns, F.lit(True).alias("is_midpoint")))


def tubed(roi: DataFrame) -> DataFrame:
    """Where a region doesn't say which of its voxels lie in the tube, all do."""
    return roi if "in_tube" in roi.columns else roi.withColumn("in_tube", F.lit(True))


def threshold_bridges(gaps: DataFrame, roi: DataFrame, thresholds: tuple[float, ...] = (0.20, 0.15, 0.10)) -> DataFrame:
    """(gap_id, threshold): the highest threshold at which a gap's two ends touch, over faces, through its region; gaps that none joins are left out.

    gaps: gap_id and ends a, b as structs of a0, a1, a2; roi: gap_id, a0, a1, a2, p, in_mask, in_tube. Mask voxels always count, others where they
    lie in the tube and their probability is over the threshold.
    """
    # every gap and threshold is a case of its own, so one run of components serves all
    tries = tubed(roi).withColumn("t", F.explode(F.array(*map(F.lit, thresholds)))).filter("in_mask or (in_tube and p > t)")
    labelled = written(vox.components(tries.select(F.struct("gap_id", "t").alias("case_id"), *vox.AXES), 6), "labelled")
    at = lambda end: labelled.select("case_id", F.struct(*vox.AXES).alias(end), F.col("component").alias(f"{end}_component"))
    ends = gaps.withColumn("t", F.explode(F.array(*map(F.lit, thresholds)))).select(F.struct("gap_id", "t").alias("case_id"), "a", "b")
    same = ends.join(at("a"), ["case_id", "a"]).join(at("b"), ["case_id", "b"]).filter("a_component = b_component")
    return same.groupBy(F.col("case_id.gap_id").alias("gap_id")).agg(F.max("case_id.t").alias("threshold"))


def bridge_voxels(found: DataFrame, roi: DataFrame) -> DataFrame:
    """(gap_id, a0, a1, a2, p) that a bridge at its gap's threshold adds to the mask."""
    return tubed(roi).join(found, "gap_id").filter("in_tube and not in_mask and p > threshold").select("gap_id", *vox.AXES, "p")


def judge_bridges(found: DataFrame, roi: DataFrame, gaps: DataFrame, least_new: int = 10, most_new: int = 100) -> DataFrame:
    """(gap_id, threshold, n_new, expected, accepted): a bridge must add least_new voxels or more, and not both more than most_new and more than
    three times the cylinder between its ends with their mean radius. gaps: gap_id, a, b, radius_a, radius_b in voxels, at least 1 each."""
    n = bridge_voxels(found, roi).groupBy("gap_id").agg(F.count("*").alias("n_new"))
    reach = F.sqrt(sum(((F.col(f"a.a{k}") - F.col(f"b.a{k}")) ** 2 for k in range(1, 3)), (F.col("a.a0") - F.col("b.a0")) ** 2))
    radius = (F.greatest(F.lit(1.0), F.col("radius_a")) + F.greatest(F.lit(1.0), F.col("radius_b"))) / 2
    rows = found.join(gaps.select("gap_id", (math.pi * radius * radius * F.greatest(reach, F.lit(1.0))).alias("expected")), "gap_id").join(n, "gap_id", "left")
    rows = rows.withColumn("n_new", F.coalesce("n_new", F.lit(0).cast("long")))
    good = (F.col("n_new") >= least_new) & ~((F.col("n_new") > 3 * F.col("expected")) & (F.col("n_new") > most_new))
    return rows.select("gap_id", "threshold", "n_new", "expected", good.alias("accepted"))


def bridge_costs(gaps: DataFrame, roi: DataFrame, weight: float = 0.3) -> DataFrame:
    """Roi with cost: 1 - p (p up to 0.99) plus weight times the distance from the line between the ends over half its length (at least 1);
    10 outside the tube, 0.01 at the ends."""
    start, axis = [F.col(f"a.a{k}") for k in range(3)], [F.col(f"b.a{k}") - F.col(f"a.a{k}") for k in range(3)]
    dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
    own = [F.col(f"a{k}") - s for k, s in enumerate(start)]
    length, along = F.sqrt(dot(axis, axis)), dot(own, axis) / F.nullif(dot(axis, axis), F.lit(0))
    off = F.sqrt(F.greatest(dot(own, own) - along * along * dot(axis, axis), F.lit(0.0)))
    cost = 1 - F.greatest(F.lit(0.0), F.least(F.col("p"), F.lit(0.99))) + weight * F.coalesce(off, F.lit(0.0)) / F.greatest(length / 2, F.lit(1.0))
    at = lambda end: (F.col(f"{end}.a0") == F.col("a0")) & (F.col(f"{end}.a1") == F.col("a1")) & (F.col(f"{end}.a2") == F.col("a2"))
    rows = roi.join(gaps.select("gap_id", "a", "b"), "gap_id")
    return rows.select(*roi.columns, F.when(at("a") | at("b"), 0.01).when(~F.col("in_tube"), 10.0).otherwise(cost).alias("cost"))


def cheapest_paths(gaps: DataFrame, roi: DataFrame, hops: int = 3) -> DataFrame:
    """(gap_id, idx, a0, a1, a2): the cheapest 26-connected way from a to b in each gap's region (gap_id, a0, a1, a2, cost), a step
    costing the mean of its voxels' costs (over 0) times its length; ties go to the smaller voxel. Gaps without a way give no rows.

    All gaps relax together, `hops` steps a round; a voxel goes on only if it got cheaper, and no longer once it costs as much as the gap's far end, so
    what lies beyond is not searched. Paths are then read off their parents by doubling. A round deals its tables by gap once; its joins and minima find
    the rows of a gap together, so no step is sent.
    """
    spark = roi.sparkSession
    key = ["gap_id", *vox.AXES]
    cells = written(roi.select(*key, "cost"), "cells")
    gaps = written(gaps.select("gap_id", "a", "b"), "gaps")
    parts = parts_for(spark, cells.count(), 300_000)
    dealt = lambda rows: rows.repartition(parts, "gap_id")
    offsets = F.explode(vox.offsets(vox.ALL26)).alias("o")
    place = "struct<a0: int, a1: int, a2: int>"
    at = lambda end: gaps.select("gap_id", *(F.col(f"{end}.a{k}").cast("int").alias(f"a{k}") for k in range(3)))
    best = written(at("a").withColumns({"far": F.lit(0.0), "before": F.lit(None).cast(place)}).join(cells.select(*key), key, "left_semi"), "best")
    front = best

    def step(rows: DataFrame, wave: int, own: DataFrame, known: DataFrame, limit: DataFrame) -> DataFrame:
        """rows, and the neighbours of those of the last wave that get cheaper through them, as the next wave."""
        here = F.struct(*(F.col(a).cast("int").alias(a) for a in vox.AXES))
        around = F.explode(F.when(F.col("wave") == wave, vox.offsets([(0, 0, 0), *vox.ALL26])).otherwise(vox.offsets([(0, 0, 0)]))).alias("o")
        out = rows.join(own.hint("shuffle_hash"), key).select("gap_id", "before", "wave", here.alias("here"), F.col("cost").alias("cost0"), "far", *vox.AXES, around)
        length = F.sqrt(F.col("o.d0") ** 2 + F.col("o.d1") ** 2 + F.col("o.d2") ** 2)
        out = out.select("gap_id", "before", "wave", "here", "cost0", "far", length.alias("length"), *((F.col(a) + F.col(f"o.d{k}")).alias(a) for k, a in enumerate(vox.AXES))).join(own.hint("shuffle_hash"), key)
        new = F.struct((F.col("far") + (F.col("cost0") + F.col("cost")) / 2 * F.col("length")).alias("far"), F.col("here").alias("before"), F.lit(wave + 1).alias("wave"))
        out = out.select(*key, F.when(F.col("length") > 0, new).otherwise(F.struct("far", "before", "wave")).alias("m"))
        out = out.join(known.select(*key, F.col("far").alias("was")).hint("shuffle_hash"), key, "left").join(limit.hint("shuffle_hash"), "gap_id", "left")
        # before the minimum, as the least of what is kept is the least of all
        out = out.filter("(was is null or m.far < was - 1e-12) and (limit is null or m.far < limit)")
        return out.groupBy(*key).agg(F.min("m").alias("m")).select(*key, "m.far", "m.before", "m.wave")

    while True:
        own, known, new = dealt(cells), dealt(best), dealt(front.withColumn("wave", F.lit(0)))
        limit = dealt(at("b").join(best, key).select("gap_id", F.col("far").alias("limit")))
        with keyed_by_part(spark):
            for wave in range(hops):
                new = step(new, wave, own, known, limit)
            front = written(new.drop("wave"), "front")
        if front.isEmpty():
            break
        merged = written(best.join(front.select(*key), key, "left_anti").unionByName(front), "best")
        drop_written(spark, best)
        best = merged
    node = F.struct(*(F.col(a).cast("int").alias(a) for a in vox.AXES))
    parents = best.select(F.col("gap_id").alias("path_id"), node.alias("node"), F.coalesce("before", node).alias("parent"))
    ends = at("b").join(best.select(*key), key, "left_semi").select(F.col("gap_id").alias("path_id"), node.alias("node"))
    way = graph.ways_up(parents, ends).select(F.col("path_id").alias("gap_id"), "node.*").join(best.select(*key, "far"), key)
    # every step costs something, so the way is in order of what was paid so far
    order = Window.partitionBy("gap_id").orderBy("far")
    return way.select("gap_id", (F.row_number().over(order) - 1).alias("idx"), *vox.AXES)


def straight_ways(gaps: DataFrame) -> DataFrame:
    """(gap_id, idx, a0, a1, a2): evenly spaced points between the ends, as many as whole voxels between them and 2 at least, rounded half to even."""
    gap = [F.col(f"b.a{k}") - F.col(f"a.a{k}") for k in range(3)]
    n = F.greatest(F.floor(F.sqrt(gap[0] ** 2 + gap[1] ** 2 + gap[2] ** 2)), F.lit(2)).cast("int")
    rows = gaps.withColumn("n", n).withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = F.col("idx") / (F.col("n") - 1)
    return rows.select("gap_id", "idx", *(F.rint(F.col(f"a.a{k}") + at * g).cast("int").alias(f"a{k}") for k, g in enumerate(gap)))


#: What became of a gap.
STRATEGIES = {
    "skip": "skipped", "threshold": "probability_threshold", "path": "dijkstra_thin", "straight": "dijkstra_thin_straight_fallback",
    "unlikely": "skipped_low_probability", "low_signal": "skipped_low_signal",
}


def resegment(gaps: DataFrame, roi: DataFrame, paths: DataFrame | None = None, least_prob: float = 0.6, most_sinuosity: float = 1.8) -> tuple[DataFrame, DataFrame]:
    """G25-G28 and V19 as one plan: (details, voxels) of gaps (gap_id, a, b, radius_a, radius_b in voxels) in their regions.

    roi: gap_id, a0..a2, p (the larger of both models' probabilities), p_main (the main model's, may be null), in_mask, in_tube. Each gap goes
    down a ladder (see gap_decision): skipped where the main model sees nothing in its tube; else the voxels over the highest threshold
    that joins its ends, if judge_bridges accepts them; else the cheapest path (or the one in `paths`: gap_id, idx, a0..a2), in its place the straight
    way where the path winds or strays past 2 x the larger radius (5 voxels at least); taken if its mean probability is what the gap's tier needs, as a
    tube tapered from end to end. A gap whose ends no path joins takes the straight way as its path.

    details: gap_id, tier, strategy (one of STRATEGIES), threshold, sinuosity,
    avg_probability, n_new; voxels: gap_id, a0..a2, the new ones. Gaps without a voxel in their tube have combined_mean 0.
    """
    gaps = written(gaps.select("gap_id", "a", "b", *(F.greatest(F.lit(1.0), F.coalesce(r, F.lit(1.0))).alias(r) for r in ("radius_a", "radius_b"))), "gaps")
    roi = written(tubed(roi), "roi")
    means = roi.filter("in_tube").groupBy("gap_id").agg(F.avg("p_main").alias("tube_mean"), F.avg("p").alias("combined_mean"))
    tried = written(graph.gap_decision(gaps.join(means, "gap_id", "left"), least_prob), "tried")
    some = lambda action: gaps.join(tried.filter(F.col("action") == action).select("gap_id"), "gap_id", "left_semi")

    ends = written(some("threshold"), "ends")
    own = roi.join(ends.select("gap_id"), "gap_id", "left_semi")
    judged = written(judge_bridges(threshold_bridges(ends, own), own, ends), "judged")
    bridges = bridge_voxels(judged.filter("accepted").select("gap_id", "threshold"), own)
    by_threshold = bridges.groupBy("gap_id").agg(F.avg("p").alias("avg_probability"), F.count("*").alias("n_new"))
    by_threshold = written(by_threshold.join(judged.select("gap_id", "threshold"), "gap_id"), "by_threshold")

    going = written(some("path").unionByName(ends.join(by_threshold, "gap_id", "left_anti")), "going")
    near = roi.join(going.select("gap_id"), "gap_id", "left_semi")
    found = cheapest_paths(going, bridge_costs(going, near)) if paths is None else paths.join(going.select("gap_id"), "gap_id", "left_semi")
    straight = straight_ways(going)
    found = written(found.unionByName(straight.join(found.select("gap_id").distinct(), "gap_id", "left_anti")), "found")
    limits = going.select("gap_id", F.greatest(F.lit(5.0), 2 * F.greatest("radius_a", "radius_b")).alias("most_off"))
    points = found.join(limits, "gap_id").select(F.col("gap_id").alias("case_id"), F.lit(0).alias("path_id"), "idx", "most_off", *(F.col(f"a{k}").cast("double").alias(f"p{k}") for k in range(3)))
    checks = graph.path_checks(points, most_sinuosity, "most_off").select(F.col("case_id").alias("gap_id"), "sinuosity", "off_axis", "ok")
    # a path of one point is nowhere out of its way
    single = found.groupBy("gap_id").agg((F.count("*") < 2).alias("single"))
    checks = written(checks.join(single, "gap_id").select("gap_id", "sinuosity", (F.col("ok") | F.col("single")).alias("ok")), "checks")
    good = checks.filter("ok").select("gap_id")
    ways = written(found.join(good, "gap_id", "left_semi").unionByName(straight.join(good, "gap_id", "left_anti")), "ways")
    mean = ways.join(roi.select("gap_id", *vox.AXES, "p"), ["gap_id", *vox.AXES], "left").groupBy("gap_id").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("avg_probability"))
    rated = written(mean.join(checks, "gap_id").join(tried.select("gap_id", "path_needs"), "gap_id").withColumn("taken", F.col("avg_probability") >= F.col("path_needs")), "rated")
    taken = ways.join(rated.filter("taken").select("gap_id"), "gap_id", "left_semi")
    wide = vox.tapered(taken, gaps).withColumn("case_id", F.col("gap_id"))
    tubes = vox.stamp(wide, F.col("radius")).select(F.col("case_id").alias("gap_id"), *vox.AXES)
    tubes = tubes.join(roi.filter("in_tube and not in_mask").select("gap_id", *vox.AXES), ["gap_id", *vox.AXES], "left_semi")
    voxels = written(bridges.select("gap_id", *vox.AXES).unionByName(tubes), "voxels")

    by_path = rated.select("gap_id", "sinuosity", F.col("avg_probability").alias("path_mean"), F.when(~F.col("taken"), STRATEGIES["unlikely"]).when(F.col("ok"), STRATEGIES["path"]).otherwise(STRATEGIES["straight"]).alias("by_path"))
    rows = tried.join(by_threshold.select("gap_id", "threshold", "avg_probability"), "gap_id", "left").join(by_path, "gap_id", "left").join(voxels.groupBy("gap_id").agg(F.count("*").alias("n_new")), "gap_id", "left")
    strategy = F.when(F.col("action") == "skip", STRATEGIES["skip"]).when(F.col("threshold").isNotNull(), STRATEGIES["threshold"]).otherwise(F.coalesce("by_path", F.lit(STRATEGIES["low_signal"])))
    average = F.when(F.col("action") != "skip", F.coalesce("avg_probability", "path_mean", "combined_mean", F.lit(0.0)))
    details = rows.select("gap_id", "tier", strategy.alias("strategy"), "threshold", "sinuosity", average.alias("avg_probability"), F.coalesce("n_new", F.lit(0).cast("long")).alias("n_new"))
    return details, voxels


def label_near(ends: DataFrame, labelled: DataFrame, reach: int = 3) -> DataFrame:
    """(case_id, id, component) of each end (case_id, id, a0..a2): the component of its own voxel, else the most frequent one in the smallest cube around it, up to
    `reach` voxels each way, that holds any (ties to the first in scan order); ends without one are left out."""
    cube = sorted(itertools.product(range(-reach, reach + 1), repeat=3))
    spots = vox.moved(ends, cube, ["id"]).withColumn("ring", F.greatest(*(F.abs(F.col(f"a{k}") - F.col(f"b{k}")) for k in range(3))))
    hits = spots.select("id", "ring", *vox.KEY).join(labelled.select(*vox.KEY, "component"), vox.KEY)
    votes = hits.groupBy("case_id", "id", "component").agg(F.min("ring").alias("first"), *(F.count_if(F.col("ring") <= r).alias(f"n{r}") for r in range(reach + 1)))
    nearest = F.min("first").over(Window.partitionBy("case_id", "id"))
    rows = votes.withColumn("nearest", nearest).withColumn("n", F.element_at(F.array(*(f"n{r}" for r in range(reach + 1))), F.col("nearest") + 1)).filter("n > 0")
    return rows.groupBy("case_id", "id").agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("component"))


def merge_bridges(mask: DataFrame, bridges: DataFrame, gaps: DataFrame, least_new: int = 10, least_size: int = 50, search: int = 3) -> tuple[DataFrame, DataFrame]:
    """(mask, verified): the mask with each bridge (case_id, gap_id, a0, a1, a2) of least_new new voxels or more; then, in cases that got one, without components
    below least_size. For each gap (case_id, gap_id, ends a, b as structs) verified has whether its bridge was applied, and if so whether the labels near both ends
    are one (see label_near). Voxels are connected over faces."""
    bridges = written(bridges.select("case_id", "gap_id", *vox.AXES).distinct().join(mask.select(vox.KEY), vox.KEY, "left_anti"), "bridges")
    good = written(bridges.groupBy("case_id", "gap_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least_new).select("case_id", "gap_id", F.lit(True).alias("applied")), "good")
    whole = written(mask.select(vox.KEY).union(bridges.join(good, ["case_id", "gap_id"], "left_semi").select(vox.KEY)).distinct(), "merged")
    labelled = written(vox.components(whole, 6), "labelled")
    applied = written(gaps.join(good, ["case_id", "gap_id"]), "applied")
    at = lambda end: applied.select("case_id", F.struct("gap_id", F.lit(end).alias("end")).alias("id"), *(F.col(f"{end}.a{k}").alias(f"a{k}") for k in range(3)))
    near = label_near(at("a").unionByName(at("b")), labelled, search)
    same = near.groupBy("case_id", F.col("id.gap_id").alias("gap_id")).agg(((F.count("*") == 2) & (F.min("component") == F.max("component"))).alias("same"))
    state = applied.select("case_id", "gap_id", "applied").join(same, ["case_id", "gap_id"], "left")
    verified = gaps.select("case_id", "gap_id").join(state, ["case_id", "gap_id"], "left").select("case_id", "gap_id", F.coalesce("applied", F.lit(False)).alias("applied"), F.coalesce("same", F.lit(False)).alias("connected"))
    changed = good.select("case_id").distinct()
    small = vox.remove_small(labelled.join(changed, "case_id", "left_semi"), least_size)
    return small.select(vox.KEY).unionByName(labelled.join(changed, "case_id", "left_anti").select(vox.KEY)), verified


def refinement_summary(tips: DataFrame, pairs: DataFrame, verified: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Per case numbers of tips, invalid tips, pairs, connected pairs and voxels added."""
    count = lambda df, n: df.groupBy("case_id").agg(F.count("*").alias(n))
    rows = tips.groupBy("case_id").agg(F.count("*").alias("n_tips"), F.count_if(~F.col("is_valid")).alias("n_invalid")).join(count(pairs, "n_pairs"), "case_id", "left")
    rows = rows.join(verified.groupBy("case_id").agg(F.count_if("connected").alias("n_connected")), "case_id", "left").join(count(before, "b"), "case_id", "left").join(count(after, "n"), "case_id", "left")
    rows = rows.withColumn("voxels_added", F.coalesce("n", F.lit(0)) - F.coalesce("b", F.lit(0))).drop("n", "b")
    return rows.fillna(0)


def highlight(points: DataFrame, clicks: DataFrame, mask: DataFrame, least_radius: int = 4, wider: float = 1.5) -> DataFrame:
    """The mask near the way between two clicks: the nearest centerline points (case_id, seg_id, idx, p0..p2), the fewest hops between them along
    segments that meet, balls around the way, cut with the mask. Balls have least_radius, or `wider` times the point's radius (in voxels) where points have that column. clicks: case_id,
    s0..s2, e0..e2. Where no way exists, the two points alone."""
    at = points.select("case_id", F.struct("case_id", *(F.rint(f"p{k}").cast("int").alias(f"a{k}") for k in range(3))).alias("node"), "seg_id", "idx")
    order = Window.partitionBy("case_id", "seg_id").orderBy("idx")
    hops = at.withColumn("to", F.lead("node").over(order)).filter("to is not null and node <> to").select(F.col("node").alias("src"), F.col("to").alias("dst"))
    links = hops.union(hops.select("dst", "src")).distinct()
    spots = at.select("case_id", "node").distinct().select("case_id", F.col("node").alias("id_b"), *(F.col(f"node.a{k}").cast("double").alias(f"y{k}") for k in range(3)))

    def snapped(prefix: str) -> DataFrame:
        own = clicks.select("case_id", F.lit(prefix).alias("id_a"), *(F.col(f"{prefix}{k}").cast("double").alias(f"x{k}") for k in range(3)))
        return vox.nearest(own, spots).select(F.col("case_id").alias("path_id"), F.col("id_b").alias("node"))

    first, last = written(snapped("s"), "first"), written(snapped("e"), "last")
    way = graph.ways_up(written(graph.bfs(links, first), "tree"), last)
    way = way.union(last.select("path_id", "node")).union(first.select("path_id", "node")).select("node.*").distinct()
    if "radius" in points.columns:
        size = points.select("case_id", *(F.rint(f"p{k}").cast("int").alias(f"a{k}") for k in range(3)), "radius").groupBy(vox.KEY).agg(F.max("radius").alias("radius"))
        balls = vox.stamp(way.join(size, vox.KEY, "left"), F.greatest(F.lit(least_radius), F.rint(wider * F.coalesce("radius", F.lit(0.0)))))
    else:
        balls = vox.stamp(way, least_radius)
    return balls.join(mask.select(vox.KEY), vox.KEY, "left_semi")


def case_masks(truth: DataFrame, probs: DataFrame, shapes: DataFrame, spacing: tuple[float, float, float], target: tuple[float, float, float], threshold: float = 0.5, config: vox.Cleanup | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The truth (values) on the image's grid, cut at 0.3; the thresholded prediction (case_id, a0, a1, a2, p); and that prediction cleaned."""
    pred = probs.filter(F.col("p") >= threshold).select(vox.KEY)
    return vox.resample(truth, shapes, spacing, target).filter("value > 0.3").select(vox.KEY), pred, vox.cleanup(pred, shapes, config)[0]


def segment_ends(points: DataFrame, spacing: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(segments, junctions) as the artery split takes them: segments from their first to their last point, junctions at the places where these lie.
    points: case_id, seg_id, idx, n, length_mm, radius_mm, p0..p2."""
    whole = points.groupBy("case_id", "seg_id").agg(
        F.min_by(F.struct("p0", "p1", "p2"), "idx").alias("s"), F.max_by(F.struct("p0", "p1", "p2"), "idx").alias("e"), F.max("length_mm").alias("length_mm"),
        F.avg("radius_mm").alias("radius_mm"), F.count("*").alias("n_points"), F.max(F.when(F.col("idx") == F.floor(F.col("n") / 2), F.col("p1"))).alias("mid1"),
    )
    spots = whole.select("case_id", F.explode(F.array("s", "e")).alias("spot")).distinct()
    spots = written(spots.withColumn("node", F.row_number().over(Window.partitionBy("case_id").orderBy("spot")).cast("long")), "spots")
    at = lambda side, name: spots.select("case_id", F.col("spot").alias(side), F.col("node").alias(name))
    segments = whole.join(at("s", "start"), ["case_id", "s"]).join(at("e", "end"), ["case_id", "e"])
    wide = points.groupBy("case_id", F.struct("p0", "p1", "p2").alias("spot")).agg(F.max("radius_mm").alias("radius_mm"))
    junctions = spots.join(wide, ["case_id", "spot"]).select("case_id", "node", "spot.p0", "spot.p1", "spot.p2", "radius_mm")
    return segments.select("case_id", "seg_id", "start", "end", "length_mm", "radius_mm", "n_points", "mid1"), junctions


def artery_names(points: DataFrame, labelled: DataFrame, shapes: DataFrame, spacing: float = 0.5) -> DataFrame:
    """(case_id, seg_id, component, artery_name, tree_side, confidence, full_name): territories by component (G11, G13), and LM, LAD and LCx for segments of the left tree where it splits."""
    segments = graph.segment_component(points, labelled).filter("component is not null")
    names = written(graph.label_segments(segments, graph.territories(labelled)), "names")
    left = points.join(names.filter("tree_side = 'Left'").select("case_id", "seg_id"), ["case_id", "seg_id"], "left_semi")
    split = arteries.split_left(*segment_ends(left, spacing), labelled.select(vox.KEY), shapes, spacing)
    split = split.select("case_id", "seg_id", F.col("artery_name").alias("own"), F.col("confidence").alias("sure"))
    rows = names.join(split, ["case_id", "seg_id"], "left").withColumns({"artery_name": F.coalesce("own", "artery_name"), "confidence": F.coalesce("sure", "confidence")}).drop("own", "sure")
    return rows.withColumn("full_name", F.col("artery_name"))


def findings_from_mask(mask: DataFrame, shapes: DataFrame, points: DataFrame, config: vox.Cleanup | None = None, spacing: float = 0.5) -> DataFrame:
    """Clean the mask, keep the given centerline points that lie in it, name segments (see artery_names), detect narrowings.
    points: case_id, seg_id, idx, n, arc_mm, length_mm, radius_mm, start_bif, end_bif, p0..p2."""
    clean, _ = vox.cleanup(mask, shapes, config)
    labelled = written(vox.components(clean), "labelled")
    names = written(artery_names(points, labelled, shapes, spacing), "arteries")
    return profile.detect(points.join(names.select("case_id", "seg_id"), ["case_id", "seg_id"], "left_semi"), names)


def evaluate_models(pred: DataFrame, truth: DataFrame, shapes: DataFrame) -> DataFrame:
    """Tier-1 and tier-2 rows of all models and cases in one plan: pred has a model column; a (model, case) pair is one case throughout."""
    pair = F.struct("model", "case_id")
    p = written(pred.select(pair.alias("case_id"), *vox.AXES), "pred")
    models = pred.select("model", "case_id").distinct()
    t = written(truth.join(models, "case_id").select(pair.alias("case_id"), *vox.AXES), "truth")
    rows = metrics.overlap(vox.overlay(p, t)).join(metrics.surface_metrics(metrics.surface_distances(p, t)), "case_id").join(metrics.component_metrics(vox.components(p, 6)), "case_id", "left")
    return rows.select("case_id.model", F.col("case_id.case_id").alias("case"), *(c for c in rows.columns if c != "case_id"))
