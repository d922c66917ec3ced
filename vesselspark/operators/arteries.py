"""Splitting the left tree into left main, LAD and LCx: one walk from the root for all cases at once.

Segments: case_id, seg_id, start, end (nodes), length_mm, radius_mm (mean), n_points, mid1 (axis 1 of the middle point); junctions: case_id, node, p0..p2, radius_mm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..components import connected_components
from ..session import drop_written, written
from . import voxels as vox

#: Gaps up to which junctions are joined, length from which a branch is major, steps of the walk, points a branch needs, confidence.
REACH_MM, MAJOR_MM, MOST_STEPS, LEAST_POINTS, CONFIDENCE = 8.0, 10.0, 50, 5, 0.7
BRANCH = "struct<seg: long, other: long, length: double, degree: long, radius: double, points: long>"
STATE = ["case_id", "cur", "walked", "main", "joined", "bif", "branches"]


def adjacency(segments: DataFrame) -> DataFrame:
    """(case_id, here, other, seg_id, length_mm, radius_mm, n_points): each segment from both of its ends."""
    own = ["seg_id", "length_mm", "radius_mm", "n_points"]
    return segments.select("case_id", F.col("start").alias("here"), F.col("end").alias("other"), *own).unionAll(segments.select("case_id", "end", "start", *own))


def clear_pairs(junctions: DataFrame, mask: DataFrame, shapes: DataFrame, spacing: float = 0.5) -> DataFrame:
    """(case_id, here, other): junctions nearer than REACH_MM whose straight line stays in the mask at max(3, whole length) places, ends included.

    Lines that begin or end outside the mask are left out before they are cut into places; only junctions inside are spread over cells.
    """
    held = mask.select(vox.KEY).distinct()
    inside = lambda p, k: F.greatest(F.lit(0), F.least(F.col(f"n{k}") - 1, F.rint(p).cast("int"))).alias(f"a{k}")
    right = junctions.select("case_id", F.col("node").alias("here"), *(F.col(f"p{k}").alias(f"y{k}") for k in range(3))).join(shapes, "case_id")
    right = right.select("*", *(inside(F.col(f"y{k}"), k) for k in range(3))).join(held, vox.KEY, "left_semi").drop(*vox.AXES)
    left = junctions.select("case_id", F.col("node").alias("other"), *(F.col(f"p{k}").alias(f"x{k}") for k in range(3)))
    pairs = vox.near_pairs(left, right, REACH_MM / spacing).filter((F.col("here") != F.col("other")) & (F.col("distance") * spacing < REACH_MM))
    at = lambda t: [inside(F.col(f"y{k}") + t * (F.col(f"x{k}") - F.col(f"y{k}")), k) for k in range(3)]
    pairs = pairs.select("*", *at(F.lit(1.0))).join(held, vox.KEY, "left_semi").drop(*vox.AXES)
    n = F.greatest(F.lit(3), F.floor("distance").cast("int"))
    # written, as so few of the lines are left that the planner's guesses for what follows would be far too high
    places = written(pairs, "pairs").withColumn("n", n).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("t", F.col("t") / (F.col("n") - 1))
    seen = places.select("case_id", "here", "other", *at(F.col("t"))).hint("merge").join(held.withColumn("held", F.lit(True)), vox.KEY, "left")
    return seen.groupBy("case_id", "here", "other").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("clear")).filter("clear").drop("clear")


def roots(edges: DataFrame, junctions: DataFrame) -> DataFrame:
    """(case_id, cur): the junction with one link that lies highest on axis 0, ties to the smaller node; cases without one are left out."""
    lone = edges.groupBy("case_id", F.col("here").alias("node")).agg(F.count("*").alias("n")).filter("n = 1")
    return lone.join(junctions, ["case_id", "node"]).groupBy("case_id").agg(F.min_by("node", F.struct(-F.col("p0"), F.col("node"))).alias("cur"))


def subtree_lengths(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, other, subtree): total length of the segments that can be reached from each node without passing the case's current one."""
    own = state.select("case_id", "cur", "joined")
    real = edges.join(own.select("case_id", "cur"), "case_id").filter("here <> cur and other <> cur and here <> other")
    pseudo = own.select("case_id", "cur", F.inline("joined")).filter("here <> cur and other <> cur")
    node = lambda c: F.struct("case_id", F.col(c).alias("node"))
    links = real.select(node("here").alias("src"), node("other").alias("dst")).union(pseudo.select(node("here"), node("other")))
    parts = connected_components(links).select(F.col("node.case_id").alias("case_id"), F.col("node.node").alias("node"), "component")
    # each segment is there from both ends
    lengths = real.join(parts.withColumnRenamed("node", "here"), ["case_id", "here"]).groupBy("case_id", "component").agg((F.sum("length_mm") / 2).alias("subtree"))
    return parts.join(lengths, ["case_id", "component"]).select("case_id", F.col("node").alias("other"), "subtree")


def step(state: DataFrame, edges: DataFrame, degrees: DataFrame, junctions: DataFrame, clear: DataFrame | None) -> DataFrame:
    """One step of the walk of all cases that are still on their way; a case with bif or without cur has ended."""
    here = state.select("case_id", F.col("cur").alias("here"), "walked", "joined")
    held = lambda a, b: F.exists("joined", lambda j: ((j["here"] == a) & (j["other"] == b)) | ((j["here"] == b) & (j["other"] == a)))
    if clear is not None:
        new = here.join(clear, ["case_id", "here"]).filter(~F.array_contains("walked", F.col("other")) & ~held(F.col("here"), F.col("other")))
        new = new.join(edges.select("case_id", "here", "other").distinct(), ["case_id", "here", "other"], "left_anti")
        new = new.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("here", "other"))).alias("new"))
        state = state.join(new, "case_id", "left").withColumn("joined", F.concat("joined", F.coalesce("new", F.array().cast("array<struct<here: long, other: long>>")))).drop("new")
        state = written(state, "state")
        here = state.select("case_id", F.col("cur").alias("here"), "walked", "joined")
    real = here.join(edges, ["case_id", "here"]).select("case_id", "walked", F.col("seg_id").alias("seg"), "other", F.col("length_mm").alias("length"), F.col("radius_mm").alias("radius"), F.col("n_points").alias("points"))
    far = F.when(F.col("j.here") == F.col("here"), F.col("j.other")).when(F.col("j.other") == F.col("here"), F.col("j.here"))
    pseudo = here.select("case_id", "here", "walked", F.explode("joined").alias("j")).select("case_id", "walked", F.lit(-1).cast("long").alias("seg"), far.alias("other")).filter("other is not null")
    pseudo = pseudo.join(junctions.select("case_id", F.col("node").alias("other"), F.col("radius_mm").alias("radius")), ["case_id", "other"])
    pseudo = pseudo.select("case_id", "walked", "seg", "other", F.lit(0.0).alias("length"), "radius", F.lit(LEAST_POINTS).cast("long").alias("points"))
    ways = real.unionByName(pseudo).filter(~F.array_contains("walked", F.col("other"))).join(degrees.withColumnRenamed("here", "other"), ["case_id", "other"], "left").fillna(0, ["degree"])
    # segments in order, then junctions that were joined
    order = F.struct((F.col("seg") < 0).alias("late"), "seg", "other", F.struct("seg", "other", "length", "degree", "radius", "points").cast(BRANCH).alias("w"))
    ways = written(ways.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["w"]).alias("ways")), "ways")
    split = written(state.join(ways.filter("size(ways) > 1"), "case_id", "left_semi"), "split")
    # where no case has a choice in this step there is nothing to measure
    lengths = split.select("case_id", F.col("cur").alias("other"), F.lit(0.0).alias("subtree")).limit(0) if split.isEmpty() else subtree_lengths(split, edges)
    named = ways.filter("size(ways) > 1").select("case_id", F.posexplode("ways").alias("k", "w")).withColumn("other", F.col("w.other")).join(lengths, ["case_id", "other"], "left")
    minor = (F.col("w.seg") >= 0) & (F.col("w.length") < MAJOR_MM) & (F.col("w.degree") <= 1)
    named = named.withColumn("total", F.when(minor, F.col("w.length")).otherwise(F.coalesce("subtree", F.lit(0.0))))
    named = named.withColumn("major", ~minor & (F.col("total") >= MAJOR_MM))
    named = named.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("k", "w", "total", "major"))).alias("judged"))
    rows = state.join(ways, "case_id", "left").join(named, "case_id", "left")
    one, judged = F.get("ways", F.lit(0)), F.coalesce("judged", F.array().cast(named.schema["judged"].dataType))
    majors, rest = F.filter(judged, lambda b: b["major"]), F.filter(judged, lambda b: ~b["major"])
    best = F.array_max(F.transform(judged, lambda b: F.struct(b["total"].alias("total"), (-b["k"]).alias("k"), b["w"]["other"].alias("other"))))
    single, fork, forward = F.size("ways") == 1, F.size(majors) >= 2, F.size(majors) == 1
    segs = lambda a: F.filter(F.transform(a, lambda b: b["w"]["seg"]), lambda s: s >= 0)
    others = lambda a: F.transform(a, lambda b: b["w"]["other"])
    nothing = F.array().cast("array<bigint>")
    taken = F.when(single, F.filter(F.array(one["seg"]), lambda s: s >= 0)).when(fork | F.col("ways").isNull(), nothing).otherwise(segs(judged))
    reached = F.when(single, F.array(one["other"])).when(fork | F.col("ways").isNull(), nothing).otherwise(others(judged))
    cur = F.when(single, one["other"]).when(fork | F.col("ways").isNull(), F.lit(None)).when(forward, F.get(majors, F.lit(0))["w"]["other"]).otherwise(best["other"])
    return rows.select(
        "case_id", cur.cast("long").alias("cur"), F.array_union("walked", reached).alias("walked"), F.array_union("main", taken).alias("main"), "joined",
        F.when(fork, F.col("cur")).alias("bif"), F.when(fork, F.transform(majors, lambda b: b["w"])).alias("branches"),
    )


def walk_to_split(segments: DataFrame, junctions: DataFrame, mask: DataFrame | None = None, shapes: DataFrame | None = None, spacing: float = 0.5) -> DataFrame:
    """(case_id, bif, main, branches) of cases whose walk from the root comes to a junction with two or more major branches: main are the segments on
    the way and what is minor beside it. Without a mask no junctions are joined. At most MOST_STEPS steps, a few joins each, serve all cases."""
    spark = segments.sparkSession
    # few different places, so a file far smaller than what they take in memory
    junctions = written(junctions, "junctions").hint("merge")
    edges = written(adjacency(segments), "edges")
    degrees = written(edges.groupBy("case_id", "here").agg(F.count("*").alias("degree")), "degrees")
    clear = None if mask is None else written(clear_pairs(junctions, mask, shapes, spacing), "clear")
    none = "array<struct<here: long, other: long>>"
    state = roots(edges, junctions).select("case_id", F.col("cur").cast("long").alias("cur"), F.array(F.col("cur").cast("long")).alias("walked"), F.array().cast("array<bigint>").alias("main"), F.array().cast(none).alias("joined"), F.lit(None).cast("long").alias("bif"), F.lit(None).cast(f"array<{BRANCH}>").alias("branches"))
    state, ended = written(state, "state"), []
    for _ in range(MOST_STEPS):
        if state.isEmpty():
            break
        new = written(step(state, edges, degrees, junctions, clear), "state")
        ended.append(new.filter("bif is not null").select("case_id", "bif", "main", "branches"))
        going = written(new.filter("cur is not null"), "state")
        drop_written(spark, state)
        state = going
    out = ended[0] if ended else state.select("case_id", "bif", "main", "branches").limit(0)
    for more in ended[1:]:
        out = out.union(more)
    return out


def top_two(branches: Column) -> Column:
    """The two branches of largest radius, ties in the order given."""
    order = F.transform(branches, lambda b, k: F.struct((-b["radius"]).alias("r"), k.alias("k"), b.alias("b")))
    return F.transform(F.slice(F.array_sort(order), 1, 2), lambda x: x["b"])


def split_left(segments: DataFrame, junctions: DataFrame, mask: DataFrame | None = None, shapes: DataFrame | None = None, spacing: float = 0.5) -> DataFrame:
    """(case_id, seg_id, artery_name, confidence) of left segments: LM on the way to the first split, LAD where the middle point lies at or before the
    split on axis 1, else LCx; a segment whose neighbours, LM aside, all have the other name takes it, in order of seg_id.

    Cases whose walk finds no split, or whose two thickest branches do not both have LEAST_POINTS points, give no rows; nor do segments without points outside LM.
    """
    found = walk_to_split(segments, junctions, mask, shapes, spacing)
    found = written(found.filter(F.size(F.filter(top_two(F.col("branches")), lambda b: b["points"] >= LEAST_POINTS)) == 2).select("case_id", "bif", "main"), "splits")
    at = found.join(junctions.select("case_id", F.col("node").alias("bif"), F.col("p1").alias("split1")), ["case_id", "bif"])
    rows = segments.join(at, "case_id")
    name = F.when(F.array_contains("main", F.col("seg_id")), "LM").when(F.col("mid1") <= F.col("split1"), "LAD").when(F.col("mid1").isNotNull(), "LCx")
    rows = written(rows.select("case_id", "seg_id", "start", "end", name.alias("name")).filter("name is not null"), "named")
    sides = rows.filter("name <> 'LM'")
    ends = sides.select("case_id", "seg_id", F.explode(F.array_distinct(F.array("start", "end"))).alias("node"))
    near = ends.join(ends.withColumnRenamed("seg_id", "by"), ["case_id", "node"]).filter("seg_id <> by").select("case_id", "seg_id", "by").distinct()
    near = written(near, "near")
    labels = written(sides.select("case_id", "seg_id", "name"), "labels")
    first = labels
    while True:
        # a segment sees the new names of those before it and the first names of those after it, so rounds end where one pass in order would
        then = first.select("case_id", F.col("seg_id").alias("by"), F.col("name").alias("was")).join(labels.select("case_id", F.col("seg_id").alias("by"), F.col("name").alias("now")), ["case_id", "by"])
        seen = near.join(then, ["case_id", "by"]).groupBy("case_id", "seg_id").agg(F.collect_set(F.when(F.col("by") < F.col("seg_id"), F.col("now")).otherwise(F.col("was"))).alias("around"))
        other = F.when(F.col("name") == "LAD", "LCx").otherwise("LAD")
        new = first.join(seen, ["case_id", "seg_id"], "left").withColumn("name", F.when(F.coalesce(F.col("around") == F.array(other), F.lit(False)), other).otherwise(F.col("name"))).drop("around")
        new = written(new, "labels")
        same = new.join(labels, ["case_id", "seg_id", "name"], "left_anti").isEmpty()
        labels = new
        if same:
            break
    out = labels.unionByName(rows.filter("name = 'LM'").select("case_id", "seg_id", "name"))
    return out.select("case_id", "seg_id", F.col("name").alias("artery_name"), F.lit(CONFIDENCE).alias("confidence"))
