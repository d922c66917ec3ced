"""Queries of graph operators (G1-G13, G16, G18-G22, G27-G28, G33, V17, V20) and, where SQL can say it, their SQL; on the sparse mask as a skeleton."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, profile
from ..operators import voxels as vox
from ..session import written
from .fixtures import MASKS, POINTS, VOXELS, graded, masks, points, voxels, with_ctes
from .profile_plans import rounded
from .voxel_plans import SHAPES, WEIGHTS, labelled, lerp, mirror, root, shapes

PLACE = lambda c: F.col(f"{c}.a0") * 64 + F.col(f"{c}.a1") * 8 + F.col(f"{c}.a2")
NEAR = "abs(s.a0 - r.a0) <= 1 AND abs(s.a1 - r.a1) <= 1 AND abs(s.a2 - r.a2) <= 1 AND (s.a0, s.a1, s.a2) <> (r.a0, r.a1, r.a2)"
LINKS = f"links AS (SELECT r.case_id, r.a0 * 64 + r.a1 * 8 + r.a2 AS src, s.a0 * 64 + s.a1 * 8 + s.a2 AS dst FROM sparse r JOIN sparse s ON s.case_id = r.case_id AND {NEAR})"


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks(spark, sf_dir)[2]


def g1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G4"""
    rows = graph.edge_list(graph.neighbours(skeleton(spark, sf_dir)))
    return rows.select("case_id", PLACE("src").alias("src"), PLACE("dst").alias("dst"))


def g2_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G18"""
    rows = skeleton(spark, sf_dir)
    out = graph.degrees(rows, graph.neighbours(rows))
    return out.select("case_id", PLACE("node").alias("place"), "degree", "is_endpoint", "is_bifurcation")


def radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A radius for each voxel: its value."""
    return voxels(spark, sf_dir).select(F.struct("case_id", "a0", "a1", "a2").alias("node"), F.col("value").alias("radius_mm"))


def merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = skeleton(spark, sf_dir)
    links = graph.neighbours(rows)
    return graph.merge_bifurcations(graph.degrees(rows, links).join(radii(spark, sf_dir), "node"), links, 1.5)


def g3_merged_bifurcations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir)[0].select("case_id", PLACE("node").alias("place"), PLACE("kept").alias("kept"))


def g3_moved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir)[1].select("case_id", PLACE("src").alias("src"), PLACE("dst").alias("dst"))


def g5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.trace_segments(graph.neighbours(skeleton(spark, sf_dir)), 3)
    return rows.select("case_id", "seg_id", "idx", PLACE("node").alias("place"), "n")


def g6_arc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("case_id", "seg_id", "idx", "p0", (F.col("radius_mm") * 3).alias("p1"), "p2")
    return rounded(graph.arc_length(rows).select("case_id", "seg_id", F.col("idx").cast("long").alias("idx"), "arc_mm", "length_mm"))


def g7_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("case_id", "seg_id", "idx", "p0", (F.col("radius_mm") * 3).alias("p1"), "p2")
    # a shift, so that no value lies where rounding could go either way
    out = graph.resample_curve(graph.arc_length(rows), 2.0)
    return rounded(out.withColumns({c: F.col(c) + 1.3e-6 for c in ("arc_mm", "p0", "p1", "p2")}), 4)


def g8_radius_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second point, moved, as the resampled curve; segments that leave the positive voxels take all their points."""
    rows = points(spark, sf_dir).select("case_id", "seg_id", F.col("idx").cast("int").alias("idx"), (F.col("idx") * 0.7).alias("p0"), (F.col("seg_id") % 8).cast("double").alias("p1"), (F.col("idx") * 0.37).alias("p2"))
    fine = rows.filter("idx % 2 = 0").withColumns({"idx": F.floor(F.col("idx") / 2).cast("int"), "p0": F.col("p0") + 0.25})
    distance = voxels(spark, sf_dir).withColumn("value", F.greatest(F.lit(0.0), F.col("value") + 0.08))
    return rounded(graph.radius_profile(rows, fine, distance, shapes(spark, sf_dir)).select("case_id", "seg_id", "idx", "radius_mm", "r"))


def g9_tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    nodes = rows.select("case_id", (F.col("seg_id") % 4 == 0).alias("is_bifurcation"), (F.col("idx") == 0).alias("is_endpoint"))
    return rounded(graph.tree_summary(rows, nodes))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox.components(skeleton(spark, sf_dir))


def g10_segment_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    n = F.count("*").over(profile.Window.partitionBy("case_id", "seg_id"))
    rows = rows.select("case_id", "seg_id", "idx", n.alias("n"), F.col("p0"), (F.col("seg_id") % 8).cast("double").alias("p1"), (F.col("idx") % 8).cast("double").alias("p2"))
    small = voxels(spark, sf_dir).filter("value > 0").select(*vox.KEY, (F.col("a0") % 3).alias("component"))
    return graph.segment_component(rows, small)


def g11_territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.territories(components(spark, sf_dir)).select("case_id", root(), "size", "share", "territory"))


def g12_merged_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.merge_components(components(spark, sf_dir), 1.6)
    return rows.select(*vox.KEY, (F.col("merged.a0") * 64 + F.col("merged.a1") * 8 + F.col("merged.a2")).alias("root"))


def g13_segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = graph.territories(components(spark, sf_dir)).select("case_id", (F.col("component.a0") % 50).alias("component"), "size", "share", "territory")
    areas = areas.groupBy("case_id", "component").agg(F.max("share").alias("share"), F.min("territory").alias("territory"))
    segments = points(spark, sf_dir).select("case_id", "seg_id", (F.col("seg_id") % 50).cast("int").alias("component")).distinct()
    return rounded(graph.label_segments(segments, areas))


def g16_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from the first voxel of each case's prediction."""
    rows = masks(spark, sf_dir)[0]
    links = vox.moved(rows, vox.FACES).join(rows, vox.KEY, "left_semi").select(F.struct("case_id", F.col("b0").alias("a0"), F.col("b1").alias("a1"), F.col("b2").alias("a2")).alias("src"), F.struct(*vox.KEY).alias("dst"))
    first = rows.groupBy(F.col("case_id").alias("path_id")).agg(F.min(F.struct(*vox.KEY)).alias("node"))
    out = graph.bfs(links, first)
    return out.select(F.col("path_id").alias("case_id"), PLACE("node").alias("place"), "depth")


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skeleton(spark, sf_dir)
    links = written(graph.neighbours(rows), "links")
    found = graph.tip_directions(graph.degrees(rows, links).filter("is_endpoint").select("case_id", "node"), links)
    return found.join(radii(spark, sf_dir), "node")


def g19_tip_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of tips and the mean value past them."""
    out = graph.look_beyond(tips(spark, sf_dir), voxels(spark, sf_dir), 3, 1)
    return rounded(out.select("case_id", PLACE("node").alias("place"), "d0", "d1", "d2", "beyond"))


def g21_tip_classes(spark: SparkSession, sf_dir: str, ends: DataFrame | None = None) -> DataFrame:
    rows = graph.look_beyond(ends or tips(spark, sf_dir), voxels(spark, sf_dir), 3, 1)
    rows = rows.withColumns({"radius_mm": F.col("radius_mm") * 3, "beyond": F.col("beyond") * 5, "beyond_prob": F.col("beyond"), "fragment_size": 400 + F.col("node.a2") % 2 * 200, "largest_size": F.lit(5000), "fragment_tips": F.col("node.a1") % 4})
    wide = shapes(spark, sf_dir).withColumns({"n1": F.lit(80), "n2": F.lit(80)})
    return rounded(graph.classify_tips(rows, wide).select("case_id", PLACE("node").alias("place"), "is_valid", "reason", "confidence"))


def g22_gap_pairs(spark: SparkSession, sf_dir: str, ends: DataFrame | None = None) -> DataFrame:
    labels = components(spark, sf_dir).select(F.struct(*vox.KEY).alias("node"), root().alias("component"))
    rows = graph.gap_pairs((ends or tips(spark, sf_dir)).join(labels, "node"), 4.0)
    return rounded(rows.select("case_id", PLACE("a").alias("a"), PLACE("b").alias("b"), "distance_mm", "alignment"))


def g27_path_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("case_id", F.col("seg_id").alias("path_id"), "idx", "p0", (F.col("radius_mm") * 3).alias("p1"), "p2")
    return rounded(graph.path_checks(rows, 3.0, 4.0))


def g28_gap_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means from the graded findings: unknown in the tube for every ninth."""
    tube = F.when(F.col("finding_id") % 9 != 0, F.col("gt_pct") / 500)
    rows = graded(spark, sf_dir).select("finding_id", tube.alias("tube_mean"), (F.col("pred_pct") / 400).alias("combined_mean"))
    return graph.gap_decision(rows).select("finding_id", "tier", "action", "path_needs")


def g33_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).groupBy("case_id", F.col("seg_id").alias("place")).agg(F.max("length_mm").alias("length_mm"))
    rows = rows.select("case_id", (F.col("place") % 3).alias("artery"), "place", F.col("place").alias("seg_id"), "length_mm")
    return rounded(graph.regions(rows).select("case_id", "artery", "seg_id", "at", "region"))


def v17_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of each case's graph; as many edges close one as the spanning forest leaves out."""
    rows = skeleton(spark, sf_dir)
    links = graph.neighbours(rows)
    counts = graph.cycle_counts(graph.degrees(rows, links), links)
    back = graph.back_edges(links, radii(spark, sf_dir)).groupBy("case_id").agg(F.count("*").alias("n_back"))
    return counts.join(back, "case_id", "left").select("case_id", "cycles", F.coalesce("n_back", F.lit(0)).alias("n_back"))


def v17_back_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that close a cycle, with their thinner node."""
    out = graph.back_edges(graph.neighbours(skeleton(spark, sf_dir)), radii(spark, sf_dir))
    return rounded(out.select("case_id", PLACE("src").alias("src"), PLACE("dst").alias("dst"), PLACE("thin").alias("thin"), "radius_mm"))


def v17_break_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skeleton(spark, sf_dir)
    return graph.break_cycles(rows, graph.neighbours(rows), radii(spark, sf_dir), 0.3, 0.5)


def v20_tube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes(spark, sf_dir).select("case_id", F.lit(1).alias("tube_id"), *(F.lit(2).alias(f"s{k}") for k in range(3)), (F.col("n0") - 3).alias("e0"), F.lit(5).alias("e1"), F.lit(6).alias("e2"), F.lit(0.5).alias("radius"))
    return rounded(graph.tube_members(masks(spark, sf_dir)[0], rows, 1.0, 1.5))


QUERIES = {f.__name__: f for f in (
    g1_links, g2_degrees, g3_merged_bifurcations, g3_moved_links, g5_segments, g6_arc_length, g7_resampled, g8_radius_profile, g9_tree_summary, g10_segment_component, g11_territories, g12_merged_components, g13_segment_labels, g16_shortest_paths,
    g19_tip_directions, g21_tip_classes, g22_gap_pairs, g27_path_checks, g28_gap_decision, g33_regions, v17_cycles, v17_back_edges, v17_break_cycles, v20_tube,
)}
B = (VOXELS, MASKS)
CURVE = "pts AS (SELECT case_id, seg_id, idx, p0, radius_mm * 3 AS p1, p2 FROM points), arcs AS (SELECT case_id, seg_id, idx, p0, p1, p2, sum(step) OVER (PARTITION BY case_id, seg_id ORDER BY idx) AS arc_mm FROM (SELECT *, coalesce(0.5 * sqrt((p0 - lag(p0) OVER w)^2 + (p1 - lag(p1) OVER w)^2), 0) AS step FROM pts WINDOW w AS (PARTITION BY case_id, seg_id ORDER BY idx)))"
AREAS = """areas AS (SELECT *, CASE WHEN n_big = 0 THEN 'Coronary' WHEN NOT big THEN 'Minor' WHEN n_big = 1 THEN 'Coronary' WHEN root = first_root THEN 'Right' WHEN root = last_root THEN 'Left' WHEN abs(centre - high) <= abs(centre - low) THEN 'Left' ELSE 'Right' END AS territory
  FROM (SELECT *, count(*) FILTER (big) OVER (PARTITION BY case_id) AS n_big, min(centre) OVER b AS low, max(centre) OVER b AS high, first(root) OVER (PARTITION BY case_id, big ORDER BY centre, root) AS first_root, first(root) OVER (PARTITION BY case_id, big ORDER BY centre DESC, root DESC) AS last_root
    FROM (SELECT case_id, root, count(*) AS size, avg(a2) AS centre, count(*) / sum(count(*)) OVER (PARTITION BY case_id) AS share, count(*) / sum(count(*)) OVER (PARTITION BY case_id) >= 0.05 AS big FROM labelled GROUP BY case_id, root) WINDOW b AS (PARTITION BY case_id, big)))"""
RECURSIVE = lambda *parts, select: with_ctes(*B, *parts, select=select).replace("WITH ", "WITH RECURSIVE ", 1)
STEP = lambda k: f"w{k + 1} AS (SELECT w.case_id, w.place, coalesce(min(l.dst), w.here) AS here, CASE WHEN min(l.dst) IS NULL THEN w.path ELSE list_append(w.path, min(l.dst)) END AS path FROM w{k} w LEFT JOIN links l ON l.case_id = w.case_id AND l.src = w.here AND NOT list_contains(w.path, l.dst) GROUP BY w.case_id, w.place, w.here, w.path)"
TIPS = ", ".join([
    "w0 AS (SELECT case_id, src AS place, src AS here, [src] AS path FROM links GROUP BY case_id, src HAVING count(*) = 1)", *(STEP(k) for k in range(5)),
    "g AS (SELECT case_id, place, place // 64 AS a0, place // 8 % 8 AS a1, place % 8 AS a2, place // 64 - here // 64 AS g0, place // 8 % 8 - here // 8 % 8 AS g1, place % 8 - here % 8 AS g2 FROM w5)",
    "tips AS (SELECT *, " + ", ".join(f"g{k} / nullif(sqrt(g0 * g0 + g1 * g1 + g2 * g2), 0) AS d{k}" for k in range(3)) + " FROM g)",
    "past AS (SELECT t.case_id, t.place, avg(v.value) AS beyond FROM tips t, (VALUES (1), (2), (3)) x(s) JOIN voxels v ON v.case_id = t.case_id AND " + " AND ".join(f"v.a{k} = round_even(t.a{k} + t.d{k} * s, 0)" for k in range(3)) + " GROUP BY ALL)",
    "seen AS (SELECT t.*, beyond, v.value, v.value * 3 AS radius FROM tips t LEFT JOIN past USING (case_id, place) JOIN voxels v ON v.case_id = t.case_id AND v.a0 = t.a0 AND v.a1 = t.a1 AND v.a2 = t.a2)",
])
BRANCHES = """bif AS (SELECT l.case_id, l.src AS place, l.src // 64 AS a0, l.src // 8 % 8 AS a1, l.src % 8 AS a2 FROM links l GROUP BY l.case_id, l.src HAVING count(*) >= 3),
joined AS (SELECT case_id, place, a0, a1, a2, place AS top FROM bif UNION SELECT s.case_id, s.place, s.a0, s.a1, s.a2, r.top FROM joined r JOIN bif s ON s.case_id = r.case_id AND (s.a0 - r.a0)^2 + (s.a1 - r.a1)^2 + (s.a2 - r.a2)^2 <= 2.25),
sets AS (SELECT j.case_id, j.place, min(j.top) AS top, any_value(v.value) AS value FROM joined j JOIN voxels v ON v.case_id = j.case_id AND v.a0 = j.a0 AND v.a1 = j.a1 AND v.a2 = j.a2 GROUP BY j.case_id, j.place),
moves AS (SELECT case_id, place, first(place) OVER (PARTITION BY case_id, top ORDER BY value DESC, place) AS kept FROM sets)"""
KEPT = "near AS (SELECT x.*, l.root, n.size, n.largest FROM (SELECT case_id, a0, a1, a2, a0 * 64 + a1 * 8 + a2 AS place, value FROM voxels) x JOIN labelled l USING (case_id, a0, a1, a2) JOIN (SELECT case_id, root, size, max(size) OVER (PARTITION BY case_id) AS largest FROM sizes) n USING (case_id, root))"
GAP = lambda x, y: f"sqrt(({x}.a0 - {y}.a0)^2 + ({x}.a1 - {y}.a1)^2 + ({x}.a2 - {y}.a2)^2)"
RATIO = "least(x.value, y.value) / greatest(x.value, y.value) >= 0.35"
DOT = lambda t: f"({t}.d0 * (y.a0 - x.a0) + {t}.d1 * (y.a1 - x.a1) + {t}.d2 * (y.a2 - x.a2))"
CYCLES = """edges AS (SELECT l.case_id, l.src, l.dst, least(x.value, y.value) AS r, CASE WHEN x.value <= y.value THEN l.src ELSE l.dst END AS thin FROM links l JOIN near x ON x.case_id = l.case_id AND x.place = l.src JOIN near y ON y.case_id = l.case_id AND y.place = l.dst WHERE l.src < l.dst),
met AS (SELECT case_id, src, dst, src AS node FROM edges UNION SELECT m.case_id, m.src, m.dst, CASE WHEN f.src = m.node THEN f.dst ELSE f.src END FROM met m JOIN edges e ON e.case_id = m.case_id AND e.src = m.src AND e.dst = m.dst JOIN edges f ON f.case_id = m.case_id AND (-f.r, f.src, f.dst) < (-e.r, e.src, e.dst) AND (f.src = m.node OR f.dst = m.node)),
back AS (SELECT e.* FROM edges e JOIN met m ON m.case_id = e.case_id AND m.src = e.src AND m.dst = e.dst AND m.node = e.dst)"""
ORACLES = {
    "g1_links": with_ctes(*B, LINKS, select="SELECT case_id, src, dst FROM links WHERE src < dst"),
    "g2_degrees": with_ctes(*B, LINKS, select="SELECT case_id, place, degree, degree = 1 AS is_endpoint, degree >= 3 AS is_bifurcation FROM (SELECT s.case_id, a0 * 64 + a1 * 8 + a2 AS place, count(dst) AS degree FROM sparse s LEFT JOIN links l ON l.case_id = s.case_id AND l.src = a0 * 64 + a1 * 8 + a2 GROUP BY ALL)"),
    "g3_merged_bifurcations": RECURSIVE(LINKS, BRANCHES, select="SELECT s.case_id, s.place, coalesce(kept, s.place) AS kept FROM (SELECT case_id, a0 * 64 + a1 * 8 + a2 AS place FROM sparse) s LEFT JOIN moves USING (case_id, place)"),
    "g3_moved_links": RECURSIVE(LINKS, BRANCHES, select="SELECT DISTINCT l.case_id, coalesce(x.kept, l.src) AS src, coalesce(y.kept, l.dst) AS dst FROM links l LEFT JOIN moves x ON x.case_id = l.case_id AND x.place = l.src LEFT JOIN moves y ON y.case_id = l.case_id AND y.place = l.dst WHERE coalesce(x.kept, l.src) <> coalesce(y.kept, l.dst)"),
    "g5_segments": RECURSIVE(LINKS, "deg AS (SELECT case_id, src AS place, count(*) AS degree FROM links GROUP BY ALL)",
        "walk AS (SELECT l.case_id, l.src AS prev, l.dst AS cur, [l.src, l.dst] AS path FROM links l JOIN deg d ON d.case_id = l.case_id AND d.place = l.src AND d.degree <> 2 UNION ALL SELECT w.case_id, w.cur, l.dst, list_append(w.path, l.dst) FROM walk w JOIN deg d ON d.case_id = w.case_id AND d.place = w.cur AND d.degree = 2 JOIN links l ON l.case_id = w.case_id AND l.src = w.cur AND l.dst <> w.prev)",
        "chains AS (SELECT w.case_id, path, len(path) AS n FROM walk w JOIN deg d ON d.case_id = w.case_id AND d.place = w.cur AND d.degree <> 2 WHERE len(path) >= 3 AND (path[1] < path[-1] OR (path[1] = path[-1] AND path[2] <= path[-2])))",
        "named AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY path[1], path[2]) - 1 AS seg_id FROM chains)",
        select="SELECT case_id, seg_id, unnest(range(n)) AS idx, unnest(path) AS place, n FROM named"),
    "g7_resampled": with_ctes(POINTS, CURVE, "ends AS (SELECT case_id, seg_id, count(*) AS n, max(arc_mm) AS len, greatest(4, floor(max(arc_mm) / 2.0::DOUBLE))::INT AS m FROM arcs GROUP BY ALL)",
        "pieces AS (SELECT case_id, seg_id, p0, p1, p2, arc_mm, lead(p0) OVER w AS q0, lead(p1) OVER w AS q1, lead(p2) OVER w AS q2, lead(arc_mm) OVER w AS arc_next FROM arcs WINDOW w AS (PARTITION BY case_id, seg_id ORDER BY idx))",
        "samples AS (SELECT case_id, seg_id, len, unnest(range(m)) AS j, len / (m - 1) AS gap FROM ends WHERE n >= 4 AND len > 0)",
        "placed AS (SELECT s.*, p0, p1, p2, q0, q1, q2, least(1, greatest(0, (j * gap - arc_mm) / (arc_next - arc_mm))) AS t FROM samples s JOIN pieces p ON p.case_id = s.case_id AND p.seg_id = s.seg_id AND arc_next > arc_mm AND arc_mm <= j * gap + 1e-9 AND (arc_next > j * gap + 1e-9 OR arc_next >= len))",
        select="SELECT case_id, seg_id, j::INT AS idx, round(j * gap + 1.3e-6, 4) AS arc_mm, round(p0 + t * (q0 - p0) + 1.3e-6, 4) AS p0, round(p1 + t * (q1 - p1) + 1.3e-6, 4) AS p1, round(p2 + t * (q2 - p2) + 1.3e-6, 4) AS p2 FROM placed UNION ALL SELECT case_id, seg_id, idx::INT, round(arc_mm + 1.3e-6, 4), round(p0 + 1.3e-6, 4), round(p1 + 1.3e-6, 4), round(p2 + 1.3e-6, 4) FROM arcs JOIN ends USING (case_id, seg_id) WHERE n < 4 OR len = 0"),
    "g8_radius_profile": with_ctes(VOXELS, SHAPES, POINTS, "dist AS (SELECT case_id, a0, a1, a2, greatest(0, value + 0.08::DOUBLE) AS value FROM voxels)",
        lerp("SELECT case_id, {'kind': kind, 'seg_id': seg_id, 'idx': idx} AS g, p0, p1, p2 FROM (SELECT 'raw' AS kind, case_id, seg_id, idx, idx * 0.7::DOUBLE AS p0, (seg_id % 8)::DOUBLE AS p1, idx * 0.37::DOUBLE AS p2 FROM points UNION ALL SELECT 'fine', case_id, seg_id, idx // 2, idx * 0.7::DOUBLE + 0.25, (seg_id % 8)::DOUBLE, idx * 0.37::DOUBLE FROM points WHERE idx % 2 = 0)").replace("JOIN voxels v", "JOIN dist v"),
        "radii AS (SELECT case_id, g.kind AS kind, g.seg_id AS seg_id, g.idx AS idx, value * 0.5::DOUBLE AS radius_mm, count(*) OVER (PARTITION BY case_id, g.seg_id, g.kind) AS n, min(value) FILTER (g.kind = 'fine') OVER (PARTITION BY case_id, g.seg_id) AS low, count(*) FILTER (g.kind = 'raw') OVER (PARTITION BY case_id, g.seg_id) AS n_raw, count(*) FILTER (g.kind = 'fine') OVER (PARTITION BY case_id, g.seg_id) AS n_fine FROM lerped)",
        "own AS (SELECT * FROM radii WHERE kind = CASE WHEN low <= 0 AND n_raw <> n_fine THEN 'raw' ELSE 'fine' END)", f"taps AS (SELECT * FROM (VALUES {WEIGHTS[2.0]}) t(k, w))",
        f"smoothed AS (SELECT o.case_id, o.seg_id, o.idx, sum(w * v.radius_mm) AS r FROM own o CROSS JOIN taps JOIN own v ON v.case_id = o.case_id AND v.seg_id = o.seg_id AND v.idx = {mirror('o.idx + k', 'o.n')} GROUP BY ALL)",
        select="SELECT case_id, seg_id, idx::INT AS idx, round(radius_mm, 6) AS radius_mm, round(CASE WHEN n >= 3 THEN r ELSE radius_mm END, 6) AS r FROM own JOIN smoothed USING (case_id, seg_id, idx)"),
    "g10_segment_component": with_ctes(VOXELS, POINTS, "n AS (SELECT case_id, seg_id, count(*) AS n FROM points GROUP BY ALL)", "tags AS (SELECT case_id, seg_id, unnest([n // 2, n // 4, n // 2, 3 * n // 4]) AS idx, unnest([true, false, false, false]) AS mid FROM n)",
        "spot AS (SELECT t.case_id, t.seg_id, mid, v.a0 % 3 AS component FROM tags t JOIN points p USING (case_id, seg_id, idx) LEFT JOIN voxels v ON v.value > 0 AND v.case_id = p.case_id AND v.a0 = round_even(p.p0, 0) AND v.a1 = t.seg_id % 8 AND v.a2 = t.idx % 8)",
        "middle AS (SELECT case_id, seg_id, max(component) FILTER (mid) AS middle FROM spot GROUP BY ALL)", "votes AS (SELECT case_id, seg_id, component, count(*) AS v FROM spot WHERE NOT mid AND component IS NOT NULL GROUP BY ALL)",
        "best AS (SELECT case_id, seg_id, arg_min(component, (-v, component)) AS vote FROM votes GROUP BY ALL)", select="SELECT case_id, seg_id, coalesce(middle, vote) AS component FROM middle LEFT JOIN best USING (case_id, seg_id)"),
    "g12_merged_components": RECURSIVE(labelled(26), "big AS (SELECT case_id, root FROM (SELECT case_id, root, size / sum(size) OVER (PARTITION BY case_id) AS share FROM sizes) WHERE share >= 0.05)",
        "spots AS (SELECT l.* FROM labelled l JOIN big USING (case_id, root))", f"bridges AS (SELECT DISTINCT x.case_id, x.root AS src, y.root AS dst FROM spots x JOIN spots y ON x.case_id = y.case_id AND x.root <> y.root WHERE {GAP('x', 'y')} * 0.5 < 1.6)",
        "tops AS (SELECT case_id, root, root AS top FROM big UNION SELECT r.case_id, b.dst, r.top FROM tops r JOIN bridges b ON b.case_id = r.case_id AND b.src = r.root)",
        select=f"SELECT case_id, a0, a1, a2, coalesce(top, root) AS root FROM labelled LEFT JOIN (SELECT case_id, root, min(top) AS top FROM tops GROUP BY ALL) USING (case_id, root)"),
    "g13_segment_labels": RECURSIVE(labelled(26), AREAS, POINTS, "own AS (SELECT case_id, root // 64 % 50 AS component, max(share) AS share, min(territory) AS territory FROM areas GROUP BY ALL)", "segs AS (SELECT DISTINCT case_id, seg_id, (seg_id % 50)::INT AS component FROM points)",
        select="SELECT s.case_id, seg_id, component, CASE WHEN territory IN ('Left', 'Right') THEN territory || ' Coronary' ELSE coalesce(territory, 'Unknown') END AS artery_name, coalesce(territory, 'Unknown') AS tree_side, CASE WHEN territory IS NULL THEN 0.4::DOUBLE WHEN share >= 0.15 THEN 0.9 WHEN share >= 0.05 THEN 0.7 ELSE 0.6 END AS confidence FROM segs s LEFT JOIN own USING (case_id, component)"),
    "g22_gap_pairs": RECURSIVE(labelled(26), LINKS, TIPS, "t AS (SELECT s.*, root FROM seen s JOIN labelled USING (case_id, a0, a1, a2))",
        f"near AS (SELECT x.case_id, x.place AS a, y.place AS b, x.root AS src, y.root AS dst, {GAP('x', 'y')} AS d, CASE WHEN x.d0 IS NULL OR y.d0 IS NULL THEN 0.5::DOUBLE ELSE greatest(0, ({DOT('x')} - {DOT('y')}) / {GAP('x', 'y')} / 2) END AS alignment FROM t x JOIN t y ON x.case_id = y.case_id AND x.place < y.place AND x.root <> y.root WHERE {GAP('x', 'y')} <= 8 AND {RATIO})",
        "pairs AS (SELECT * FROM near WHERE alignment >= 0.15)", "met AS (SELECT case_id, a, b, src AS node FROM pairs UNION SELECT c.case_id, c.a, c.b, CASE WHEN f.src = c.node THEN f.dst ELSE f.src END FROM met c JOIN pairs e ON e.case_id = c.case_id AND e.a = c.a AND e.b = c.b JOIN pairs f ON f.case_id = c.case_id AND (f.d, f.a, f.b) < (e.d, e.a, e.b) AND (f.src = c.node OR f.dst = c.node))",
        select="SELECT case_id, a, b, round(d * 0.5, 6) AS distance_mm, round(alignment, 6) AS alignment FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.case_id = p.case_id AND m.a = p.a AND m.b = p.b AND m.node = p.dst)"),
    "g23_midpoint_pairs": RECURSIVE(labelled(26), LINKS, TIPS, KEPT, "t AS (SELECT n.* FROM near n JOIN seen s USING (case_id, place) WHERE n.size < n.largest AND (n.size < 0.5 * n.largest OR NOT n.value > 0.3))",
        f"pairs AS (SELECT x.case_id, x.root, x.place AS a, y.place AS b, {GAP('x', 'y')} AS d FROM t x JOIN near y ON y.case_id = x.case_id AND y.size > x.size WHERE {GAP('x', 'y')} <= 6 AND {RATIO})",
        select="SELECT case_id, a, b, round(d * 0.5, 6) AS distance_mm FROM pairs QUALIFY row_number() OVER (PARTITION BY case_id, root ORDER BY d, a, b) = 1"),
    "g6_arc_length": with_ctes(POINTS, CURVE, select="SELECT case_id, seg_id, idx, round(arc_mm, 6) AS arc_mm, round(max(arc_mm) OVER (PARTITION BY case_id, seg_id), 6) AS length_mm FROM arcs"),
    "g9_tree_summary": with_ctes(POINTS, select="""SELECT case_id, count(*) FILTER (seg_id % 4 = 0) AS n_bifurcations, count(*) FILTER (idx = 0) AS n_endpoints, round(sum(length_mm) FILTER (idx = 0), 6) AS total_length_mm, count(DISTINCT seg_id) AS n_segments,
  round(min(radius_mm), 6) AS radius_min, round(max(radius_mm), 6) AS radius_max, round(avg(radius_mm), 6) AS radius_mean FROM points GROUP BY case_id"""),
    "g11_territories": RECURSIVE(labelled(26), AREAS, select="SELECT case_id, root, size, round(share, 6) AS share, territory FROM areas"),
    "g16_shortest_paths": RECURSIVE("f AS (SELECT case_id, a0 * 64 + a1 * 8 + a2 AS place, a0, a1, a2 FROM pred)", "r AS (SELECT case_id, a0, a1, a2, 0 AS depth FROM f WHERE (case_id, place) IN (SELECT (case_id, min(place)) FROM f GROUP BY case_id) UNION SELECT s.case_id, s.a0, s.a1, s.a2, r.depth + 1 FROM r JOIN pred s ON s.case_id = r.case_id AND abs(s.a0 - r.a0) + abs(s.a1 - r.a1) + abs(s.a2 - r.a2) = 1 WHERE r.depth < 40)", select="SELECT case_id, a0 * 64 + a1 * 8 + a2 AS place, min(depth) AS depth FROM r GROUP BY ALL"),
    "g19_tip_directions": with_ctes(*B, LINKS, TIPS, select="SELECT case_id, place, round(d0, 6) AS d0, round(d1, 6) AS d1, round(d2, 6) AS d2, round(beyond, 6) AS beyond FROM seen"),
    "g21_tip_classes": with_ctes(*B, SHAPES, LINKS, TIPS, "c AS (SELECT s.case_id, place, least(a0, n0 - 1 - a0, a1, 79 - a1, a2, 79 - a2) AS edge, radius, beyond * 5 AS image, beyond AS prob, 400 + a2 % 2 * 200 AS size, a1 % 4 AS ends FROM seen s JOIN shapes USING (case_id))",
        "r AS (SELECT case_id, place, CASE WHEN edge < 5 THEN 'boundary' WHEN radius > 1.5 THEN 'large_radius_abrupt_stop' WHEN image > 0.5 THEN 'contrast_continues' WHEN prob > 0.15 THEN 'model_prob_continues' WHEN size < 500 AND ends <= 2 THEN 'small_component_fragment' WHEN radius < 0.8 AND size < 500 THEN 'thin_fragment_tip' WHEN radius < 0.8 THEN 'thin_vessel_tip' ELSE 'default' END AS reason FROM c)",
        select="SELECT case_id, place, reason IN ('boundary', 'thin_vessel_tip', 'default') AS is_valid, reason, CASE reason WHEN 'boundary' THEN 0.9::DOUBLE WHEN 'large_radius_abrupt_stop' THEN 0.8 WHEN 'contrast_continues' THEN 0.7 WHEN 'thin_fragment_tip' THEN 0.6 WHEN 'thin_vessel_tip' THEN 0.75 WHEN 'default' THEN 0.5 ELSE 0.65 END AS confidence FROM r"),
    "g27_path_checks": with_ctes(POINTS, CURVE, "ends AS (SELECT case_id, seg_id, arg_min(p0, idx) AS s0, arg_min(p1, idx) AS s1, arg_max(p0, idx) AS e0, arg_max(p1, idx) AS e1, max(arc_mm) * 2 AS len FROM arcs GROUP BY ALL)",
        "c AS (SELECT case_id, seg_id, max(len) / nullif(max(sqrt((e0 - s0)^2 + (e1 - s1)^2)), 0) AS sinuosity, max(sqrt(greatest((p0 - s0)^2 + (p1 - s1)^2 - ((p0 - s0) * (e0 - s0) + (p1 - s1) * (e1 - s1))^2 / nullif((e0 - s0)^2 + (e1 - s1)^2, 0), 0))) AS off_axis FROM arcs JOIN ends USING (case_id, seg_id) GROUP BY ALL)",
        select="SELECT case_id, seg_id AS path_id, round(sinuosity, 6) AS sinuosity, round(off_axis, 6) AS off_axis, coalesce(sinuosity <= 3.0 AND off_axis <= 4.0, false) AS ok FROM c"),
    "g28_gap_decision": """SELECT finding_id, CASE WHEN m IS NULL THEN 'unknown' WHEN m < 0.03 THEN 'none' WHEN m < 0.08 THEN 'low_signal' ELSE 'normal' END AS tier,
  CASE WHEN m IS NOT NULL AND m < 0.03 THEN 'skip' WHEN c >= 0.15 THEN 'threshold' WHEN c >= 0.1 THEN 'path' ELSE 'low_signal' END AS action, CASE WHEN m < 0.08 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS path_needs
  FROM (SELECT o_orderkey AS finding_id, CASE WHEN o_orderkey % 9 <> 0 THEN (floor(o_totalprice)::BIGINT % 100) / 500.0::DOUBLE END AS m, ((floor(o_totalprice)::BIGINT + 13 * (o_orderkey % 7)) % 100) / 400.0::DOUBLE AS c FROM orders)""",
    "g33_regions": with_ctes(POINTS, "s AS (SELECT case_id, seg_id % 3 AS artery, seg_id, max(length_mm) AS length_mm FROM points GROUP BY ALL)", "r AS (SELECT *, (coalesce(sum(length_mm) OVER (PARTITION BY case_id, artery ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length_mm / 2) / sum(length_mm) OVER (PARTITION BY case_id, artery) AS \"at\" FROM s)",
        select="""SELECT case_id, artery, seg_id, round("at", 6) AS "at", CASE WHEN "at" < 0.33 THEN 'proximal' WHEN "at" < 0.67 THEN 'mid' ELSE 'distal' END AS region FROM r"""),
    "v17_cycles": RECURSIVE(labelled(26), LINKS, select="SELECT case_id, coalesce(e, 0) - v + c AS cycles, coalesce(e, 0) - v + c AS n_back FROM (SELECT case_id, count(*) AS v, count(DISTINCT root) AS c FROM labelled GROUP BY case_id) LEFT JOIN (SELECT case_id, count(*) AS e FROM links WHERE src < dst GROUP BY case_id) USING (case_id)"),
    "v17_back_edges": RECURSIVE(labelled(26), LINKS, KEPT, CYCLES, select="SELECT case_id, src, dst, thin, round(r, 6) AS radius_mm FROM back"),
    "v17_break_cycles": RECURSIVE(labelled(26), LINKS, KEPT, CYCLES, select="SELECT s.case_id, s.a0, s.a1, s.a2 FROM sparse s WHERE NOT EXISTS (SELECT 1 FROM back b WHERE b.r < 0.3 AND b.case_id = s.case_id AND (s.a0 - b.thin // 64)^2 + (s.a1 - b.thin // 8 % 8)^2 + (s.a2 - b.thin % 8)^2 <= 1)"),
    "v20_tube": with_ctes(*B, "g AS (SELECT case_id, max(a0) + 1 - 5 AS g0, 3 AS g1, 4 AS g2 FROM voxels GROUP BY case_id)", "t AS (SELECT p.*, sqrt(g0 * g0 + 25.0::DOUBLE) AS len, ((a0 - 2) * g0 + (a1 - 2) * g1 + (a2 - 2) * g2) / sqrt(g0 * g0 + 25.0::DOUBLE) AS along, (a0 - 2)^2 + (a1 - 2)^2 + (a2 - 2)^2 AS own FROM pred p JOIN g USING (case_id))",
        select="SELECT case_id, 1 AS tube_id, a0, a1, a2, round(sqrt(greatest(own - along * along, 0)), 6) AS off FROM t WHERE along >= -1 AND along <= len + 1 AND sqrt(greatest(own - along * along, 0)) <= 2.0"),
}
