"""Queries of voxel operators (P3-P7, P16, V1-V16, V19, V22-V23, A1-A5, A8, T7, U1-U4, J5-J10) and their SQL, on `embeddings` as volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metrics, profile
from ..operators import voxels as vox
from ..session import written
from .fixtures import MASKS, POINTS, VOXELS, masks, points, voxels, with_ctes
from .profile_plans import rounded, sql_round

SHAPES = "shapes AS (SELECT case_id, max(a0) + 1 AS n0, 8 AS n1, 8 AS n2 FROM voxels GROUP BY case_id)"
FACES = "faces AS (SELECT * FROM (VALUES (-1,0,0),(1,0,0),(0,-1,0),(0,1,0),(0,0,-1),(0,0,1)) f(d0, d1, d2))"
KEY = "case_id, a0, a1, a2"


def count_faces(mask: str) -> str:
    return f"(SELECT m.{KEY.replace(', ', ', m.')}, count(x.case_id) AS n FROM {mask} m CROSS JOIN faces LEFT JOIN {mask} x ON x.case_id = m.case_id AND x.a0 = m.a0 + d0 AND x.a1 = m.a1 + d1 AND x.a2 = m.a2 + d2 GROUP BY ALL)"


SURFACES = f"""
surf_p AS (SELECT {KEY} FROM {count_faces("pred")} WHERE n < 6), surf_t AS (SELECT {KEY} FROM {count_faces("truth")} WHERE n < 6),
dist AS (SELECT p.case_id, 'p' AS side, 0.5 * min(sqrt((p.a0 - t.a0)^2 + (p.a1 - t.a1)^2 + (p.a2 - t.a2)^2)) AS d FROM surf_p p JOIN surf_t t USING (case_id) GROUP BY p.case_id, p.a0, p.a1, p.a2
  UNION ALL SELECT t.case_id, 't', 0.5 * min(sqrt((p.a0 - t.a0)^2 + (p.a1 - t.a1)^2 + (p.a2 - t.a2)^2)) FROM surf_t t JOIN surf_p p USING (case_id) GROUP BY t.case_id, t.a0, t.a1, t.a2)
"""


def labelled(k: int) -> str:
    """Components of the sparse mask by recursion: each voxel gets the smallest key it reaches."""
    near = "abs(s.a0 - r.a0) <= 1 AND abs(s.a1 - r.a1) <= 1 AND abs(s.a2 - r.a2) <= 1" if k == 26 else "abs(s.a0 - r.a0) + abs(s.a1 - r.a1) + abs(s.a2 - r.a2) = 1"
    return f"""reach AS (SELECT {KEY}, a0 * 64 + a1 * 8 + a2 AS root FROM sparse UNION SELECT s.case_id, s.a0, s.a1, s.a2, r.root FROM reach r JOIN sparse s ON s.case_id = r.case_id AND {near}),
labelled AS (SELECT {KEY}, min(root) AS root FROM reach GROUP BY ALL),
sizes AS (SELECT case_id, root, count(*) AS size, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, root) AS place FROM labelled GROUP BY case_id, root)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).groupBy("case_id").agg((F.max("a0") + 1).alias("n0"), F.lit(8).alias("n1"), F.lit(8).alias("n2"))


def root() -> F.Column:
    return (F.col("component.a0") * 64 + F.col("component.a1") * 8 + F.col("component.a2")).alias("root")


def p3_window_and_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values clipped to a window and to each named preset, summed by case."""
    rows = voxels(spark, sf_dir).withColumn("v", F.col("value") * 10)
    parts = {"window": scalars.clip(F.col("v"), -0.5, 0.7)} | {n.lower().replace(" ", "_"): scalars.clip(F.col("v"), *w) for n, w in scalars.WINDOWS.items()}
    return rounded(rows.groupBy("case_id").agg(*(F.sum(c).alias(n) for n, c in parts.items())), 4)


def p4_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vox.zscore(voxels(spark, sf_dir), 2.0).drop("value"))


def p5_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, truth, sparse = masks(spark, sf_dir)
    count = lambda df, n: df.groupBy("case_id").agg(F.count("*").alias(n))
    return count(pred, "n_pred").join(count(truth, "n_truth"), "case_id", "full").join(count(sparse, "n_sparse"), "case_id", "full")


def p6_reorient(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = shapes(spark, sf_dir).withColumn("axes", F.array(F.lit(2), F.lit(0), F.lit(1))).withColumn("flips", F.array(F.col("case_id") % 2 == 0, F.lit(True), F.lit(False)))
    return rounded(vox.reorient(voxels(spark, sf_dir), plan))


def p7_millimetres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voxels(spark, sf_dir)
    mm = [scalars.to_mm(F.col(a), F.lit(0.7)).alias(f"mm{k}") for k, a in enumerate(vox.AXES)]
    back = [scalars.to_voxel(F.col(f"mm{k}") + 0.35, F.lit(0.7)).alias(f"back{k}") for k in range(3)]
    return rounded(rows.select(*vox.KEY, *mm).select("*", *back))


def v1_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vox.take_slice(voxels(spark, sf_dir), shapes(spark, sf_dir), 0, 47).select(*vox.KEY, "value"))


def v2_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for every 10 slices of each case."""
    boxes = shapes(spark, sf_dir).select("case_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n0") - 1) / 10))).alias("box_id"))
    boxes = boxes.withColumns({"low0": F.col("box_id") * 10, "high0": F.col("box_id") * 10 + 12, "low1": F.lit(2), "high1": F.lit(5), "low2": F.col("box_id") % 3, "high2": F.lit(6)})
    return rounded(vox.in_boxes(voxels(spark, sf_dir), boxes).groupBy("case_id", "box_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def v4_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vox.resample(voxels(spark, sf_dir), shapes(spark, sf_dir), (0.5, 0.5, 0.5), (0.8, 0.4, 0.5)))


def v5_sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point near each voxel."""
    rows = voxels(spark, sf_dir)
    points = rows.select("case_id", (F.col("a0") * 64 + F.col("a1") * 8 + F.col("a2")).alias("point_id"), (F.col("a0") + 0.3).alias("p0"), (F.col("a1") - 0.4).alias("p1"), (F.col("a2") + 0.55).alias("p2"))
    return rounded(vox.sample_points(points, voxels(spark, sf_dir), shapes(spark, sf_dir)))


def v6_nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voxels(spark, sf_dir)
    points = rows.select("case_id", (F.col("a0") * 64 + F.col("a1") * 8 + F.col("a2")).alias("point_id"), (F.col("a0") + 0.5).alias("p0"), (F.col("a1") + F.col("a2") * 1.0).alias("p1"), (F.col("a2") - 0.2).alias("p2"))
    return rounded(vox.nearest_value(points, rows, "value", F.lit(0.0)).select("case_id", "point_id", "value"))


def v7_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vox.blur(voxels(spark, sf_dir), shapes(spark, sf_dir), 1.0))


def v3_crop_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 6 x 6 voxels around the brightest place of each wide case."""
    rows = voxels(spark, sf_dir).withColumn("value", F.col("value") * 1000)
    return rounded(vox.crop_wide(rows, shapes(spark, sf_dir), 0.5, 4.5, 3.0, 1.0))


def v7_smooth_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox.smooth_mask(masks(spark, sf_dir)[1], shapes(spark, sf_dir), 1.0)


def v8_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox.surface(masks(spark, sf_dir)[1])


def v9_close_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox.close_holes(masks(spark, sf_dir)[0], shapes(spark, sf_dir))


def v10_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vox.distance_transform(masks(spark, sf_dir)[1], shapes(spark, sf_dir)))


def v11_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox.components(masks(spark, sf_dir)[2]).select(*vox.KEY, root())


def a8_component_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.component_metrics(vox.components(masks(spark, sf_dir)[2], 6)))


def v12_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of components in order, and whether they are large enough to stay."""
    rows = vox.component_sizes(vox.components(masks(spark, sf_dir)[2]))
    return rows.select("case_id", root(), "size", "place", (F.col("size") >= 3).alias("stays"))


def t7_pooled_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 4 voxels or more in order, all smaller ones of a case as one row."""
    return vox.pooled_sizes(vox.components(masks(spark, sf_dir)[2]), 4).select("case_id", root(), "size", "place", "n_components")


def v13_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox.protected(vox.component_sizes(vox.components(masks(spark, sf_dir)[2]))).select("case_id", root(), "size")


def v14_keep_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vox.components(masks(spark, sf_dir)[2])
    safe = vox.component_sizes(rows).filter("place = 1")
    return vox.keep_near(rows, safe, 1.2).select(*vox.KEY, root())


def v15_elongation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed-form eigenvalues: their ratio is checked in tests, here the covariance of each component's places."""
    rows = vox.components(masks(spark, sf_dir)[2])
    cov = rows.groupBy("case_id", "component").agg(F.count("*").alias("size"), F.covar_samp("a0", "a0").alias("c00"), F.covar_samp("a0", "a1").alias("c01"), F.covar_samp("a1", "a2").alias("c12"))
    return rounded(cov.filter("size >= 3").select("case_id", root(), "size", "c00", "c01", "c12"))


def v16_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse mask with a tube from each component near the largest one to it."""
    rows = vox.components(masks(spark, sf_dir)[2])
    return vox.bridge(rows, vox.component_sizes(rows).filter("place = 1"), shapes(spark, sf_dir), 1.2, 0.5)


#: Limits for small volumes: the default steps, and one that closes and bridges first, and one whose floor stops most cases.
SMALL = vox.Cleanup(least_size=4, near_mm=1.2, floor=20)
CLEANUPS = {"default": SMALL, "bridged": vox.Cleanup(least_size=4, closing=1, bridging_mm=1.2, bridge_radius_mm=0.5, near_mm=0.8, floor=20, trees=1), "floored": vox.Cleanup(least_size=3, near_mm=0.6, floor=90)}


def v18_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 13 metrics of the sparse mask's clean-up, by three configurations."""
    sparse, wide = written(masks(spark, sf_dir)[2], "sparse"), written(shapes(spark, sf_dir), "shapes")
    out = None
    for name, config in CLEANUPS.items():
        rows = vox.cleanup(sparse, wide, config)[1].withColumn("config", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def v19_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox.stamp(masks(spark, sf_dir)[2], 2, shapes(spark, sf_dir)).groupBy("case_id").agg(F.count("*").alias("n"), F.sum("a0").alias("s0"), F.sum("a1").alias("s1"), F.sum("a2").alias("s2"))


def g15_line_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line from each voxel of the prediction to the next one along axis 1."""
    rows = masks(spark, sf_dir)[0]
    lines = rows.select("case_id", (F.col("a0") * 64 + F.col("a1") * 8 + F.col("a2")).alias("line_id"), *(F.col(a).alias(f"s{k}") for k, a in enumerate(vox.AXES)), F.col("a0").alias("e0"), (F.col("a1") + 1).alias("e1"), F.col("a2").alias("e2"))
    return vox.line_inside(lines, masks(spark, sf_dir)[0])


def v22_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 16 slices every 8: each tile's score of a voxel is its value scaled by the tile, weighted by the distance from the tile's ends."""
    starts = shapes(spark, sf_dir).select("case_id", F.explode(vox.tile_starts(F.col("n0"), 16, 8)).alias("start"))
    rows = voxels(spark, sf_dir).join(starts, "case_id").filter("a0 between start and start + 15")
    tiles = rows.select(*vox.KEY, (F.col("value") * (1 + F.col("start") / 100)).alias("score"), (1 + F.least(F.col("a0") - F.col("start"), F.col("start") + 15 - F.col("a0"))).alias("weight"))
    return rounded(vox.stitch(tiles))


def v23_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, truth, _ = masks(spark, sf_dir)
    return vox.overlay(pred, truth)


def a1_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.overlap(v23_overlay(spark, sf_dir)))


def a3_surface_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2-A5"""
    pred, truth, _ = masks(spark, sf_dir)
    return rounded(metrics.surface_metrics(metrics.surface_distances(pred, truth), (0.5, 1.0)))


def a6_radius_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, truth, sparse = masks(spark, sf_dir)
    return rounded(metrics.radius_error(pred, truth, sparse, shapes(spark, sf_dir)))


def u1_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, difference and intersection of masks, counted by case."""
    pred, truth, _ = masks(spark, sf_dir)
    count = lambda df, n: df.groupBy("case_id").agg(F.count("*").alias(n))
    rows = count(pred.union(truth).distinct(), "n_union").join(count(pred.join(truth, vox.KEY, "left_anti"), "n_only"), "case_id", "left")
    rows = rows.join(count(pred.intersect(truth), "n_both"), "case_id", "left").join(count(truth.exceptAll(pred), "n_missed"), "case_id", "left")
    return rows.fillna(0)


def w2_long_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8's smoothing: sigma 2 over the 8 points of each line along axis 2, so that the kernel is as long as the line."""
    rows = voxels(spark, sf_dir).withColumnRenamed("a2", "idx")
    return rounded(profile.smooth(rows, "value", "r", 2.0, ["case_id", "a0", "a1"]).select("case_id", "a0", "a1", "idx", "r"))


def v19_tapered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tube from narrow to wide along each segment's points, the grid's ends cutting it."""
    rows = points(spark, sf_dir)
    paths = rows.select("case_id", F.col("seg_id").alias("gap_id"), "idx", F.col("idx").cast("int").alias("a0"), (F.col("seg_id") % 8).cast("int").alias("a1"), F.lit(3).alias("a2"))
    ends = rows.select(F.col("seg_id").alias("gap_id")).distinct().select("gap_id", (F.col("gap_id") % 6).cast("double").alias("radius_a"), (F.col("gap_id") % 4 + 0.5).alias("radius_b"))
    tubes = vox.stamp(vox.tapered(paths, ends), F.col("radius"), shapes(spark, sf_dir), ("gap_id",))
    return tubes.groupBy("gap_id").agg(F.count("*").alias("n"), F.sum("a0").alias("s0"), F.sum("a1").alias("s1"), F.sum("a2").alias("s2"))


QUERIES = {f.__name__: f for f in (
    p3_window_and_presets, p4_zscore, p5_binarize, p6_reorient, p7_millimetres, v1_slice, v2_boxes, v4_resample, v5_sample_points, v6_nearest_value, v3_crop_wide, v7_blur, v7_smooth_mask, v8_surface, v9_close_holes, v10_distance, v11_components, v12_sizes, t7_pooled_sizes, v13_protected,
    v14_keep_near, v15_elongation, v16_bridge, v18_cleanup, v19_stamp, v19_tapered, g15_line_inside, v22_stitch, v23_overlay, a1_overlap, a3_surface_metrics, a6_radius_error, a8_component_metrics, u1_set_operations, w2_long_kernel,
)}
WEIGHTS = {s: ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in enumerate(profile.gaussian_weights(s), -len(profile.gaussian_weights(s)) // 2 + 1)) for s in (0.5, 1.0, 2.0)}
CLIP = "round(sum(greatest(least(value * 10, {1}), {0})), 4)"


def mirror(i: str, n: str) -> str:
    at = f"((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"(CASE WHEN {at} < {n} THEN {at} ELSE 2 * {n} - 1 - {at} END)"


def blur_step(axis: int, source: str, out: str, taps: str = "taps") -> str:
    places = ", ".join(f"o.a{k}" for k in range(3))
    join = " AND ".join(f"v.a{k} = " + (mirror(f"o.a{k} + k", f"n{k}") if k == axis else f"o.a{k}") for k in range(3))
    return f"{out} AS (SELECT o.case_id, {places}, sum(w * v.value) AS value FROM {source} o JOIN shapes USING (case_id) CROSS JOIN {taps} JOIN {source} v ON v.case_id = o.case_id AND {join} GROUP BY ALL)"


def lerp(points: str) -> str:
    """Trilinear sums at points(case_id, id columns g, p0, p1, p2), places held in the grid."""
    low = ", ".join(f"floor(greatest(0, least(p{k}, n{k} - 1)))::BIGINT AS l{k}, greatest(0, least(p{k}, n{k} - 1)) - floor(greatest(0, least(p{k}, n{k} - 1))) AS f{k}" for k in range(3))
    weight = " * ".join(f"CASE WHEN d{k} = 1 THEN f{k} ELSE 1 - f{k} END" for k in range(3))
    at = " AND ".join(f"v.a{k} = least(l{k} + d{k}, n{k} - 1)" for k in range(3))
    return f"""low AS (SELECT p.*, n0, n1, n2, {low} FROM ({points}) p JOIN shapes USING (case_id)), bits AS (SELECT i // 4 AS d0, i // 2 % 2 AS d1, i % 2 AS d2 FROM range(8) t(i)),
lerped AS (SELECT low.case_id, g, sum(({weight}) * v.value) AS value FROM low CROSS JOIN bits JOIN voxels v ON v.case_id = low.case_id AND {at} GROUP BY low.case_id, g)"""


V, M = VOXELS, MASKS
DIST = f"""bg AS (SELECT {KEY} FROM voxels ANTI JOIN truth USING (case_id, a0, a1, a2)), dt AS (SELECT t.case_id, t.a0, t.a1, t.a2, min(sqrt((b.a0 - t.a0)^2 + (b.a1 - t.a1)^2 + (b.a2 - t.a2)^2)) AS distance FROM truth t JOIN bg b USING (case_id) GROUP BY ALL),
bgp AS (SELECT {KEY} FROM voxels ANTI JOIN pred USING (case_id, a0, a1, a2)), dp AS (SELECT t.case_id, t.a0, t.a1, t.a2, min(sqrt((b.a0 - t.a0)^2 + (b.a1 - t.a1)^2 + (b.a2 - t.a2)^2)) AS distance FROM pred t JOIN bgp b USING (case_id) GROUP BY ALL)"""
RECURSIVE = lambda k, select: with_ctes(V, M, labelled(k), select=select).replace("WITH ", "WITH RECURSIVE ", 1)


def labels_sql(mask: str, name: str) -> list[str]:
    """Components of a mask over 26 neighbours, with their sizes, those protected, as CTEs that begin with name."""
    near = "abs(s.a0 - r.a0) <= 1 AND abs(s.a1 - r.a1) <= 1 AND abs(s.a2 - r.a2) <= 1"
    return [
        f"{name}_reach AS (SELECT {KEY}, a0 * 64 + a1 * 8 + a2 AS root FROM {mask} UNION SELECT s.case_id, s.a0, s.a1, s.a2, r.root FROM {name}_reach r JOIN {mask} s ON s.case_id = r.case_id AND {near})",
        f"{name} AS (SELECT {KEY}, min(root) AS root FROM {name}_reach GROUP BY ALL)",
    ]


def safe_sql(labels: str, name: str, c: vox.Cleanup) -> str:
    return f"""{name} AS (SELECT case_id, root FROM (SELECT case_id, root, count(*) AS n, sum(count(*)) OVER (PARTITION BY case_id) AS whole, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, root) AS place FROM {labels} GROUP BY case_id, root)
  WHERE place <= {c.trees} AND n >= greatest(1, floor(whole * {c.share}::DOUBLE)))"""


def near_sql(labels: str, safe: str, reach: float) -> str:
    """Pairs of a component's voxel that is not safe and a safe one within reach voxels."""
    return f"""SELECT x.case_id, x.root, sqrt((x.a0 - y.a0)^2 + (x.a1 - y.a1)^2 + (x.a2 - y.a2)^2) AS d, x.a0 AS s0, x.a1 AS s1, x.a2 AS s2, y.a0 AS e0, y.a1 AS e1, y.a2 AS e2 FROM {labels} x ANTI JOIN {safe} USING (case_id, root)
  JOIN (SELECT * FROM {labels} SEMI JOIN {safe} USING (case_id, root)) y ON y.case_id = x.case_id AND (x.a0 - y.a0)^2 + (x.a1 - y.a1)^2 + (x.a2 - y.a2)^2 <= {reach}::DOUBLE ^ 2 + 1e-9"""


def cleaned_sql(mask: str, c: vox.Cleanup, p: str) -> list[str]:
    """CTEs of a clean-up with closing once or not at all, bridges or none, and the distance filter; {p}clean is its mask, labelled."""
    out = []
    if c.closing:
        out += [
            f"{p}grown AS (SELECT {KEY} FROM {mask} UNION SELECT case_id, a0 + d0, a1 + d1, a2 + d2 FROM {mask} CROSS JOIN faces JOIN shapes USING (case_id) WHERE a0 + d0 BETWEEN 0 AND n0 - 1 AND a1 + d1 BETWEEN 0 AND 7 AND a2 + d2 BETWEEN 0 AND 7)",
            f"{p}shut AS (SELECT {KEY} FROM {count_faces(p + 'grown')} WHERE n = 6)",
            f"{p}bad AS (SELECT case_id FROM (SELECT case_id, count(*) AS n FROM {mask} GROUP BY 1) JOIN (SELECT case_id, count(*) AS m FROM {p}shut GROUP BY 1) USING (case_id) WHERE m > 2 * n)",
            f"{p}closed AS (SELECT {KEY} FROM {p}shut WHERE case_id NOT IN (SELECT case_id FROM {p}bad) UNION ALL SELECT {KEY} FROM {mask} WHERE case_id IN (SELECT case_id FROM {p}bad))",
        ]
    else:
        out.append(f"{p}closed AS (SELECT {KEY} FROM {mask})")
    stays = lambda labels, goes, rest: [f"{goes} AS (SELECT * FROM {labels} WHERE case_id IN (SELECT case_id FROM {labels} GROUP BY case_id HAVING count(*) >= {c.floor}))", f"{rest} AS (SELECT * FROM {labels} ANTI JOIN (SELECT DISTINCT case_id FROM {goes}) USING (case_id))"]
    big = lambda labels: f"SELECT * FROM {labels} SEMI JOIN (SELECT case_id, root FROM {labels} GROUP BY ALL HAVING count(*) >= {c.least_size}) USING (case_id, root)"
    out += [*labels_sql(mask, p + "l0"), *labels_sql(p + "closed", p + "l1"), f"{p}k1 AS ({big(p + 'l1')})", *stays(p + "k1", p + "g1", p + "stop1")]
    if c.bridging_mm:
        out += [
            safe_sql(p + "g1", p + "safe1", c), f"{p}gaps AS ({near_sql(p + 'g1', p + 'safe1', c.bridging_mm / c.spacing)} QUALIFY row_number() OVER (PARTITION BY x.case_id, x.root ORDER BY d, s0, s1, s2, e0, e1, e2) = 1)",
            f"{p}line AS (SELECT case_id, " + ", ".join(f"round_even(s{k} + i / ceil(d) * (e{k} - s{k}), 0)::BIGINT AS a{k}" for k in range(3)) + f" FROM {p}gaps, LATERAL (SELECT unnest(range(ceil(d)::BIGINT + 1)) AS i))",
            f"{p}joined AS (SELECT {KEY} FROM {p}g1 UNION SELECT {KEY} FROM {p}line UNION SELECT case_id, a0 + d0, a1 + d1, a2 + d2 FROM {p}line CROSS JOIN faces JOIN shapes USING (case_id) WHERE a0 + d0 BETWEEN 0 AND n0 - 1 AND a1 + d1 BETWEEN 0 AND 7 AND a2 + d2 BETWEEN 0 AND 7)",
            *labels_sql(p + "joined", p + "l2"),
        ]
    else:
        out.append(f"{p}l2 AS (SELECT * FROM {p}g1)")
    out += [
        safe_sql(p + "l2", p + "safe2", c), f"{p}k2 AS (SELECT * FROM {p}l2 SEMI JOIN (SELECT case_id, root FROM {p}safe2 UNION SELECT case_id, root FROM ({near_sql(p + 'l2', p + 'safe2', c.near_mm / c.spacing)})) USING (case_id, root))",
        *stays(p + "k2", p + "g2", p + "stop2"), f"{p}clean AS ({big(p + 'g2')} UNION ALL SELECT * FROM {p}stop1 UNION ALL SELECT * FROM {p}stop2)",
    ]
    return out


def cleanup_metrics_sql(name: str, c: vox.Cleanup) -> str:
    p = name[0] + "_"
    n = lambda t, what="*": f"(SELECT case_id, count({what}) AS n FROM {t} GROUP BY case_id)"
    metrics = {
        "input_voxels": n("sparse"), "input_components": n(p + "l0", "DISTINCT root"), "voxels_after_closing": n(p + "closed"), "voxels_after_smoothing": n(p + "closed"), "components_after_initial_removal": n(p + "k1", "DISTINCT root"),
        "voxels_after_initial_removal": n(p + "k1"), "bridges_added": n(p + "gaps") if c.bridging_mm else None, "voxels_after_bridging": n(p + "l2"), "components_removed_shape": None,
        "components_removed_distance": f"(SELECT case_id, count(DISTINCT root) AS n FROM {p}l2 ANTI JOIN {p}k2 USING (case_id, root) GROUP BY case_id)", "cycles_broken": None, "output_voxels": n(p + "clean"), "output_components": n(p + "clean", "DISTINCT root"),
    }
    columns = ", ".join(f"coalesce({m}.n, 0) AS {m}" if sql else f"0 AS {m}" for m, sql in metrics.items())
    return f"SELECT shapes.case_id, '{name}' AS config, {columns} FROM shapes " + " ".join(f"LEFT JOIN {sql} {m} ON {m}.case_id = shapes.case_id" for m, sql in metrics.items() if sql)


ORACLES = {
    "v18_cleanup": with_ctes(V, M, SHAPES, FACES, *(x for name, c in CLEANUPS.items() for x in cleaned_sql("sparse", c, name[0] + "_")), select=" UNION ALL ".join(cleanup_metrics_sql(n, c) for n, c in CLEANUPS.items())).replace("WITH ", "WITH RECURSIVE ", 1),
    "p3_window_and_presets": with_ctes(V, select=f"SELECT case_id, {CLIP.format(-0.5, 0.7)} AS \"window\", {CLIP.format(-3, 3)} AS \"default\", {CLIP.format(-1, 2)} AS vessel_enhancement, {CLIP.format(-2, 1)} AS soft_tissue FROM voxels GROUP BY case_id"),
    "p4_zscore": with_ctes(V, select=f"SELECT {KEY}, round(greatest(-2, least(2, (value - m) / s)), 6) AS z FROM voxels JOIN (SELECT case_id, avg(value) AS m, greatest(stddev_pop(value), 1e-6) AS s FROM voxels GROUP BY case_id) USING (case_id)"),
    "p5_binarize": with_ctes(V, M, select="SELECT case_id, n_pred, n_truth, n_sparse FROM (SELECT case_id, count(*) AS n_pred FROM pred GROUP BY case_id) FULL JOIN (SELECT case_id, count(*) AS n_truth FROM truth GROUP BY case_id) USING (case_id) FULL JOIN (SELECT case_id, count(*) AS n_sparse FROM sparse GROUP BY case_id) USING (case_id)"),
    "p6_reorient": with_ctes(V, SHAPES, select="SELECT case_id, CASE WHEN case_id % 2 = 0 THEN 7 - a2 ELSE a2 END AS a0, n0 - 1 - a0 AS a1, a1 AS a2, round(value, 6) AS value FROM voxels JOIN shapes USING (case_id)"),
    "p7_millimetres": with_ctes(V, select=f"SELECT {KEY}, " + ", ".join(f"round(a{k} * 0.7::DOUBLE, 6) AS mm{k}, round_even((a{k} * 0.7::DOUBLE + 0.35::DOUBLE) / 0.7::DOUBLE, 0)::INT AS back{k}" for k in range(3)) + " FROM voxels"),
    "v1_slice": with_ctes(V, SHAPES, select=f"SELECT {KEY}, round(value, 6) AS value FROM voxels JOIN shapes USING (case_id) WHERE a0 = least(47, n0 - 1)"),
    "v2_boxes": with_ctes(V, SHAPES, select="SELECT case_id, box_id, count(*) AS n, round(sum(value), 6) AS total FROM voxels JOIN shapes USING (case_id), LATERAL (SELECT unnest(range((n0 - 1) // 10 + 1)) AS box_id) WHERE a0 BETWEEN box_id * 10 AND box_id * 10 + 12 AND a1 BETWEEN 2 AND 5 AND a2 BETWEEN box_id % 3 AND 6 GROUP BY ALL"),
    "v4_resample": with_ctes(V, SHAPES, "grid AS (SELECT *, round_even(n0 * 0.625::DOUBLE, 0)::BIGINT AS m0, 10 AS m1, 8 AS m2 FROM shapes)", lerp("SELECT case_id, {'x': i, 'y': j, 'z': k} AS g, (i + 0.5::DOUBLE) * (n0 / m0::DOUBLE) - 0.5 AS p0, (j + 0.5::DOUBLE) * (n1 / m1::DOUBLE) - 0.5 AS p1, (k + 0.5::DOUBLE) * (n2 / m2::DOUBLE) - 0.5 AS p2 FROM grid, LATERAL (SELECT unnest(range(m0)) AS i), range(10) y(j), range(8) z(k)"), select="SELECT case_id, g.x AS a0, g.y AS a1, g.z AS a2, round(value, 6) AS value FROM lerped"),
    "v5_sample_points": with_ctes(V, SHAPES, lerp("SELECT case_id, a0 * 64 + a1 * 8 + a2 AS g, a0 + 0.3::DOUBLE AS p0, a1 - 0.4::DOUBLE AS p1, a2 + 0.55::DOUBLE AS p2 FROM voxels"), select="SELECT case_id, g AS point_id, round(value, 6) AS value FROM lerped"),
    "v6_nearest_value": with_ctes(V, select="SELECT p.case_id, p.a0 * 64 + p.a1 * 8 + p.a2 AS point_id, round(coalesce(v.value, 0), 6) AS value FROM voxels p LEFT JOIN voxels v ON v.case_id = p.case_id AND v.a0 = round_even(p.a0 + 0.5, 0) AND v.a1 = p.a1 + p.a2 AND v.a2 = p.a2"),
    "v7_blur": with_ctes(V, SHAPES, f"taps AS (SELECT * FROM (VALUES {WEIGHTS[1.0]}) t(k, w))", blur_step(0, "voxels", "x0"), blur_step(1, "x0", "x1"), blur_step(2, "x1", "x2"), select=f"SELECT {KEY}, round(value, 6) AS value FROM x2"),
    "v3_crop_wide": with_ctes(V, SHAPES, f"taps AS (SELECT * FROM (VALUES {WEIGHTS[1.0]}) t(k, w))", "plane AS (SELECT case_id, a0, a1, 0 AS a2, avg(greatest(100, least(700, value * 1000)) - 100) AS value FROM voxels JOIN shapes USING (case_id) WHERE greatest(n0, n1) * 0.5 > 4.5 AND a2 BETWEEN 3 AND 4 GROUP BY ALL)",
        blur_step(0, "plane", "x0"), blur_step(1, "x0", "x1"), "centre AS (SELECT case_id, arg_min(a0, (-value, a0, a1)) AS c0, arg_min(a1, (-value, a0, a1)) AS c1 FROM x1 GROUP BY case_id)",
        "win AS (SELECT case_id, greatest(0, least(c0 - 3, n0 - 6)) AS l0, greatest(0, least(c1 - 3, n1 - 6)) AS l1 FROM centre JOIN shapes USING (case_id))",
        select="SELECT case_id, a0 - coalesce(l0, 0) AS a0, a1 - coalesce(l1, 0) AS a1, a2, round(value * 1000, 6) AS value FROM voxels LEFT JOIN win USING (case_id) WHERE l0 IS NULL OR (a0 BETWEEN l0 AND l0 + 5 AND a1 BETWEEN l1 AND l1 + 5)"),
    "v7_smooth_mask": with_ctes(V, M, SHAPES, f"taps AS (SELECT * FROM (VALUES {WEIGHTS[1.0]}) t(k, w)), half AS (SELECT * FROM (VALUES {WEIGHTS[0.5]}) t(k, w))", f"flat AS (SELECT {KEY}, (t.case_id IS NOT NULL)::INT::DOUBLE AS value FROM voxels LEFT JOIN truth t USING (case_id, a0, a1, a2))".replace("t.case_id IS NOT NULL", "t.x IS NOT NULL").replace("LEFT JOIN truth t", "LEFT JOIN (SELECT *, 1 AS x FROM truth) t"),
        blur_step(0, "flat", "x0"), blur_step(1, "x0", "x1"), blur_step(2, "x1", "x2"), blur_step(0, "flat", "y0", "half"), blur_step(1, "y0", "y1", "half"), blur_step(2, "y1", "y2", "half"),
        "lost AS (SELECT case_id FROM (SELECT case_id, count(*) AS n FROM truth GROUP BY 1) LEFT JOIN (SELECT case_id, count(*) AS m FROM x2 WHERE value >= 0.5 GROUP BY 1) USING (case_id) WHERE coalesce(m, 0) < 0.8 * n)",
        select=f"SELECT {KEY} FROM x2 WHERE value >= 0.5 AND case_id NOT IN (FROM lost) UNION ALL SELECT {KEY} FROM y2 WHERE value >= 0.5 AND case_id IN (FROM lost)"),
    "v8_surface": with_ctes(V, M, FACES, select=f"SELECT {KEY} FROM {count_faces('truth')} WHERE n < 6"),
    "v9_close_holes": with_ctes(V, M, FACES, SHAPES, f"grown AS (SELECT {KEY} FROM pred UNION SELECT case_id, a0 + d0, a1 + d1, a2 + d2 FROM pred CROSS JOIN faces JOIN shapes USING (case_id) WHERE a0 + d0 BETWEEN 0 AND n0 - 1 AND a1 + d1 BETWEEN 0 AND 7 AND a2 + d2 BETWEEN 0 AND 7)",
        f"closed AS (SELECT {KEY} FROM {count_faces('grown')} WHERE n = 6)", "bad AS (SELECT case_id FROM (SELECT case_id, count(*) AS n FROM pred GROUP BY 1) JOIN (SELECT case_id, count(*) AS m FROM closed GROUP BY 1) USING (case_id) WHERE m > 2 * n)",
        select=f"SELECT {KEY} FROM closed WHERE case_id NOT IN (SELECT case_id FROM bad) UNION ALL SELECT {KEY} FROM pred WHERE case_id IN (SELECT case_id FROM bad)"),
    "v10_distance": with_ctes(V, M, DIST, select=f"SELECT {KEY}, round(distance, 6) AS distance FROM dt"),
    "v11_components": RECURSIVE(26, f"SELECT {KEY}, root FROM labelled"),
    "v12_sizes": RECURSIVE(26, "SELECT case_id, root, size, place::INT AS place, size >= 3 AS stays FROM sizes"),
    "t7_pooled_sizes": RECURSIVE(26, "SELECT case_id, root, size, place::INT AS place, 1 AS n_components FROM sizes WHERE size >= 4 UNION ALL SELECT case_id, NULL, sum(size)::BIGINT, NULL, count(*) FROM sizes WHERE size < 4 GROUP BY case_id"),
    "v13_protected": RECURSIVE(26, "SELECT case_id, root, size FROM (SELECT *, sum(size) OVER (PARTITION BY case_id) AS total FROM sizes) WHERE place <= 3 AND size >= greatest(1, floor(total * 0.05))"),
    "v14_keep_near": RECURSIVE(26, f"""SELECT {KEY}, root FROM labelled WHERE (case_id, root) IN (SELECT (case_id, root) FROM sizes WHERE place = 1
  UNION ALL SELECT (x.case_id, x.root) FROM labelled x JOIN labelled y ON x.case_id = y.case_id JOIN sizes s ON s.case_id = y.case_id AND s.root = y.root AND s.place = 1 WHERE sqrt((x.a0 - y.a0)^2 + (x.a1 - y.a1)^2 + (x.a2 - y.a2)^2) <= 1.2 / 0.5)"""),
    "v15_elongation": RECURSIVE(26, "SELECT case_id, root, count(*) AS size, round(covar_samp(a0, a0), 6) AS c00, round(covar_samp(a0, a1), 6) AS c01, round(covar_samp(a1, a2), 6) AS c12 FROM labelled GROUP BY ALL HAVING count(*) >= 3"),
    "v16_bridge": with_ctes(V, M, SHAPES, FACES, labelled(26), """gaps AS (SELECT * FROM (SELECT x.case_id, x.root, sqrt((x.a0 - y.a0)^2 + (x.a1 - y.a1)^2 + (x.a2 - y.a2)^2) AS d, x.a0 AS s0, x.a1 AS s1, x.a2 AS s2, y.a0 AS e0, y.a1 AS e1, y.a2 AS e2
    FROM labelled x JOIN sizes p ON p.case_id = x.case_id AND p.root = x.root AND p.place > 1 JOIN sizes q ON q.case_id = x.case_id AND q.place = 1 JOIN labelled y ON y.case_id = x.case_id AND y.root = q.root) WHERE d <= 1.2 / 0.5
    QUALIFY row_number() OVER (PARTITION BY case_id, root ORDER BY d, s0, s1, s2, e0, e1, e2) = 1)""",
        "line AS (SELECT case_id, " + ", ".join(f"round_even(s{k} + i / ceil(d) * (e{k} - s{k}), 0)::BIGINT AS a{k}" for k in range(3)) + " FROM gaps, LATERAL (SELECT unnest(range(ceil(d)::BIGINT + 1)) AS i))",
        select=f"SELECT {KEY} FROM labelled UNION SELECT {KEY} FROM line UNION SELECT case_id, a0 + d0, a1 + d1, a2 + d2 FROM line CROSS JOIN faces JOIN shapes USING (case_id) WHERE a0 + d0 BETWEEN 0 AND n0 - 1 AND a1 + d1 BETWEEN 0 AND 7 AND a2 + d2 BETWEEN 0 AND 7").replace("WITH ", "WITH RECURSIVE ", 1),
    "v19_tapered": with_ctes(V, SHAPES, POINTS, "wide AS (SELECT case_id, seg_id, idx, n, greatest(1, round_even(greatest(1.5, 0.7 * (seg_id % 6)) * (1 - idx / m) + greatest(1.5, 0.7 * (seg_id % 4 + 0.5::DOUBLE)) * (idx / m), 0))::BIGINT AS r FROM (SELECT *, greatest(1, max(idx) OVER (PARTITION BY seg_id))::DOUBLE AS m, 0 AS n FROM points))",
        select="""SELECT gap_id, count(*) AS n, sum(x)::BIGINT AS s0, sum(y)::BIGINT AS s1, sum(z)::BIGINT AS s2 FROM (SELECT DISTINCT seg_id AS gap_id, idx + i AS x, seg_id % 8 + j AS y, 3 + k AS z FROM wide JOIN shapes USING (case_id), range(-4, 5) p(i), range(-4, 5) q(j), range(-4, 5) o(k)
  WHERE i * i + j * j + k * k <= r * r AND idx + i BETWEEN 0 AND n0 - 1 AND seg_id % 8 + j BETWEEN 0 AND 7 AND 3 + k BETWEEN 0 AND 7) GROUP BY gap_id"""),
    "v19_stamp": with_ctes(V, M, SHAPES, select="""SELECT case_id, count(*) AS n, sum(x)::BIGINT AS s0, sum(y)::BIGINT AS s1, sum(z)::BIGINT AS s2 FROM (SELECT DISTINCT case_id, a0 + i AS x, a1 + j AS y, a2 + k AS z FROM sparse JOIN shapes USING (case_id), range(-2, 3) p(i), range(-2, 3) q(j), range(-2, 3) r(k)
  WHERE i * i + j * j + k * k <= 4 AND a0 + i BETWEEN 0 AND n0 - 1 AND a1 + j BETWEEN 0 AND 7 AND a2 + k BETWEEN 0 AND 7) GROUP BY case_id"""),
    "g15_line_inside": with_ctes(V, M, select="SELECT p.case_id, p.a0 * 64 + p.a1 * 8 + p.a2 AS line_id, q.case_id IS NOT NULL AS clear FROM pred p LEFT JOIN pred q ON q.case_id = p.case_id AND q.a0 = p.a0 AND q.a1 = p.a1 + 1 AND q.a2 = p.a2"),
    "v22_stitch": with_ctes(V, SHAPES, "starts AS (SELECT case_id, unnest(list_distinct(list_append(list_filter(range(0, greatest(n0 - 16, 0) + 1, 8), lambda x: x < greatest(n0 - 16, 0)), greatest(n0 - 16, 0)))) AS start FROM shapes)",
        select=f"SELECT {KEY}, round(1 / (1 + exp(-sum(value * (1 + start / 100.0::DOUBLE) * (1 + least(a0 - start, start + 15 - a0))) / sum(1 + least(a0 - start, start + 15 - a0)))), 6) AS p FROM voxels JOIN starts USING (case_id) WHERE a0 BETWEEN start AND start + 15 GROUP BY ALL"),
    "v23_overlay": with_ctes(V, M, select=f"SELECT case_id, count(p) AS n_pred, count(t) AS n_truth, count(*) FILTER (p AND t) AS n_both FROM (SELECT {KEY}, true AS p FROM pred) FULL JOIN (SELECT {KEY}, true AS t FROM truth) USING (case_id, a0, a1, a2) GROUP BY case_id"),
    "a1_overlap": with_ctes(V, M, f"o AS (SELECT case_id, count(p)::DOUBLE AS n_pred, count(t)::DOUBLE AS n_truth, count(*) FILTER (p AND t)::DOUBLE AS n_both FROM (SELECT {KEY}, true AS p FROM pred) FULL JOIN (SELECT {KEY}, true AS t FROM truth) USING (case_id, a0, a1, a2) GROUP BY case_id)",
        select="SELECT case_id, round(2 * n_both / (n_pred + n_truth), 6) AS dice, round(n_both / (n_pred + n_truth - n_both), 6) AS iou, round(n_both / n_pred, 6) AS precision, round(n_both / n_truth, 6) AS recall FROM o"),
    "a3_surface_metrics": with_ctes(V, M, FACES, SURFACES, select="""SELECT case_id, round(quantile_cont(d, 0.95), 6) AS hd95, round((avg(d) FILTER (side = 'p') + avg(d) FILTER (side = 't')) / 2, 6) AS asd,
  round(avg((d <= 0.5)::INT), 6) AS surface_dice_0_5, round(avg((d <= 1.0)::INT), 6) AS surface_dice_1_0 FROM dist GROUP BY case_id"""),
    "a6_radius_error": with_ctes(V, M, DIST, select="SELECT case_id, round(avg(abs(coalesce(dp.distance, 0) - dt.distance)) * 0.5, 6) AS mare, round(avg(coalesce(dp.distance, 0) - dt.distance) * 0.5, 6) AS msre, count(*) AS n_samples FROM sparse JOIN dt USING (case_id, a0, a1, a2) LEFT JOIN dp USING (case_id, a0, a1, a2) GROUP BY case_id"),
    "a8_component_metrics": RECURSIVE(6, "SELECT case_id, count(*) AS n_components, max(size) AS largest, sum(size)::BIGINT AS total, round(max(size) / sum(size), 6) AS largest_fraction FROM sizes GROUP BY case_id"),
    "u1_set_operations": with_ctes(V, M, select=f"""SELECT case_id, n_union, coalesce(n_only, 0) AS n_only, coalesce(n_both, 0) AS n_both, coalesce(n_missed, 0) AS n_missed FROM (SELECT case_id, count(*) AS n_union FROM (SELECT * FROM pred UNION SELECT * FROM truth) GROUP BY 1)
  LEFT JOIN (SELECT case_id, count(*) AS n_only FROM (SELECT * FROM pred EXCEPT SELECT * FROM truth) GROUP BY 1) USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n_both FROM (SELECT * FROM pred INTERSECT SELECT * FROM truth) GROUP BY 1) USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS n_missed FROM (SELECT * FROM truth EXCEPT SELECT * FROM pred) GROUP BY 1) USING (case_id)"""),
    "w2_long_kernel": with_ctes(V, f"taps AS (SELECT * FROM (VALUES {WEIGHTS[2.0]}) t(k, w))", select=f"SELECT o.case_id, o.a0, o.a1, o.a2 AS idx, round(sum(w * v.value), 6) AS r FROM voxels o CROSS JOIN taps JOIN voxels v ON v.case_id = o.case_id AND v.a0 = o.a0 AND v.a1 = o.a1 AND v.a2 = {mirror('o.a2 + k', '8')} GROUP BY ALL"),
}
