"""Queries of gap and whole-case operators (V21, G14, G17, G23-G26, G29-G30, A25, A28-A29) on the stand-in volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import arteries, gaps, graph
from ..operators import voxels as vox
from ..session import written
from .fixtures import MASKS, POINTS, VOXELS, masks, points, table, voxels, with_ctes
from .graph_plans import ORACLES as GRAPHS
from .graph_plans import PLACE, RECURSIVE, components, g21_tip_classes, g22_gap_pairs, tips
from .profile_plans import rounded
from .voxel_plans import FACES, SHAPES, SMALL, SURFACES, cleaned_sql, labelled, lerp, root, shapes


def v21_component_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.component_boxes(components(spark, sf_dir), 2).select("case_id", root(), *(f"{n}{k}" for k in range(3) for n in ("low", "high")))


def g23_midpoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midpoint pairs of the skeleton's fragments."""
    labels = components(spark, sf_dir).select("case_id", F.struct(*vox.KEY).alias("node"), "component")
    value = voxels(spark, sf_dir).select(F.struct(*vox.KEY).alias("node"), F.col("value").alias("radius_mm"))
    skeleton = labels.join(value, "node")
    ends = tips(spark, sf_dir).select("node", "radius_mm").join(labels, "node").withColumn("is_valid", F.col("radius_mm") > 0.3)
    found = gaps.midpoint_pairs(ends, skeleton, 3.0)
    return rounded(found.select("case_id", PLACE("a").alias("a"), PLACE("b").alias("b"), "distance_mm"))


def regions_of_gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A gap for every 8 slices of each case, across a block of 6 x 6 x 6 voxels."""
    starts = shapes(spark, sf_dir).select("case_id", F.explode(F.sequence(F.lit(0), F.col("n0") - 6, F.lit(8))).alias("low"))
    starts = starts.withColumn("gap_id", F.col("case_id") * 100_000 + F.col("low"))
    corner = lambda s: F.struct((F.col("low") + s).cast("int").alias("a0"), F.lit(s + 1).alias("a1"), F.lit(s + 1).alias("a2"))
    # a slice lies in one block or none, so a voxel meets its own block only and not all of its case
    rows = voxels(spark, sf_dir).filter("a0 % 8 <= 5 and a1 between 1 and 6 and a2 between 1 and 6").withColumn("low", (F.col("a0") - F.col("a0") % 8).cast("int"))
    roi = rows.join(starts, ["case_id", "low"])
    tube = (F.col("a1") + F.col("a2")) % 7 != 0
    roi = roi.select("gap_id", F.col("a0").cast("int").alias("a0"), "a1", "a2", (F.col("value") + 0.16).alias("p"), (F.col("value") > 0.25).alias("in_mask"), tube.alias("in_tube"))
    return starts.select("gap_id", corner(0).alias("a"), corner(5).alias("b"), (F.col("low") % 5 / 4).alias("radius_a"), F.lit(1.5).alias("radius_b")), roi


def g25_threshold_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends, roi = (written(rows) for rows in regions_of_gaps(spark, sf_dir))
    return rounded(gaps.judge_bridges(gaps.threshold_bridges(ends, roi), roi, ends))


def g26_bridge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends, roi = regions_of_gaps(spark, sf_dir)
    return rounded(gaps.bridge_costs(ends, roi).select("gap_id", *vox.AXES, "cost"))


def g26_cheapest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends, roi = regions_of_gaps(spark, sf_dir)
    return gaps.cheapest_paths(ends, gaps.bridge_costs(ends, roi))


def gaps_to_close(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """regions_of_gaps with ends of other widths, and a main model that sees less in some regions."""
    ends, roi = regions_of_gaps(spark, sf_dir)
    low = F.col("gap_id") % 100_000
    ends = ends.withColumns({"radius_a": (low % 5).cast("double"), "radius_b": 1 + low % 7 / 2})
    return ends, roi.withColumns({"p_main": F.when(low / 8 % 7 != 3, F.col("p") - low % 3 * 0.06), "p": F.col("p") - F.when(low / 8 % 5 == 4, 0.09).otherwise(0.0)})


def ways_given(ends: DataFrame) -> DataFrame:
    """Ways along the axes, the diagonal, and one that goes to and fro, by turns; every fourth gap has none."""
    kind = (F.col("gap_id") % 100_000 / 8 % 4).cast("int")
    steps = lambda *at: F.array(*(F.struct(*(F.lit(x).alias(f"s{k}") for k, x in enumerate(p))) for p in at))
    edge = [(k, 0, 0) for k in range(6)]
    rest = [(5, k, 0) for k in range(1, 6)] + [(5, 5, k) for k in range(1, 6)]
    way = F.when(kind == 0, steps(*edge, *rest)).when(kind == 1, steps(*((k, k, k) for k in range(6)))).when(kind == 2, steps(*edge, *edge[-2::-1], *edge[1:], *rest))
    rows = ends.select("gap_id", "a", F.posexplode(way).alias("idx", "s"))
    return rows.select("gap_id", "idx", *((F.col(f"a.a{k}") + F.col(f"s.s{k}")).alias(f"a{k}") for k in range(3)))


def told(details: DataFrame, new: DataFrame) -> DataFrame:
    """The details of gaps with sums over their new voxels."""
    sums = new.groupBy("gap_id").agg(F.sum(F.col("a0") * 64 + F.col("a1") * 8 + F.col("a2")).alias("places"))
    return rounded(details.join(sums, "gap_id", "left").withColumn("places", F.coalesce("places", F.lit(0).cast("long"))))


def g28_resegmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder of a gap, paths given."""
    ends, roi = gaps_to_close(spark, sf_dir)
    return told(*gaps.resegment(ends, roi, ways_given(ends), 0.16))


def g28_resegmented_by_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder of a gap, paths searched."""
    return told(*gaps.resegment(*gaps_to_close(spark, sf_dir), least_prob=0.18))


def g17_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks near the first and the last segment of each case."""
    rows = points(spark, sf_dir).withColumn("p2", (F.col("seg_id") % 5).cast("double"))
    clicks = rows.groupBy("case_id").agg(*(F.min(f"p{k}").alias(f"s{k}") for k in range(3)), *(F.max(f"p{k}").alias(f"e{k}") for k in range(3)))
    return gaps.highlight(rows, clicks, masks(spark, sf_dir)[0], 2)


def bridged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sparse mask with straight bridges over its gap pairs, and whether they connect."""
    ends = [F.struct(F.floor(F.col(e) / 64).cast("int").alias("a0"), F.floor(F.col(e) / 8 % 8).cast("int").alias("a1"), (F.col(e) % 8).cast("int").alias("a2")).alias(e) for e in ("a", "b")]
    pairs = written(g22_gap_pairs(spark, sf_dir).select("case_id", F.struct("a", "b").alias("gap_id"), *ends), "pairs")
    lines = pairs.select("case_id", F.col("gap_id").alias("line_id"), *(F.col(f"a.a{k}").alias(f"s{k}") for k in range(3)), *(F.col(f"b.a{k}").alias(f"e{k}") for k in range(3)))
    tubes = vox.line_points(lines).withColumnRenamed("line_id", "gap_id").distinct()
    return gaps.merge_bridges(masks(spark, sf_dir)[2], tubes, pairs, least_new=2, least_size=2, search=2)


def g29_merged_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridged(spark, sf_dir)[0]


def g29_verified_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridged(spark, sf_dir)[1]
    return rows.withColumn("gap_id", F.col("gap_id.a").cast("long") * 100_000 + F.col("gap_id.b"))


def g30_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G30 over G21's tips, G22's pairs and the masks; pairs nearer than 2 mm stand for connected ones."""
    ends = written(tips(spark, sf_dir), "tips")
    classes, pairs = g21_tip_classes(spark, sf_dir, ends), written(g22_gap_pairs(spark, sf_dir, ends), "pairs")
    before, after, _ = masks(spark, sf_dir)
    return gaps.refinement_summary(classes, pairs, pairs.select("case_id", (F.col("distance_mm") < 2).alias("connected")), before, after)


def g14_left_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left tree for every 40 customers, each a junction with the segment that leads to it; every eleventh segment lacks, but its line lies in the mask."""
    k, case = F.col("c_custkey") % 40, F.floor(F.col("c_custkey") / 40)
    rows = table(spark, sf_dir, "customer").select(case.cast("int").alias("case_id"), k.alias("node"), F.floor(k / 2).alias("start"), F.abs("c_acctbal").alias("x"))
    place = [F.when(F.col("node") == 0, 120.0).otherwise(100.0 - 4 * F.floor(F.log2(F.col("node") + 1.0))), (39 + F.col("node") * 7 % 23).cast("double"), (42 + F.col("node") * 5 % 17).cast("double")]
    rows = rows.withColumns({f"p{k}": p for k, p in enumerate(place)})
    junctions = rows.select("case_id", "node", "p0", "p1", "p2", (0.5 + F.col("node") % 7 / 5).alias("radius_mm"))
    from_node = rows.select("case_id", F.col("node").alias("start"), *(F.col(f"p{k}").alias(f"s{k}") for k in range(3)))
    ways = rows.filter("node > 0").join(from_node, ["case_id", "start"])
    lacks = F.col("node") % 11 == 0
    segments = ways.filter(~lacks).select("case_id", F.col("node").alias("seg_id"), "start", F.col("node").alias("end"), (F.col("x") / 400).alias("length_mm"), (0.5 + F.col("node") % 5 / 4).alias("radius_mm"), (F.lit(3) + F.col("node") % 13).alias("n_points"), (F.col("p1") + F.col("node") % 5 - 2).alias("mid1"))
    lines = ways.filter(lacks).select("case_id", F.col("node").alias("line_id"), *(F.col(f"s{k}").alias(f"s{k}") for k in range(3)), *(F.col(f"p{k}").alias(f"e{k}") for k in range(3)))
    wide = rows.select("case_id").distinct().select("case_id", *(F.lit(n).alias(f"n{k}") for k, n in enumerate((130, 100, 100))))
    return arteries.split_left(segments, junctions, vox.stamp(vox.line_points(lines), 1), wide)


def a28_findings_from_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction with the segments' own lines in it, as a centerline lies in its mask."""
    n = F.count("*").over(Window.partitionBy("case_id", "seg_id"))
    rows = points(spark, sf_dir).withColumns({"n": n, "p2": (F.col("seg_id") % 5).cast("double")})
    lines = vox.inside(rows.select("case_id", *(F.rint(f"p{k}").cast("int").alias(f"a{k}") for k in range(3))), shapes(spark, sf_dir))
    mask = masks(spark, sf_dir)[0].union(lines.select(vox.KEY)).distinct()
    return gaps.findings_from_mask(mask, shapes(spark, sf_dir), rows, SMALL).select("case_id", "seg_id", "artery_name", "severity", "location_idx")


def a29_case_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three masks: the truth resampled, the prediction thresholded, and that cleaned."""
    rows = voxels(spark, sf_dir)
    truth, pred, clean = gaps.case_masks(rows.withColumn("value", F.col("value") * 2), rows.withColumnRenamed("value", "p"), shapes(spark, sf_dir), (0.5, 0.5, 0.5), (0.8, 0.4, 0.5), 0.15, SMALL)
    return truth.withColumn("side", F.lit("truth")).unionByName(pred.withColumn("side", F.lit("pred"))).unionByName(clean.withColumn("side", F.lit("clean")))


def a25_evaluate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thresholds as two models."""
    rows = voxels(spark, sf_dir)
    cut = lambda m, t: rows.filter(F.col("value") > t).select(F.lit(m).alias("model"), *vox.KEY)
    return rounded(gaps.evaluate_models(cut("low", 0.12).union(cut("high", 0.18)), masks(spark, sf_dir)[1], shapes(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (v21_component_boxes, g23_midpoint_pairs, g25_threshold_bridges, g26_bridge_costs, g26_cheapest_paths, g28_resegmented, g28_resegmented_by_search, g14_left_split, g17_highlight, g29_merged_bridges, g29_verified_gaps, g30_refinement, a25_evaluate_models, a28_findings_from_mask, a29_case_masks)}
ROI = """starts AS (SELECT case_id, unnest(range(0, n0 - 5, 8)) AS low FROM shapes),
gaps AS (SELECT case_id * 100000 + low AS gap_id, low, low % 5 / 4.0::DOUBLE AS radius_a FROM starts),
roi AS (SELECT case_id * 100000 + low AS gap_id, low, a0, a1, a2, value + 0.16::DOUBLE AS p, value > 0.25 AS in_mask, (a1 + a2) % 7 <> 0 AS in_tube FROM voxels JOIN starts USING (case_id) WHERE a0 BETWEEN low AND low + 5 AND a1 BETWEEN 1 AND 6 AND a2 BETWEEN 1 AND 6)"""
#: The ladder of a gap over `gaps`, `roi` and the ways given.
LADDER = [
    VOXELS, SHAPES, ROI.replace("AS gap_id, low, low % 5 / 4.0::DOUBLE AS radius_a", "AS gap_id, low, greatest(1, low % 5)::DOUBLE AS ra, greatest(1, 1 + low % 7 / 2.0::DOUBLE) AS rb").replace("value + 0.16::DOUBLE AS p,", "value + 0.16::DOUBLE AS p0,").replace("roi AS (", "raw AS ("),
    "roi AS (SELECT *, CASE WHEN low // 8 % 7 <> 3 THEN p0 - low % 3 * 0.06::DOUBLE END AS p_main, p0 - CASE WHEN low // 8 % 5 = 4 THEN 0.09::DOUBLE ELSE 0 END AS p FROM raw)",
    "means AS (SELECT gap_id, avg(p_main) AS tube, avg(p) AS joint FROM roi WHERE in_tube GROUP BY gap_id)",
    "tried AS (SELECT g.*, tube, joint, CASE WHEN tube IS NULL THEN 'unknown' WHEN tube < 0.03 THEN 'none' WHEN tube < 0.08 THEN 'low_signal' ELSE 'normal' END AS tier, CASE WHEN tube < 0.08 THEN 0.8::DOUBLE ELSE 0.16::DOUBLE END AS needs, CASE WHEN tube < 0.03 THEN 'skip' WHEN joint >= 0.15 THEN 'threshold' WHEN joint >= 0.1 THEN 'path' ELSE 'low_signal' END AS action FROM gaps g LEFT JOIN means USING (gap_id))",
    "tries AS (SELECT gap_id, t, low, a0, a1, a2 FROM roi JOIN (SELECT gap_id FROM tried WHERE action = 'threshold') USING (gap_id), (VALUES (0.2::DOUBLE), (0.15::DOUBLE), (0.1::DOUBLE)) x(t) WHERE in_mask OR (in_tube AND p > t))",
    "reach AS (SELECT * FROM tries WHERE a0 = low AND a1 = 1 AND a2 = 1 UNION SELECT s.* FROM reach r JOIN tries s ON s.gap_id = r.gap_id AND s.t = r.t AND abs(s.a0 - r.a0) + abs(s.a1 - r.a1) + abs(s.a2 - r.a2) = 1)",
    "found AS (SELECT gap_id, max(t) AS threshold FROM reach WHERE a0 = low + 5 AND a1 = 6 AND a2 = 6 GROUP BY gap_id)",
    "bridge AS (SELECT gap_id, threshold, a0, a1, a2, p, count(*) OVER (PARTITION BY gap_id) AS n, pi() * ((ra + rb) / 2)^2 * sqrt(75.0::DOUBLE) AS expected FROM roi JOIN found USING (gap_id) JOIN gaps USING (gap_id) WHERE in_tube AND NOT in_mask AND p > threshold)",
    "good AS (SELECT * FROM bridge WHERE n >= 10 AND NOT (n > 3 * expected AND n > 100))",
    "going AS (SELECT * FROM tried WHERE action = 'path' OR (action = 'threshold' AND gap_id NOT IN (SELECT gap_id FROM good)))",
    "sides AS (SELECT unnest(range(6)) AS i, i AS x, 0 AS y, 0 AS z, 0 AS part UNION ALL SELECT unnest(range(1, 6)) AS i, 5, i, 0, 1 UNION ALL SELECT unnest(range(1, 6)) AS i, 5, 5, i, 2)",
    "ways AS (SELECT 0 AS kind, part * 10 + i AS nr, x, y, z FROM sides UNION ALL SELECT 1, i, i, i, i FROM (SELECT unnest(range(6)) AS i) UNION ALL SELECT 2, i, i, 0, 0 FROM (SELECT unnest(range(6)) AS i) UNION ALL SELECT 2, 10 - i, i, 0, 0 FROM (SELECT unnest(range(5)) AS i) UNION ALL SELECT 2, 10 + i, i, 0, 0 FROM (SELECT unnest(range(1, 6)) AS i) UNION ALL SELECT 2, 10 + part * 10 + i, x, y, z FROM sides WHERE part > 0)",
    "straight AS (SELECT gap_id, i AS idx, round_even(low + i / 7.0::DOUBLE * 5, 0)::BIGINT AS a0, round_even(1 + i / 7.0::DOUBLE * 5, 0)::BIGINT AS a1, round_even(1 + i / 7.0::DOUBLE * 5, 0)::BIGINT AS a2 FROM going, (SELECT unnest(range(8)) AS i))",
    "own AS (SELECT gap_id, row_number() OVER (PARTITION BY gap_id ORDER BY nr) - 1 AS idx, low + x AS a0, 1 + y AS a1, 1 + z AS a2 FROM going JOIN ways ON kind = low // 8 % 4)",
    "path AS (SELECT * FROM own UNION ALL SELECT * FROM straight WHERE gap_id NOT IN (SELECT gap_id FROM own))",
    "moves AS (SELECT gap_id, a0 - low AS x, a1 - 1 AS y, a2 - 1 AS z, sqrt((a0 - lag(a0) OVER w)^2 + (a1 - lag(a1) OVER w)^2 + (a2 - lag(a2) OVER w)^2) AS move FROM path JOIN gaps USING (gap_id) WINDOW w AS (PARTITION BY gap_id ORDER BY idx))",
    "checks AS (SELECT gap_id, sum(move) / sqrt(75.0::DOUBLE) AS sinuosity, sum(move) / sqrt(75.0::DOUBLE) <= 1.8 AND max(sqrt(greatest(x * x + y * y + z * z - (x + y + z)^2 / 3.0::DOUBLE, 0))) <= greatest(5, 2 * greatest(max(ra), max(rb))) AS ok FROM moves JOIN gaps USING (gap_id) GROUP BY gap_id)",
    "taken AS (SELECT * FROM path WHERE gap_id IN (SELECT gap_id FROM checks WHERE ok) UNION ALL SELECT * FROM straight WHERE gap_id NOT IN (SELECT gap_id FROM checks WHERE ok))",
    "rated AS (SELECT gap_id, avg(coalesce(p, 0)) AS mean FROM taken LEFT JOIN roi USING (gap_id, a0, a1, a2) GROUP BY gap_id)",
    "wide AS (SELECT t.gap_id, a0, a1, a2, greatest(1, round_even(greatest(1.5, 0.7 * ra) * (1 - idx / m) + greatest(1.5, 0.7 * rb) * (idx / m), 0)) AS r FROM (SELECT *, (max(idx) OVER (PARTITION BY gap_id))::DOUBLE AS m FROM taken) t JOIN rated USING (gap_id) JOIN tried USING (gap_id) WHERE mean >= needs)",
    "fresh AS (SELECT gap_id, a0, a1, a2 FROM good UNION SELECT v.gap_id, v.a0, v.a1, v.a2 FROM roi v JOIN wide w ON w.gap_id = v.gap_id AND (v.a0 - w.a0)^2 + (v.a1 - w.a1)^2 + (v.a2 - w.a2)^2 <= r * r WHERE in_tube AND NOT in_mask)",
]
PAIRED = "{'model': model, 'case_id': case_id} AS case_id, a0, a1, a2"


def merged_sql(select: str) -> str:
    """The sparse mask with straight bridges over the pairs of g22: its components over faces, the bridges applied, and the label near each end."""
    cube = "abs(l.a0 - e.a0) <= r AND abs(l.a1 - e.a1) <= r AND abs(l.a2 - e.a2) <= r"
    return with_ctes(
        f"pairs AS ({GRAPHS['g22_gap_pairs']})", VOXELS, "base AS (SELECT case_id, a0, a1, a2 FROM voxels WHERE value > 0.25)",
        "ends AS (SELECT *, a // 64 AS s0, a // 8 % 8 AS s1, a % 8 AS s2, b // 64 AS e0, b // 8 % 8 AS e1, b % 8 AS e2 FROM pairs)",
        "steps AS (SELECT *, ceil(sqrt((e0 - s0)^2 + (e1 - s1)^2 + (e2 - s2)^2))::BIGINT AS n FROM ends)",
        "line AS (SELECT DISTINCT case_id, a, b, " + ", ".join(f"round_even(s{k} + t / n::DOUBLE * (e{k} - s{k}), 0)::BIGINT AS a{k}" for k in range(3)) + " FROM steps, LATERAL (SELECT unnest(range(n + 1)) AS t))",
        "new AS (SELECT * FROM line WHERE (case_id, a0, a1, a2) NOT IN (SELECT (case_id, a0, a1, a2) FROM base))",
        "good AS (SELECT case_id, a, b FROM new GROUP BY ALL HAVING count(*) >= 2)",
        "sparse AS (SELECT case_id, a0, a1, a2 FROM base UNION SELECT case_id, a0, a1, a2 FROM new JOIN good USING (case_id, a, b))", labelled(6),
        "spots AS (SELECT case_id, place, place // 64 AS a0, place // 8 % 8 AS a1, place % 8 AS a2 FROM (SELECT case_id, a AS place FROM good UNION SELECT case_id, b FROM good))",
        f"votes AS (SELECT e.case_id, e.place, r, l.root, count(*) AS n FROM spots e JOIN (VALUES (0), (1), (2)) x(r) ON true JOIN labelled l ON l.case_id = e.case_id AND {cube} GROUP BY ALL)",
        "near AS (SELECT case_id, place, root FROM votes QUALIFY row_number() OVER (PARTITION BY case_id, place ORDER BY r, n DESC, root) = 1)",
        select=select,
    ).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES = {
    "g30_refinement": f"""WITH classes AS ({GRAPHS["g21_tip_classes"]}), pairs AS ({GRAPHS["g22_gap_pairs"]}), {VOXELS}, {MASKS}
SELECT case_id, n_tips, n_invalid, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_connected, 0) AS n_connected, coalesce(n, 0) - coalesce(b, 0) AS voxels_added
FROM (SELECT case_id, count(*) AS n_tips, count(*) FILTER (NOT is_valid) AS n_invalid FROM classes GROUP BY case_id) LEFT JOIN (SELECT case_id, count(*) AS n_pairs, count(*) FILTER (distance_mm < 2) AS n_connected FROM pairs GROUP BY case_id) USING (case_id)
LEFT JOIN (SELECT case_id, count(*) AS b FROM pred GROUP BY 1) USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n FROM truth GROUP BY 1) USING (case_id)""",
    "a29_case_masks": with_ctes(VOXELS, SHAPES, "cut AS (SELECT case_id, a0, a1, a2 FROM voxels WHERE value >= 0.15)", *cleaned_sql("cut", SMALL, "c_"), "grid AS (SELECT *, round_even(n0 * 0.625::DOUBLE, 0)::BIGINT AS m0, 10 AS m1, 8 AS m2 FROM shapes)", lerp("SELECT case_id, {'x': i, 'y': j, 'z': k} AS g, (i + 0.5::DOUBLE) * (n0 / m0::DOUBLE) - 0.5 AS p0, (j + 0.5::DOUBLE) * (n1 / m1::DOUBLE) - 0.5 AS p1, (k + 0.5::DOUBLE) * (n2 / m2::DOUBLE) - 0.5 AS p2 FROM grid, LATERAL (SELECT unnest(range(m0)) AS i), range(10) y(j), range(8) z(k)"),
        select="SELECT case_id, g.x AS a0, g.y AS a1, g.z AS a2, 'truth' AS side FROM lerped WHERE value * 2 > 0.3 UNION ALL SELECT case_id, a0, a1, a2, 'pred' FROM cut UNION ALL SELECT case_id, a0, a1, a2, 'clean' FROM c_clean").replace("WITH ", "WITH RECURSIVE ", 1),
    "a25_evaluate_models": with_ctes(VOXELS, "cuts AS (SELECT * FROM (VALUES ('low', 0.12::DOUBLE), ('high', 0.18::DOUBLE)) x(model, t))", f"pred AS (SELECT {PAIRED} FROM voxels, cuts WHERE value > t)", "sparse AS (SELECT * FROM pred)",
        f"truth AS (SELECT {PAIRED} FROM voxels, cuts WHERE value > 0.10::DOUBLE + 0.10::DOUBLE * ((a0 + a1 + a2) % 2) AND (model, case_id) IN (SELECT (case_id.model, case_id.case_id) FROM pred))", FACES, SURFACES, labelled(6),
        "o AS (SELECT case_id, count(p)::DOUBLE AS n_pred, count(t)::DOUBLE AS n_truth, count(*) FILTER (p AND t)::DOUBLE AS n_both FROM (SELECT *, true AS p FROM pred) FULL JOIN (SELECT *, true AS t FROM truth) USING (case_id, a0, a1, a2) GROUP BY case_id)",
        "s AS (SELECT case_id, quantile_cont(d, 0.95) AS hd95, (avg(d) FILTER (side = 'p') + avg(d) FILTER (side = 't')) / 2 AS asd, avg((d <= 0.5)::INT) AS sd5, avg((d <= 1.0)::INT) AS sd10 FROM dist GROUP BY case_id)",
        "c AS (SELECT case_id, count(*) AS n_components, max(size) AS largest, sum(size)::BIGINT AS total, max(size) / sum(size) AS largest_fraction FROM sizes GROUP BY case_id)",
        select="""SELECT case_id.model AS model, case_id.case_id AS "case", round(2 * n_both / (n_pred + n_truth), 6) AS dice, round(n_both / (n_pred + n_truth - n_both), 6) AS iou, round(n_both / n_pred, 6) AS precision, round(n_both / n_truth, 6) AS recall,
  round(hd95, 6) AS hd95, round(asd, 6) AS asd, round(sd5, 6) AS surface_dice_0_5, round(sd10, 6) AS surface_dice_1_0, n_components, largest, total, round(largest_fraction, 6) AS largest_fraction FROM o JOIN s USING (case_id) LEFT JOIN c USING (case_id)""").replace("WITH ", "WITH RECURSIVE ", 1),
    "g25_threshold_bridges": with_ctes(VOXELS, SHAPES, ROI, "tries AS (SELECT gap_id, t, low, a0, a1, a2 FROM roi, (VALUES (0.2::DOUBLE), (0.15::DOUBLE), (0.1::DOUBLE)) x(t) WHERE in_mask OR (in_tube AND p > t))",
        "reach AS (SELECT * FROM tries WHERE a0 = low AND a1 = 1 AND a2 = 1 UNION SELECT s.* FROM reach r JOIN tries s ON s.gap_id = r.gap_id AND s.t = r.t AND abs(s.a0 - r.a0) + abs(s.a1 - r.a1) + abs(s.a2 - r.a2) = 1)",
        "found AS (SELECT gap_id, max(t) AS threshold FROM reach WHERE a0 = low + 5 AND a1 = 6 AND a2 = 6 GROUP BY gap_id)",
        "n AS (SELECT found.gap_id, threshold, count(p) AS n_new FROM found LEFT JOIN roi ON roi.gap_id = found.gap_id AND in_tube AND NOT in_mask AND p > threshold GROUP BY ALL)",
        "e AS (SELECT gap_id, threshold, n_new, pi() * ((greatest(1, radius_a) + 1.5::DOUBLE) / 2)^2 * sqrt(75.0::DOUBLE) AS expected FROM n JOIN gaps USING (gap_id))",
        select="SELECT gap_id, round(threshold, 6) AS threshold, n_new, round(expected, 6) AS expected, n_new >= 10 AND NOT (n_new > 3 * expected AND n_new > 100) AS accepted FROM e").replace("WITH ", "WITH RECURSIVE ", 1),
    "g26_bridge_costs": with_ctes(VOXELS, SHAPES, ROI, "o AS (SELECT *, a0 - low AS x, a1 - 1 AS y, a2 - 1 AS z FROM roi)",
        select="""SELECT gap_id, a0, a1, a2, round(CASE WHEN (x = 0 AND y = 0 AND z = 0) OR (x = 5 AND y = 5 AND z = 5) THEN 0.01 WHEN NOT in_tube THEN 10
  ELSE 1 - greatest(0, least(p, 0.99)) + 0.3 * sqrt(greatest(x * x + y * y + z * z - (x + y + z)^2 / 3.0::DOUBLE, 0)) / (sqrt(75.0::DOUBLE) / 2) END, 6) AS cost FROM o"""),
    "g28_resegmented": with_ctes(*LADDER, "f AS (SELECT gap_id, count(*) AS n_new, sum(a0 * 64 + a1 * 8 + a2)::BIGINT AS places FROM fresh GROUP BY gap_id)", "b AS (SELECT gap_id, max(threshold) AS threshold, avg(p) AS mean FROM good GROUP BY gap_id)",
        select="""SELECT gap_id, tier, CASE WHEN action = 'skip' THEN 'skipped' WHEN threshold IS NOT NULL THEN 'probability_threshold' WHEN r.mean IS NULL THEN 'skipped_low_signal' WHEN r.mean < needs THEN 'skipped_low_probability' WHEN ok THEN 'dijkstra_thin' ELSE 'dijkstra_thin_straight_fallback' END AS strategy,
  round(threshold, 6) AS threshold, round(sinuosity, 6) AS sinuosity, CASE WHEN action <> 'skip' THEN round(coalesce(b.mean, r.mean, joint, 0), 6) END AS avg_probability, coalesce(n_new, 0) AS n_new, coalesce(places, 0) AS places
  FROM tried LEFT JOIN b USING (gap_id) LEFT JOIN rated r USING (gap_id) LEFT JOIN checks USING (gap_id) LEFT JOIN f USING (gap_id)""").replace("WITH ", "WITH RECURSIVE ", 1),
    "g29_merged_bridges": merged_sql("SELECT case_id, a0, a1, a2 FROM labelled JOIN sizes USING (case_id, root) WHERE size >= 2 OR case_id NOT IN (SELECT case_id FROM good)"),
    "g29_verified_gaps": merged_sql("SELECT p.case_id, p.a * 100000 + p.b AS gap_id, g.case_id IS NOT NULL AS applied, coalesce(x.root = y.root, false) AS connected FROM pairs p LEFT JOIN good g ON g.case_id = p.case_id AND g.a = p.a AND g.b = p.b LEFT JOIN near x ON x.case_id = g.case_id AND x.place = g.a LEFT JOIN near y ON y.case_id = g.case_id AND y.place = g.b"),
    "g17_highlight": with_ctes(VOXELS, MASKS, POINTS, "spot AS (SELECT case_id, seg_id, idx, {'x': idx, 'y': seg_id % 8, 'z': seg_id % 5} AS node FROM points)",
        "hops AS (SELECT case_id, node AS src, lead(node) OVER (PARTITION BY case_id, seg_id ORDER BY idx) AS dst FROM spot)", "links AS (SELECT case_id, src, dst FROM hops WHERE dst IS NOT NULL UNION SELECT case_id, dst, src FROM hops WHERE dst IS NOT NULL)",
        "clicks AS (SELECT case_id, min(idx) AS s0, max(idx) AS e0, min(seg_id % 8) AS s1, max(seg_id % 8) AS e1, min(seg_id % 5) AS s2, max(seg_id % 5) AS e2 FROM points GROUP BY case_id)",
        *(f"{name} AS (SELECT case_id, arg_min(node, ((node.x - {p}0)^2 + (node.y - {p}1)^2 + (node.z - {p}2)^2) * 1000000 + node.x * 64 + node.y * 8 + node.z) AS node FROM spot JOIN clicks USING (case_id) GROUP BY case_id)" for name, p in (("first", "s"), ("last", "e"))),
        "walk AS (SELECT case_id, node, 0 AS depth FROM first UNION SELECT w.case_id, l.dst, depth + 1 FROM walk w JOIN links l ON l.case_id = w.case_id AND l.src = w.node WHERE depth < 150)", "deep AS (SELECT case_id, node, min(depth) AS depth FROM walk GROUP BY ALL)",
        "back AS (SELECT case_id, node, depth FROM last JOIN deep USING (case_id, node) UNION SELECT b.case_id, p.node, p.depth FROM back b JOIN (SELECT l.case_id, l.dst, d.depth, arg_min(l.src, l.src.x * 64 + l.src.y * 8 + l.src.z) AS node FROM links l JOIN deep d ON d.case_id = l.case_id AND d.node = l.src GROUP BY l.case_id, l.dst, d.depth) p ON p.case_id = b.case_id AND p.dst = b.node AND p.depth = b.depth - 1)",
        "way AS (SELECT case_id, node FROM back UNION SELECT * FROM first UNION SELECT * FROM last)",
        select="SELECT DISTINCT v.case_id, v.a0, v.a1, v.a2 FROM pred v JOIN way w ON w.case_id = v.case_id AND (v.a0 - w.node.x)^2 + (v.a1 - w.node.y)^2 + (v.a2 - w.node.z)^2 <= 4").replace("WITH ", "WITH RECURSIVE ", 1),
    "v21_component_boxes": RECURSIVE(labelled(26), select="SELECT case_id, root, min(a0) - 2 AS low0, max(a0) + 2 AS high0, min(a1) - 2 AS low1, max(a1) + 2 AS high1, min(a2) - 2 AS low2, max(a2) + 2 AS high2 FROM labelled GROUP BY ALL"),
}
