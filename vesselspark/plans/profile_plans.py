"""Queries of the narrowing operators (W1-W13, A11, J1-J2, T2-T3, P8-P9) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import profile
from .fixtures import POINTS, points, table, with_ctes

KERNEL = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-2, 3), profile.gaussian_weights(0.5), strict=True))
SMOOTH = f"""
sized AS (SELECT *, count(*) OVER (PARTITION BY case_id, seg_id) AS n FROM points),
kernel AS (SELECT * FROM (VALUES {KERNEL}) v(k, w)),
mirrored AS (SELECT s.case_id, s.seg_id, s.idx, k.w, CASE WHEN (s.idx + k.k + 2 * s.n) % (2 * s.n) < s.n THEN (s.idx + k.k + 2 * s.n) % (2 * s.n) ELSE 2 * s.n - 1 - (s.idx + k.k + 2 * s.n) % (2 * s.n) END AS at
  FROM sized s, kernel k WHERE s.n >= 5),
smoothed AS (SELECT m.case_id, m.seg_id, m.idx, sum(m.w * p.radius_mm) AS r FROM mirrored m JOIN points p ON p.case_id = m.case_id AND p.seg_id = m.seg_id AND p.idx = m.at GROUP BY ALL)
"""
CURVE = """
med AS (SELECT case_id, seg_id, quantile_cont(r, 0.5) AS med FROM smoothed GROUP BY ALL),
marked AS (SELECT s.*, o.r, (s.start_bif AND s.arc_mm < 2.0) OR (s.end_bif AND s.arc_mm > s.length_mm - 2.0) OR (m.med > 0 AND o.r > m.med * 1.5) AS suppressed
  FROM sized s JOIN smoothed o USING (case_id, seg_id, idx) JOIN med m USING (case_id, seg_id)),
refs AS (SELECT case_id, seg_id, CASE WHEN count(*) FILTER (NOT suppressed AND arc_mm BETWEEN 2.0 AND length_mm - 2.0) >= 3
      THEN quantile_cont(r, 0.8) FILTER (NOT suppressed AND arc_mm BETWEEN 2.0 AND length_mm - 2.0)
      WHEN count(*) FILTER (NOT suppressed) >= 1 THEN quantile_cont(r, 0.8) FILTER (NOT suppressed) ELSE quantile_cont(r, 0.8) END AS reference FROM marked GROUP BY ALL),
sloped AS (SELECT m.*, reference, CASE WHEN suppressed THEN 0.0 ELSE greatest(0.0, least(100.0, (1 - r / reference) * 100)) END AS pct,
    abs(r - lag(r) OVER w) / greatest(arc_mm - lag(arc_mm) OVER w, 0.01) AS slope
  FROM marked m JOIN refs USING (case_id, seg_id) WHERE reference >= 0.1 WINDOW w AS (PARTITION BY case_id, seg_id ORDER BY idx)),
curved AS (SELECT *, max(slope) OVER (PARTITION BY case_id, seg_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING) AS steepest FROM sloped)
"""
RUNS = """
islands AS (SELECT *, idx - row_number() OVER (PARTITION BY case_id, seg_id ORDER BY idx) AS run FROM curved WHERE pct >= 25),
peaks AS (SELECT *, row_number() OVER (PARTITION BY case_id, seg_id, run ORDER BY pct DESC, idx) AS k, min(arc_mm) OVER w AS start_mm, max(arc_mm) OVER w AS end_mm, count(*) OVER w AS n_points
  FROM islands WINDOW w AS (PARTITION BY case_id, seg_id, run)),
runs AS (SELECT case_id, seg_id, length_mm, reference, start_mm, end_mm, n_points, idx AS location_idx, arc_mm AS location_mm, r AS min_radius_mm, pct, steepest, trunc(p0)::INT AS v0, trunc(p1)::INT AS v1, trunc(p2)::INT AS v2,
    least(1.0, least(1.0, pct / 100 + 0.3) * (0.5 + 0.2 * least(1.0, length_mm / 20) + 0.15 * least(1.0, least(arc_mm, length_mm - arc_mm) / 5) + 0.15 * least(1.0, n_points / 10.0))) AS confidence
  FROM peaks WHERE k = 1 AND end_mm - start_mm >= 1.0)
"""
FINDINGS = """
kept AS (SELECT * FROM runs WHERE location_mm > greatest(6.0, length_mm * 0.05) AND location_mm < length_mm - greatest(6.0, length_mm * 0.05)
    AND NOT (coalesce(steepest, 0) > 0.5 AND min_radius_mm < 0.55) AND NOT (min_radius_mm < 0.25 AND length_mm > 20) AND NOT (min_radius_mm / reference < 0.25 AND length_mm > 40)),
gaps AS (SELECT *, CASE WHEN start_mm - max(end_mm) OVER (PARTITION BY case_id, seg_id ORDER BY start_mm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 2.0 THEN 0 ELSE 1 END AS new FROM kept),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY case_id, seg_id ORDER BY start_mm) AS g FROM gaps),
merged AS (SELECT case_id, seg_id, g, arg_min(location_idx, (-pct, start_mm)) AS location_idx, arg_min(location_mm, (-pct, start_mm)) AS location_mm, arg_min(v0, (-pct, start_mm)) AS v0, arg_min(v1, (-pct, start_mm)) AS v1,
    arg_min(v2, (-pct, start_mm)) AS v2, max(pct) AS pct, min(min_radius_mm) AS min_radius_mm, arg_min(reference, start_mm) AS reference, arg_min(length_mm, start_mm) AS length_mm, arg_min(confidence, start_mm) AS confidence,
    min(start_mm) AS start_mm, max(end_mm) AS end_mm FROM grouped GROUP BY ALL),
findings AS (SELECT * EXCLUDE (g), CASE WHEN pct < 25 THEN 'Normal' WHEN pct < 50 THEN 'Mild' WHEN pct < 70 THEN 'Moderate' ELSE 'Severe' END AS severity FROM merged WHERE confidence >= 0.6)
"""
LABELS = """
labels_of AS (SELECT DISTINCT case_id, seg_id, ['LM', 'LAD', 'LCx', 'RCA'][seg_id % 4 + 1] AS artery_name, 'proximal ' || ['LM', 'LAD', 'LCx', 'RCA'][seg_id % 4 + 1] AS full_name FROM points WHERE seg_id % 5 <> 0)
"""
ALL = (POINTS, SMOOTH, CURVE, RUNS, FINDINGS)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines' last bits agree."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql_round(names: str, exact: str = "") -> str:
    return ", ".join([*(f"round({n}, 6) AS {n}" for n in names.split()), *exact.split()])


def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("case_id", "seg_id").distinct().filter("seg_id % 5 <> 0")
    name = F.element_at(F.array(*map(F.lit, scalars.ARTERIES)), (F.col("seg_id") % 4 + 1).cast("int"))
    return rows.withColumn("artery_name", name).withColumn("full_name", F.concat(F.lit("proximal "), name))


def w2_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("idx", F.col("idx").cast("int"))
    return rounded(profile.smooth(rows).select("case_id", "seg_id", F.col("idx").cast("long").alias("idx"), "r"))


def w5_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.curve(points(spark, sf_dir)).select("case_id", "seg_id", F.col("idx").cast("long").alias("idx"), "r", "suppressed", "reference", "pct", "steepest")
    return rounded(rows)


def w6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.runs(profile.curve(points(spark, sf_dir))).drop("steepest")).withColumn("location_idx", F.col("location_idx").cast("long"))


def w8_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs each filter would keep."""
    rows = profile.runs(profile.curve(points(spark, sf_dir)))
    count = lambda c, n: F.count_if(c).alias(n)
    return rows.groupBy("case_id").agg(F.count("*").alias("n_runs"), count(profile.taper_ok(), "n_taper"), count(profile.drop_ok(), "n_drop"), count(profile.floor_ok(), "n_floor"), count(profile.extreme_ok(), "n_extreme"))


def w13_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.detect(points(spark, sf_dir), segment_labels(spark, sf_dir))
    return rounded(found.withColumn("location_idx", F.col("location_idx").cast("long")))


def a11_case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("case_id")).distinct()
    return rounded(profile.case_summary(cases, profile.detect(points(spark, sf_dir))))


def t2_findings_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by percent, and by grade first."""
    from pyspark.sql import Window

    by = Window.partitionBy("case_id")
    order = [F.desc("pct"), F.col("seg_id"), F.col("start_mm")]
    found = profile.detect(points(spark, sf_dir)).withColumn("grade", scalars.grade(F.col("severity")))
    rows = found.withColumn("by_pct", F.row_number().over(by.orderBy(*order))).withColumn("by_grade", F.row_number().over(by.orderBy(F.desc("grade"), *order)))
    return rounded(rows.select("case_id", "seg_id", "start_mm", "pct", "by_pct", "by_grade"))


def j2_bifurcation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    segments = orders.select((F.col("o_custkey") % 10).alias("case_id"), F.col("o_orderkey").alias("seg_id"), (F.col("o_orderkey") % 50).alias("start_node"), (F.col("o_custkey") % 70).alias("end_node"))
    nodes = table(spark, sf_dir, "nation").select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("case_id"), F.col("n_nationkey").cast("long").alias("node_id"), (F.col("n_nationkey") % 3 == 0).alias("is_bifurcation"))
    return profile.with_bifurcations(segments, nodes.withColumn("case_id", F.col("case_id").cast("long")))


QUERIES = {f.__name__: f for f in (w2_smooth, w5_curve, w6_runs, w8_filters, w13_detect, a11_case_summary, t2_findings_in_order, j2_bifurcation_flags)}
FOUND = "location_mm pct min_radius_mm reference length_mm confidence start_mm end_mm"
ORACLES = {
    # here short segments are smoothed too
    "w2_smooth": with_ctes(POINTS, SMOOTH.replace("WHERE s.n >= 5", ""), select="SELECT case_id, seg_id, idx, round(r, 6) AS r FROM smoothed"),
    "w5_curve": with_ctes(POINTS, SMOOTH, CURVE, select=f"SELECT case_id, seg_id, idx, suppressed, {sql_round('r reference pct steepest')} FROM curved"),
    "w6_runs": with_ctes(POINTS, SMOOTH, CURVE, RUNS, select=f"SELECT case_id, seg_id, location_idx, n_points, v0, v1, v2, {sql_round('length_mm reference start_mm end_mm location_mm min_radius_mm pct confidence')} FROM runs"),
    "w8_filters": with_ctes(POINTS, SMOOTH, CURVE, RUNS, select="""SELECT case_id, count(*) AS n_runs, count(*) FILTER (location_mm > greatest(6.0, length_mm * 0.05) AND location_mm < length_mm - greatest(6.0, length_mm * 0.05)) AS n_taper,
  count(*) FILTER (NOT (coalesce(steepest, 0) > 0.5 AND min_radius_mm < 0.55)) AS n_drop, count(*) FILTER (NOT (min_radius_mm < 0.25 AND length_mm > 20)) AS n_floor,
  count(*) FILTER (NOT (min_radius_mm / reference < 0.25 AND length_mm > 40)) AS n_extreme FROM runs GROUP BY case_id"""),
    "w13_detect": with_ctes(*ALL, LABELS, select=f"SELECT case_id, seg_id, location_idx, v0, v1, v2, severity, artery_name, full_name AS artery_region, {sql_round(FOUND)} FROM findings LEFT JOIN labels_of USING (case_id, seg_id)"),
    "a11_case_summary": with_ctes(*ALL, select="""SELECT case_id, count(seg_id) AS n_findings, count(*) FILTER (severity = 'Mild') AS n_mild, count(*) FILTER (severity = 'Moderate') AS n_moderate, count(*) FILTER (severity = 'Severe') AS n_severe,
  round(coalesce(max(pct), 0.0), 6) AS max_pct, CASE WHEN coalesce(max(pct), 0) < 25 THEN 'Normal' WHEN max(pct) < 50 THEN 'Mild' WHEN max(pct) < 70 THEN 'Moderate' ELSE 'Severe' END AS max_severity
  FROM (SELECT DISTINCT user_id % 10 AS case_id FROM events) LEFT JOIN findings USING (case_id) GROUP BY case_id"""),
    "t2_findings_in_order": with_ctes(*ALL, select="""SELECT case_id, seg_id, round(start_mm, 6) AS start_mm, round(pct, 6) AS pct, row_number() OVER (PARTITION BY case_id ORDER BY pct DESC, seg_id, start_mm)::INT AS by_pct,
  row_number() OVER (PARTITION BY case_id ORDER BY CASE severity WHEN 'Severe' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Mild' THEN 1 ELSE 0 END DESC, pct DESC, seg_id, start_mm)::INT AS by_grade FROM findings"""),
    "j2_bifurcation_flags": """WITH nodes AS (SELECT c AS case_id, n_nationkey AS node_id, n_nationkey % 3 = 0 AS b FROM nation, range(10) t(c)), s AS (SELECT o_custkey % 10 AS case_id, o_orderkey AS seg_id, o_orderkey % 50 AS start_node, o_custkey % 70 AS end_node FROM orders)
SELECT s.*, coalesce(x.b, false) AS start_bif, coalesce(y.b, false) AS end_bif FROM s LEFT JOIN nodes x ON x.case_id = s.case_id AND x.node_id = start_node LEFT JOIN nodes y ON y.case_id = s.case_id AND y.node_id = end_node""",
}
