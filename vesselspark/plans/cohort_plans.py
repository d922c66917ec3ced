"""Queries of cohort evaluation (A7, A9, A10, A23-A27, P17-P19, T4, T8, J11, S10-S13) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metrics, profile
from ..session import new_path
from ..sources import documents
from .fixtures import POINTS, points, table, voxels, with_ctes
from .profile_plans import ALL, LABELS, rounded, segment_labels, sql_round
from .voxel_plans import VOXELS

NAMES = "n_bifurcations total_length n_components largest_fraction radius_mean continuity".split()


def tier2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier-2 case rows: a case for each document, its source the model and its language the data set."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    n = F.col("n_chars")
    rows = d.select(
        F.col("source").alias("model"), F.col("lang").alias("dataset"), F.col("doc_id").alias("case_id"), (n % 30).cast("double").alias("n_bifurcations"), (n % 400).cast("double").alias("total_length"),
        (n % 7 + 1).cast("double").alias("n_components"), (F.lit(1.0) / (n % 7 + 1)).alias("largest_fraction"), F.when(n % 11 == 0, float("nan")).otherwise(n % 50 / 20).alias("radius_mean"), (n % 10 / 10).alias("plausibility"),
    )
    return rows.withColumn("continuity", scalars.continuity_score(F.col("largest_fraction"), F.col("n_bifurcations"), F.col("total_length"), F.col("plausibility")))


TIER2 = """
tier2 AS (SELECT *, 0.4 * largest_fraction + 0.3 * least(1, n_bifurcations / 15) + 0.2 * least(1, total_length / 200) + 0.1 * plausibility AS continuity FROM (
  SELECT source AS model, lang AS dataset, doc_id AS case_id, (n_chars % 30)::DOUBLE AS n_bifurcations, (n_chars % 400)::DOUBLE AS total_length, (n_chars % 7 + 1)::DOUBLE AS n_components, 1.0::DOUBLE / (n_chars % 7 + 1) AS largest_fraction,
    CASE WHEN n_chars % 11 = 0 THEN NULL ELSE n_chars % 50 / 20.0::DOUBLE END AS radius_mean, n_chars % 10 / 10.0::DOUBLE AS plausibility FROM documents)),
cohort2 AS (SELECT model, dataset, """ + ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in NAMES) + """, count(*) AS n_cases FROM tier2 GROUP BY ALL)
"""


def a10_tier2_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations a model and data set, NaN skipped."""
    return rounded(metrics.cohort(tier2_rows(spark, sf_dir), ["model", "dataset"], NAMES))


def a9_skeleton_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.smooth(points(spark, sf_dir).withColumn("idx", F.col("idx").cast("int")))
    counts = rows.groupBy("case_id").agg(F.count_if((F.col("idx") == 0) & F.col("start_bif")).alias("n_bifurcations"), F.count_if(F.col("idx") == 0).alias("n_endpoints"))
    return rounded(metrics.skeleton_metrics(rows, counts))


def domain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.cohort(tier2_rows(spark, sf_dir), ["model", "dataset"], NAMES)
    return metrics.domain_gap(rows, "en", "de")


def a23_domain_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(domain_gaps(spark, sf_dir))


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a model with the metrics of all tiers."""
    rows = tier2_rows(spark, sf_dir).groupBy("model").agg(F.avg("continuity").alias("continuity"), F.avg("n_bifurcations").alias("n_bifurcations"), F.avg("largest_fraction").alias("dice"), F.avg("plausibility").alias("surface_dice"), F.count("*").alias("n"))
    k = F.regexp_extract("model", r"(\d+)", 1).cast("int")
    rows = rows.withColumns({
        "asd": F.when(k % 5 == 0, float("nan")).otherwise(k / 10), "mare": k / 20, "hd95": k * 0.7, "side_sensitivity": F.when(k % 3 == 0, F.lit(None)).otherwise(k / 25), "sensitivity": k / 30, "side_specificity": k / 22,
        "specificity": k / 40, "agreement": F.col("surface_dice"), "miss_rate": k / 50, "extra_rate": k / 60,
    })
    return rows.join(domain_gaps(spark, sf_dir).select("model", "domain_gap"), "model")


def t4_rank_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18, P19, T4"""
    return rounded(metrics.rank_models(model_rows(spark, sf_dir)).select("model", "tier1", "tier2", "tier3", "tier4", "composite", "rank"))


def a26_metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_report(model_rows(spark, sf_dir), ["dice", "asd", "hd95", "continuity"], ("dice",), [f"src{k}" for k in range(20)])


def a24_sample_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: of each model 5 cases by hash."""
    return metrics.sample_cases(tier2_rows(spark, sf_dir).select("model", "case_id"), 5, 42, ("model",))


def a27_clinical_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = points(spark, sf_dir).select("case_id").distinct()
    return metrics.clinical_report(profile.detect(points(spark, sf_dir), segment_labels(spark, sf_dir)), cases)


def t8_near_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.near_slice(profile.detect(points(spark, sf_dir)), 0, 30, 8)
    return rows.select("case_id", "seg_id", "v0", "x", "y")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel trees as JSON documents, a case each: made from points, with string keys."""
    rows = points(spark, sf_dir)
    own = F.struct("idx", "arc_mm", "radius_mm", "p0", "p1", "p2")
    seg = rows.groupBy("case_id", "seg_id", "length_mm", "start_bif", "end_bif").agg(F.array_sort(F.collect_list(own)).alias("p"))
    take = lambda f: F.transform("p", f)
    body = F.struct(
        F.col("seg_id").cast("int").alias("id"), F.array((F.col("seg_id") * 2).cast("int"), (F.col("seg_id") * 2 + 1).cast("int")).alias("node_ids"), take(lambda x: F.array(x["p0"], x["p1"], x["p2"])).alias("centerline_points"),
        take(lambda x: x["arc_mm"]).alias("arc_length_mm"), take(lambda x: x["radius_mm"]).alias("radii_mm"), "length_mm",
    )
    node = lambda k, flag: F.struct((F.col("seg_id") * 2 + k).cast("string").alias("key"), F.struct((F.col("seg_id") * 2 + k).cast("int").alias("id"), F.col(flag).alias("is_bifurcation")).alias("value"))
    docs = seg.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("seg_id").cast("string"), body))).alias("segments"), F.map_from_entries(F.flatten(F.collect_list(F.array(node(0, "start_bif"), node(1, "end_bif"))))).alias("nodes"))
    return docs.select("case_id", F.to_json(F.struct(F.struct("nodes", "segments").alias("vessel_tree"))).alias("json"))


def s10_tree_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points read back from the documents."""
    rows = documents.tree_points(trees(spark, sf_dir))
    return rounded(rows.select("case_id", "seg_id", F.col("idx").cast("long").alias("idx"), "arc_mm", "radius_mm", "length_mm", "start_bif", "end_bif", "p0", "p1"))


def s10_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.tree_nodes(trees(spark, sf_dir)).select("case_id", "node_id", "is_bifurcation", "is_endpoint")


def s11_report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON, one for each customer; every third has no segments."""
    k = F.col("c_custkey")
    artery = F.format_string('"arteries": {"LM": {"stenosis_percent": %d, "severity_name": "Mild"}, "LCX": {"severity": 2}}', k % 100)
    segment = F.when(k % 3 == 0, "").otherwise(F.format_string(', "segments": {"LAD_prox": {"artery": "LAD", "stenosis_percent": %d, "severity_name": "Severe"}}', k % 90))
    json = F.concat(F.lit('{"training_labels": {'), artery, segment, F.when(k % 2 == 0, ', "dominance": "Left"').otherwise(""), F.lit("}}"))
    return documents.report_findings(table(spark, sf_dir, "customer").select(k.alias("case_id"), json.alias("json")))


def s12_chunked_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume written in chunks, and a box read back."""
    path = new_path(spark, "volume")
    documents.write_chunks(voxels(spark, sf_dir), path, 16)
    rows = documents.read_chunks(spark, path, {"a0": (10, 25), "a1": (2, 6)}, 16)
    return rounded(rows.select("case_id", "a0", "a1", "a2", "value"))


def s13_result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as JSON, a folder a case, and read back."""
    path = new_path(spark, "findings")
    found = rounded(profile.detect(points(spark, sf_dir)).select("case_id", "seg_id", "pct", "severity"))
    documents.write_results(found, path)
    return spark.read.schema("seg_id long, pct double, severity string, case_id long").json(path)


QUERIES = {f.__name__: f for f in (
    a9_skeleton_metrics, a10_tier2_cohort, a23_domain_gap, t4_rank_models, a26_metric_report, a24_sample_cases, a27_clinical_report, t8_near_slice, s10_tree_points, s10_tree_nodes, s11_report_findings, s12_chunked_volume, s13_result_sink,
)}
RATIO = "CASE WHEN a.{0}_mean > 0 AND b.{0}_mean > 0 THEN b.{0}_mean / a.{0}_mean ELSE 1 END AS {1}_ratio"
GAP = f"""
ratios AS (SELECT model, {RATIO.format("n_bifurcations", "bif")}, {RATIO.format("total_length", "len")}, {RATIO.format("n_components", "comp")}, {RATIO.format("radius_mean", "rad")}, abs(b.largest_fraction_mean - a.largest_fraction_mean) AS lcf_diff
  FROM (SELECT * FROM cohort2 WHERE dataset = 'en') a JOIN (SELECT * FROM cohort2 WHERE dataset = 'de') b USING (model)),
gaps AS (SELECT *, 0.3 * abs(1 - bif_ratio) + 0.3 * abs(1 - len_ratio) + 0.2 * abs(1 - comp_ratio) + 0.1 * lcf_diff + 0.1 * abs(1 - rad_ratio) AS domain_gap FROM ratios)
"""
MODELS = """
models AS (SELECT m.*, domain_gap, CASE WHEN k % 5 = 0 THEN 'nan'::DOUBLE ELSE k / 10.0::DOUBLE END AS asd, k / 20.0::DOUBLE AS mare, k * 0.7::DOUBLE AS hd95, coalesce(CASE WHEN k % 3 = 0 THEN NULL ELSE k / 25.0::DOUBLE END, k / 30.0::DOUBLE) AS sens, k / 22.0::DOUBLE AS spec, surface_dice AS agreement, k / 50.0::DOUBLE AS miss, k / 60.0::DOUBLE AS extra
  FROM (SELECT model, regexp_extract(model, '(\\d+)')::INT AS k, avg(continuity) AS continuity, avg(n_bifurcations) AS n_bifurcations, avg(largest_fraction) AS dice, avg(plausibility) AS surface_dice FROM tier2 GROUP BY model) m JOIN gaps USING (model)),
tiers AS (SELECT *, 0.3 * dice + 0.25 * surface_dice + 0.15 * greatest(0, 1 - CASE WHEN isnan(asd) THEN 3 ELSE asd END / 3) + 0.15 * greatest(0, 1 - mare / 2) + 0.15 * greatest(0, 1 - hd95 / 10) AS tier1, continuity AS tier2,
  0.3 * sens + 0.2 * spec + 0.2 * agreement + 0.15 * (1 - miss) + 0.15 * (1 - extra) AS tier3, greatest(0, 1 - least(1, domain_gap)) AS tier4 FROM models),
ranked AS (SELECT *, 0.25 * tier1 + 0.15 * tier2 + 0.45 * tier3 + 0.15 * tier4 AS composite FROM tiers)
"""
SKEL = """
weights AS (SELECT * FROM (VALUES {k}) v(k, w)), sized0 AS (SELECT *, count(*) OVER (PARTITION BY case_id, seg_id) AS n FROM points),
sm AS (SELECT s.case_id, s.seg_id, s.idx, s.length_mm, s.start_bif, sum(w * p.radius_mm) AS r FROM sized0 s CROSS JOIN weights JOIN points p ON p.case_id = s.case_id AND p.seg_id = s.seg_id
  AND p.idx = CASE WHEN (s.idx + k + 2 * n) % (2 * n) < n THEN (s.idx + k + 2 * n) % (2 * n) ELSE 2 * n - 1 - (s.idx + k + 2 * n) % (2 * n) END GROUP BY ALL)
""".format(k=", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-2, 3), profile.gaussian_weights(0.5), strict=True)))
LINE = "printf('%s: %.0f%% %s at %.1f mm', coalesce(artery_name, 'unknown'), pct, severity, location_mm)"
GRADE = "CASE severity WHEN 'Severe' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Mild' THEN 1 ELSE 0 END"
ORACLES = {
    "a9_skeleton_metrics": with_ctes(POINTS, SKEL, select="""SELECT case_id, n_bifurcations, n_endpoints, round(total_length_mm, 6) AS total_length_mm, n_segments, round(a, 6) AS radius_min, round(b, 6) AS radius_max, round(c, 6) AS radius_mean, round(p, 6) AS plausibility, round(n_bifurcations / n_endpoints, 6) AS bifurcation_ratio
  FROM (SELECT case_id, count(*) FILTER (idx = 0 AND start_bif) AS n_bifurcations, count(*) FILTER (idx = 0) AS n_endpoints, sum(length_mm) FILTER (idx = 0) AS total_length_mm, count(DISTINCT seg_id) AS n_segments, min(r) AS a, max(r) AS b, avg(r) AS c, avg((r BETWEEN 0.2 AND 5.0)::INT) AS p FROM sm GROUP BY case_id)"""),
    "a10_tier2_cohort": with_ctes(TIER2, select="SELECT model, dataset, n_cases, " + ", ".join(f"round({m}_{x}, 6) AS {m}_{x}" for m in NAMES for x in ("mean", "std")) + " FROM cohort2"),
    "a23_domain_gap": with_ctes(TIER2, GAP, select=f"SELECT model, {sql_round('bif_ratio len_ratio comp_ratio rad_ratio lcf_diff domain_gap')} FROM gaps"),
    "t4_rank_models": with_ctes(TIER2, GAP, MODELS, select=f"SELECT model, {sql_round('tier1 tier2 tier3 tier4 composite')}, row_number() OVER (ORDER BY composite DESC, sens DESC, surface_dice DESC, n_bifurcations DESC, model)::INT AS rank FROM ranked"),
    "a26_metric_report": with_ctes(TIER2, GAP, MODELS, "long AS (SELECT model, unnest(['dice', 'asd', 'hd95', 'continuity']) AS metric, unnest([printf('%.1f%%', dice * 100), CASE WHEN isnan(asd) THEN 'N/A' ELSE printf('%.3f', asd) END, printf('%.3f', hd95), printf('%.3f', continuity)]) AS t FROM models)", select="SELECT metric, " + ", ".join(f"max(t) FILTER (model = 'src{k}') AS src{k}" for k in range(20)) + " FROM long GROUP BY metric"),
    "a24_sample_cases": "SELECT source AS model, doc_id AS case_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) <= 5",
    "a27_clinical_report": with_ctes(*ALL, LABELS, f"lines AS (SELECT case_id, string_agg({LINE}, chr(10) ORDER BY {GRADE} DESC, pct DESC, seg_id, start_mm) AS body, max({GRADE}) AS worst, count(*) AS n FROM findings LEFT JOIN labels_of USING (case_id, seg_id) GROUP BY case_id)",
        select="SELECT case_id, coalesce(body, 'no findings') || chr(10) || 'impression: ' || ['Normal', 'Mild', 'Moderate', 'Severe'][coalesce(worst, 0) + 1] || ', ' || coalesce(n, 0) || ' findings' AS report FROM (SELECT DISTINCT case_id FROM points) LEFT JOIN lines USING (case_id)"),
    "t8_near_slice": with_ctes(*ALL, select="SELECT case_id, seg_id, v0, v2 AS x, v1 AS y FROM findings WHERE abs(v0 - 30) <= 8"),
    "s10_tree_points": with_ctes(POINTS, select=f"SELECT case_id, seg_id, idx, start_bif, end_bif, {sql_round('arc_mm radius_mm length_mm p0 p1')} FROM points"),
    "s10_tree_nodes": with_ctes(POINTS, select="SELECT case_id, (seg_id * 2 + k)::INT AS node_id, CASE k WHEN 0 THEN start_bif ELSE end_bif END AS is_bifurcation, false AS is_endpoint FROM (SELECT DISTINCT case_id, seg_id, start_bif, end_bif FROM points), range(2) t(k)"),
    "s11_report_findings": """SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN 'Left' END AS dominance, f.* FROM customer, LATERAL (SELECT 'LAD_prox' AS name, 'LAD' AS artery, (c_custkey % 90)::DOUBLE AS pct, 'Severe' AS severity WHERE c_custkey % 3 <> 0
  UNION ALL SELECT 'LM', NULL, (c_custkey % 100)::DOUBLE, 'Mild' WHERE c_custkey % 3 = 0 UNION ALL SELECT 'LCX', NULL, 0.0, '2' WHERE c_custkey % 3 = 0) f""",
    "s12_chunked_volume": with_ctes(VOXELS, select="SELECT case_id, a0, a1, a2, round(value, 6) AS value FROM voxels WHERE a0 BETWEEN 10 AND 25 AND a1 BETWEEN 2 AND 6"),
    "s13_result_sink": with_ctes(*ALL, select="SELECT case_id, seg_id, round(pct, 6) AS pct, severity FROM findings"),
}
