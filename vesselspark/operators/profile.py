"""Narrowings along vessel segments: window operators over points ordered by index.

Points have case_id, seg_id, idx, arc_mm, radius_mm, length_mm, start_bif, end_bif, p0, p1, p2. All windows share the
partitioning by (case_id, seg_id), so the whole chain needs one shuffle of the points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finding_confidence, severity

SEGMENT = ["case_id", "seg_id"]


@dataclass(frozen=True)
class NarrowingConfig:
    """Thresholds of the detector. They decide which narrowings are findings."""

    min_points: int = 5
    sigma: float = 0.5
    suppression_mm: float = 2.0
    suppression_factor: float = 1.5
    exclude_ends_mm: float = 2.0
    reference_percentile: float = 0.8
    least_reference_mm: float = 0.1
    run_percent: float = 25.0
    min_run_mm: float = 1.0
    taper_mm: float = 6.0
    taper_fraction: float = 0.05
    drop_rate: float = 0.5
    drop_radius_mm: float = 0.55
    floor_radius_mm: float = 0.25
    floor_length_mm: float = 20.0
    extreme_ratio: float = 0.25
    extreme_length_mm: float = 40.0
    merge_mm: float = 2.0
    min_confidence: float = 0.60


def gaussian_weights(sigma: float) -> list[float]:
    """Weights of a kernel of radius int(4 sigma + 0.5), which add up to 1."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smooth(points: DataFrame, value: str = "radius_mm", out: str = "r", sigma: float = 0.5, keys: list[str] = SEGMENT) -> DataFrame:
    """Gaussian smoothing by index, mirrored at both ends (as often as a short segment needs). Interior points read their neighbours
    by lag and lead; only near an end the mirrored index is looked up in the segment's own end values."""
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    by = Window.partitionBy(*keys).orderBy("idx")
    whole = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = points.withColumn("__n", n)
    # the first and last values, which mirrored indexes fall on: 2 * radius of them cover segments of any length
    at_end = lambda i: (i < radius) | (i >= F.col("__n") - radius)
    edge = F.when((F.col("idx") < 2 * radius) | (F.col("idx") >= F.col("__n") - 2 * radius), F.struct("idx", value))
    rows = rows.withColumn("__edge", F.when(at_end(F.col("idx")), F.map_from_entries(F.collect_list(edge).over(whole))))
    parts = []
    for k, w in zip(range(-radius, radius + 1), weights, strict=True):
        at = F.pmod(F.col("idx") + k, 2 * F.col("__n"))
        mirrored = F.when(at < F.col("__n"), at).otherwise(2 * F.col("__n") - 1 - at)
        inside = (F.col("idx") + k >= 0) & (F.col("idx") + k < F.col("__n"))
        parts.append(F.when(inside, F.lag(value, -k).over(by)).otherwise(F.element_at("__edge", mirrored.cast("int"))) * w)
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return rows.withColumn(out, total).drop("__n", "__edge")


def curve(points: DataFrame, cfg: NarrowingConfig = NarrowingConfig()) -> DataFrame:
    """Points of segments with enough points, with smoothed radius r, suppressed, reference and narrowing pct."""
    whole = Window.partitionBy(*SEGMENT)
    rows = points.withColumn("n", F.count("*").over(whole)).filter(F.col("n") >= cfg.min_points)
    rows = smooth(rows.withColumn("idx", F.col("idx").cast("int")), sigma=cfg.sigma)
    near_start = F.col("start_bif") & (F.col("arc_mm") < cfg.suppression_mm)
    near_end = F.col("end_bif") & (F.col("arc_mm") > F.col("length_mm") - cfg.suppression_mm)
    rows = rows.withColumn("med", F.percentile("r", F.lit(0.5)).over(whole))
    rows = rows.withColumn("suppressed", near_start | near_end | ((F.col("med") > 0) & (F.col("r") > F.col("med") * cfg.suppression_factor)))
    inner = F.when(~F.col("suppressed") & F.col("arc_mm").between(cfg.exclude_ends_mm, F.col("length_mm") - cfg.exclude_ends_mm), F.col("r"))
    free = F.when(~F.col("suppressed"), F.col("r"))
    high = lambda c: F.percentile(c, F.lit(cfg.reference_percentile)).over(whole)
    rows = rows.withColumns({"inner": inner, "free": free})
    reference = F.when(F.count("inner").over(whole) >= 3, high("inner")).when(F.count("free").over(whole) >= 1, high("free")).otherwise(high("r"))
    rows = rows.withColumn("reference", reference).filter(F.col("reference") >= cfg.least_reference_mm)
    pct = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.col("r") / F.col("reference")) * 100))
    step = Window.partitionBy(*SEGMENT).orderBy("idx")
    slope = F.abs(F.col("r") - F.lag("r").over(step)) / F.greatest(F.col("arc_mm") - F.lag("arc_mm").over(step), F.lit(0.01))
    rows = rows.withColumn("pct", F.when(F.col("suppressed"), 0.0).otherwise(pct)).withColumn("slope", slope)
    return rows.withColumn("steepest", F.max("slope").over(step.rowsBetween(-4, 5))).drop("inner", "free", "med", "slope")


def runs(curved: DataFrame, cfg: NarrowingConfig = NarrowingConfig()) -> DataFrame:
    """Contiguous runs of pct at or over the limit and long enough, with their first highest point."""
    step = Window.partitionBy(*SEGMENT).orderBy("idx")
    rows = curved.filter(F.col("pct") >= cfg.run_percent).withColumn("run", F.col("idx") - F.row_number().over(step))
    peak = F.min_by(F.struct("idx", "arc_mm", "r", "pct", "p0", "p1", "p2", "steepest"), F.struct(-F.col("pct"), F.col("idx")))
    found = rows.groupBy(*SEGMENT, "run", "length_mm", "reference", "n").agg(
        F.min("arc_mm").alias("start_mm"), F.max("arc_mm").alias("end_mm"), F.count("*").alias("n_points"), peak.alias("peak")
    )
    found = found.filter(F.col("end_mm") - F.col("start_mm") >= cfg.min_run_mm)
    names = {"location_idx": "peak.idx", "location_mm": "peak.arc_mm", "min_radius_mm": "peak.r", "pct": "peak.pct", "steepest": "peak.steepest"}
    rows = found.select("*", *(F.col(c).alias(n) for n, c in names.items()), *(F.col(f"peak.p{k}").cast("int").alias(f"v{k}") for k in range(3)))
    from_end = F.least("location_mm", F.col("length_mm") - F.col("location_mm"))
    return rows.withColumn("confidence", finding_confidence(F.col("pct"), F.col("length_mm"), from_end, F.col("n_points"))).drop("peak", "run", "n")


def taper_ok(cfg: NarrowingConfig = NarrowingConfig()) -> Column:
    """W8"""
    limit = F.greatest(F.lit(cfg.taper_mm), F.col("length_mm") * cfg.taper_fraction)
    return (F.col("location_mm") > limit) & (F.col("location_mm") < F.col("length_mm") - limit)


def drop_ok(cfg: NarrowingConfig = NarrowingConfig()) -> Column:
    """W9"""
    return ~((F.coalesce("steepest", F.lit(0.0)) > cfg.drop_rate) & (F.col("min_radius_mm") < cfg.drop_radius_mm))


def floor_ok(cfg: NarrowingConfig = NarrowingConfig()) -> Column:
    """W10"""
    return ~((F.col("min_radius_mm") < cfg.floor_radius_mm) & (F.col("length_mm") > cfg.floor_length_mm))


def extreme_ok(cfg: NarrowingConfig = NarrowingConfig()) -> Column:
    """W11"""
    return ~((F.col("min_radius_mm") / F.col("reference") < cfg.extreme_ratio) & (F.col("length_mm") > cfg.extreme_length_mm))


def merge_near(found: DataFrame, cfg: NarrowingConfig = NarrowingConfig()) -> DataFrame:
    """Findings whose start lies less than merge_mm past the end of those before become one. The highest percent and its place, the
    least radius and the last end count; confidence and reference stay the first's."""
    step = Window.partitionBy(*SEGMENT).orderBy("start_mm")
    before = F.max("end_mm").over(step.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("new", F.when(F.col("start_mm") - before < cfg.merge_mm, 0).otherwise(1))
    rows = rows.withColumn("group", F.sum("new").over(step))
    first = lambda c: F.min_by(c, "start_mm").alias(c)
    best = F.struct(-F.col("pct"), F.col("start_mm"))
    return rows.groupBy(*SEGMENT, "group").agg(
        *(F.min_by(c, best).alias(c) for c in ("location_idx", "location_mm", "v0", "v1", "v2")), F.max("pct").alias("pct"), F.min("min_radius_mm").alias("min_radius_mm"),
        *(first(c) for c in ("reference", "length_mm", "confidence")), F.min("start_mm").alias("start_mm"), F.max("end_mm").alias("end_mm"),
    ).drop("group")


def detect(points: DataFrame, labels: DataFrame | None = None, cfg: NarrowingConfig = NarrowingConfig()) -> DataFrame:
    """All steps, artery labels (case_id, seg_id, artery_name, full_name) joined on (J1), then the confidence gate. Severity is graded
    from the merged percent. Order by pct desc, seg_id, start_mm to list them."""
    found = runs(curve(points, cfg), cfg).filter(taper_ok(cfg) & drop_ok(cfg) & floor_ok(cfg) & extreme_ok(cfg))
    found = merge_near(found, cfg).withColumn("severity", severity(F.col("pct")))
    if labels is not None:
        found = found.join(labels.select(*SEGMENT, "artery_name", F.col("full_name").alias("artery_region")), SEGMENT, "left")
    return found.filter(F.col("confidence") >= cfg.min_confidence)


def with_bifurcations(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments (case_id, seg_id, start_node, end_node) with the bifurcation flags of both ends; a missing node is none."""
    flags = nodes.select("case_id", F.col("node_id"), "is_bifurcation")
    start = flags.select("case_id", F.col("node_id").alias("start_node"), F.col("is_bifurcation").alias("start_bif"))
    end = flags.select("case_id", F.col("node_id").alias("end_node"), F.col("is_bifurcation").alias("end_bif"))
    rows = segments.join(start, ["case_id", "start_node"], "left").join(end, ["case_id", "end_node"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("start_bif", "end_bif")})


def case_summary(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of each case by severity and the highest grade; cases without findings count as Normal."""
    count = lambda s: F.count_if(F.col("severity") == s)
    agg = findings.groupBy("case_id").agg(F.count("*").alias("n_findings"), count("Mild").alias("n_mild"), count("Moderate").alias("n_moderate"), count("Severe").alias("n_severe"), F.max("pct").alias("max_pct"))
    rows = cases.join(agg, "case_id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_findings", "n_mild", "n_moderate", "n_severe")}
    return rows.withColumns(zero).withColumn("max_pct", F.coalesce("max_pct", F.lit(0.0))).withColumn("max_severity", severity(F.col("max_pct")))
