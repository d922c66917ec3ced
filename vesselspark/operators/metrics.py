"""Evaluation of masks and models: overlap, surface distances, components, tiers, ranks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import voxels as vox


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def overlap(counts: DataFrame) -> DataFrame:
    """A1: from counts of overlay(); 0 where a denominator is 0."""
    p, t, b = (F.col(c) for c in ("n_pred", "n_truth", "n_both"))
    return counts.select("case_id", share(2 * b, p + t).alias("dice"), share(b, p + t - b).alias("iou"), share(b, p).alias("precision"), share(b, t).alias("recall"))


def surface_distances(pred: DataFrame, truth: DataFrame, spacing: float = 0.5) -> DataFrame:
    """A2: (case_id, side, d): from each surface voxel to the nearest of the other surface; one infinite distance a side where either is empty."""
    a, b = vox.surface(pred), vox.surface(truth)
    one = vox.nearest(vox.as_points(a, "x", "id_a"), vox.as_points(b, "y", "id_b")).select("case_id", F.lit("p").alias("side"), (F.col("distance") * spacing).alias("d"))
    two = vox.nearest(vox.as_points(b, "x", "id_a"), vox.as_points(a, "y", "id_b")).select("case_id", F.lit("t").alias("side"), (F.col("distance") * spacing).alias("d"))
    left, right = pred.select("case_id").distinct(), truth.select("case_id").distinct()
    lone = left.join(right, "case_id", "left_anti").union(right.join(left, "case_id", "left_anti"))
    none = lone.select("case_id", F.explode(F.array(F.lit("p"), F.lit("t"))).alias("side"), F.lit(float("inf")).alias("d"))
    return one.union(two).union(none)


def surface_metrics(distances: DataFrame, tolerances: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """A3-A5: HD95, mean surface distance and surface Dice at each tolerance."""
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("d")))
    within = [F.avg((F.col("d") <= t).cast("double")).alias(f"surface_dice_{str(t).replace('.', '_')}") for t in tolerances]
    return distances.groupBy("case_id").agg(F.percentile("d", F.lit(0.95)).alias("hd95"), ((mean("p") + mean("t")) / 2).alias("asd"), *within)


def radius_error(pred: DataFrame, truth: DataFrame, points: DataFrame, shapes: DataFrame, spacing: float = 0.5) -> DataFrame:
    """Mean absolute and mean signed difference of the distance maps at points inside the truth; null where there is none."""
    t = vox.distance_transform(truth, shapes).withColumnRenamed("distance", "t")
    p = vox.distance_transform(pred, shapes).withColumnRenamed("distance", "p")
    rows = points.join(t, vox.KEY).join(p, vox.KEY, "left").withColumn("diff", (F.coalesce("p", F.lit(0.0)) - F.col("t")) * spacing)
    return rows.groupBy("case_id").agg(F.avg(F.abs("diff")).alias("mare"), F.avg("diff").alias("msre"), F.count("*").alias("n_samples"))


def component_metrics(labelled: DataFrame) -> DataFrame:
    """A8"""
    sizes = vox.component_sizes(labelled)
    return sizes.groupBy("case_id").agg(F.count("*").alias("n_components"), F.max("size").alias("largest"), F.sum("size").alias("total"), (F.max("size") / F.sum("size")).alias("largest_fraction"))


def skeleton_metrics(points: DataFrame, counts: DataFrame) -> DataFrame:
    """Per case of segment points (r: smoothed radius) with n_bifurcations and n_endpoints: length, radii and the share of plausible ones."""
    plausible = F.avg(F.col("r").between(0.2, 5.0).cast("double"))
    own = points.groupBy("case_id", "seg_id").agg(F.first("length_mm").alias("length_mm"), F.sum("r").alias("s"), F.count("r").alias("n"))
    lengths = own.groupBy("case_id").agg(F.sum("length_mm").alias("total_length_mm"), F.count("*").alias("n_segments"))
    radii = points.groupBy("case_id").agg(F.min("r").alias("radius_min"), F.max("r").alias("radius_max"), F.avg("r").alias("radius_mean"), plausible.alias("plausibility"))
    rows = counts.join(lengths, "case_id", "left").join(radii, "case_id", "left").fillna(0)
    return rows.withColumn("bifurcation_ratio", share(F.col("n_bifurcations"), F.col("n_endpoints")))


def cohort(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over cases; NaN is skipped, infinities are not; null where nothing is left."""
    some = lambda c: F.when(~F.isnan(c), F.col(c))
    parts = [f(some(m)).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return rows.groupBy(*keys).agg(*parts, F.count("*").alias("n_cases"))


def domain_gap(tier2: DataFrame, first: str, second: str) -> DataFrame:
    """Of cohort rows (model, dataset, means) how far the second data set lies from the first."""
    names = {"n_bifurcations_mean": "bif", "total_length_mean": "len", "n_components_mean": "comp", "largest_fraction_mean": "lcf", "radius_mean_mean": "rad"}
    side = lambda d, p: tier2.filter(F.col("dataset") == d).select("model", *(F.coalesce(c, F.lit(0.0)).alias(f"{p}_{n}") for c, n in names.items()))
    rows = side(first, "a").join(side(second, "b"), "model")
    ratio = lambda n: F.when((F.col(f"a_{n}") > 0) & (F.col(f"b_{n}") > 0), F.col(f"b_{n}") / F.col(f"a_{n}")).otherwise(1.0)
    rows = rows.select("model", *(ratio(n).alias(f"{n}_ratio") for n in ("bif", "len", "comp", "rad")), F.abs(F.col("b_lcf") - F.col("a_lcf")).alias("lcf_diff"))
    off = lambda n: F.abs(1 - F.col(f"{n}_ratio"))
    return rows.withColumn("domain_gap", 0.3 * off("bif") + 0.3 * off("len") + 0.2 * off("comp") + 0.1 * F.col("lcf_diff") + 0.1 * off("rad"))


def rank_models(models: DataFrame, weights: tuple[float, ...] = (0.25, 0.15, 0.45, 0.15)) -> DataFrame:
    """Tier scores, composite and rank; ties by sensitivity, surface Dice, bifurcations, then name."""
    c = F.col
    rows = models.withColumn("tier1", scalars.tier1_score(c("dice"), c("surface_dice"), c("asd"), c("mare"), c("hd95"))).withColumn("tier2", c("continuity"))
    rows = rows.withColumn("tier3", scalars.tier3_score(c("side_sensitivity"), c("sensitivity"), c("side_specificity"), c("specificity"), c("agreement"), c("miss_rate"), c("extra_rate")))
    rows = rows.withColumn("tier4", scalars.tier4_score(c("domain_gap"))).withColumn("composite", scalars.composite(c("tier1"), c("tier2"), c("tier3"), c("tier4"), weights))
    sens = F.coalesce("side_sensitivity", "sensitivity", F.lit(0.0))
    order = Window.orderBy(F.desc("composite"), F.desc(sens), F.desc("surface_dice"), F.desc("n_bifurcations"), "model")
    return rows.withColumn("rank", F.row_number().over(order))


def metric_report(models: DataFrame, metrics: list[str], percent: tuple[str, ...] = (), names: list[str] | None = None) -> DataFrame:
    """A row a metric, a column a model (each of names, if given, else all there are); NaN and null as N/A, shares as percent."""
    text = lambda m: F.when(F.col(m).isNull() | F.isnan(m), "N/A").otherwise(F.format_string("%.1f%%", F.col(m) * 100) if m in percent else F.format_string("%.3f", F.col(m)))
    long = models.select("model", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), text(m).alias("text")) for m in metrics))))
    return long.groupBy("metric").pivot("model", names).agg(F.first("text"))


def sample_cases(cases: DataFrame, n: int, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """N cases without replacement by a hash of seed and case; within each group of keys."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("case_id").cast("string")))
    if not keys:
        return cases.orderBy(order, "case_id").limit(n)
    return cases.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "case_id"))).filter(F.col("__k") <= n).drop("__k")


def clinical_report(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """A text a case, its findings by grade and percent, and an impression."""
    line = F.format_string("%s: %.0f%% %s at %.1f mm", F.coalesce("artery_name", F.lit("unknown")), "pct", "severity", "location_mm")
    order = F.struct((-scalars.grade(F.col("severity"))).alias("g"), (-F.col("pct")).alias("p"), "seg_id", "start_mm", line.alias("line"))
    rows = cases.join(findings.groupBy("case_id").agg(F.array_sort(F.collect_list(order)).alias("lines"), F.max(scalars.grade(F.col("severity"))).alias("worst"), F.count("*").alias("n")), "case_id", "left")
    worst = F.get(F.array(*map(F.lit, scalars.SEVERITIES)), F.coalesce("worst", F.lit(0)))
    body = F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("no findings"))
    return rows.select("case_id", F.concat(body, F.lit("\nimpression: "), worst, F.lit(", "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" findings")).alias("report"))


def near_slice(findings: DataFrame, axis: int, index: int, reach: int = 2) -> DataFrame:
    """Findings whose place lies within reach of a slice, with their two coordinates in it."""
    others = [k for k in range(3) if k != axis]
    rows = findings.filter(F.abs(F.col(f"v{axis}") - index) <= reach)
    return rows.withColumn("x", F.col(f"v{others[1]}")).withColumn("y", F.col(f"v{others[0]}"))
