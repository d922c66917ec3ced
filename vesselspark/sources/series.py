"""Slice headers, image series and case discovery."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["case_id", "series_number"]


@dataclass(frozen=True)
class SeriesConfig:
    """Scoring rules of series. Phases in order of preference and words that rule a series out."""

    phases: tuple[str, ...] = ("75%", "70%", "80%")
    excluded: tuple[str, ...] = ("lung", "calcium score", "locator", "tracker", "tracker graph", "exam summary", "sbi")
    min_slices: int = 200
    max_thickness: float = 1.5
    best_thickness: tuple[float, float] = (0.5, 1.0)
    cardiac_fov: float = 250.0
    borderline_fov: float = 300.0
    wide_fov: float = 350.0


def input_kind(listing: DataFrame) -> DataFrame:
    """The kind of each case's input, from rows (case_id, name, is_dir, in_zarr_group, header_ok); a single plain file is judged by its suffix."""
    name = F.lower("name")
    nifti, dicom = name.rlike(r"\.nii(\.gz)?$"), name.endswith(".dcm")
    ok = F.coalesce("header_ok", F.lit(False))
    # the first by name; of rows that repeat a name, one whose header parses
    first_bare = F.min_by(ok, F.when(~F.col("name").contains("."), F.struct("name", ~ok)))
    found = listing.groupBy("case_id").agg(
        F.bool_or((F.col("name") == ".zgroup")).alias("group"), F.bool_or((F.col("name") == "image") & F.col("is_dir")).alias("image"),
        F.bool_or(dicom).alias("dicom"), F.coalesce(first_bare, F.lit(False)).alias("bare"), F.bool_or(nifti).alias("nifti"),
    )
    kind = F.when(F.col("group") & F.col("image"), "zarr").when(F.col("dicom") | F.col("bare"), "dicom").when(F.col("nifti"), "nifti").otherwise("unknown")
    return found.select("case_id", kind.alias("kind"))


def usable_slices(slices: DataFrame) -> DataFrame:
    """Headers of files named .dcm or without a suffix, no hidden files, with a series number."""
    name = F.substring_index("filepath", "/", -1)
    return slices.filter(~name.startswith(".") & (F.lower(name).endswith(".dcm") | ~name.contains(".")) & F.col("series_number").isNotNull())


def roll_up(slices: DataFrame) -> DataFrame:
    """S3: a row a series: number of slices, the header of the first file by path, and the field of view."""
    head = F.struct("series_description", "modality", "rows", "cols", "slice_thickness", "pixel_spacing", "reconstruction_diameter")
    rows = slices.groupBy(*SERIES).agg(F.count("*").alias("num_slices"), F.min_by(head, "filepath").alias("h"))
    spacing = F.try_element_at("h.pixel_spacing", F.lit(1))
    fov = F.when(F.col("h.reconstruction_diameter") > 0, F.col("h.reconstruction_diameter")).when(F.col("h.cols") > 0, spacing * F.col("h.cols"))
    thick = F.when(F.col("h.slice_thickness") != 0, F.col("h.slice_thickness"))
    return rows.select(*SERIES, "num_slices", F.col("h.series_description").alias("description"), "h.modality", thick.alias("slice_thickness"), fov.alias("fov_mm"))


def phase_of(description: Column, cfg: SeriesConfig = SeriesConfig()) -> Column:
    out = F.lit(None).cast("string")
    for phase in reversed(cfg.phases):
        out = F.when(F.upper(description).contains(phase), phase).otherwise(out)
    return out


def series_score(cfg: SeriesConfig = SeriesConfig()) -> Column:
    """How well a series suits; -1000 and -500 rule it out."""
    text = F.lower("description")
    phase = phase_of(F.col("description"), cfg)
    by_phase = F.lit(0)
    for k, p in enumerate(cfg.phases):
        by_phase = F.when(phase == p, 100 - 50 * k).otherwise(by_phase)
    t, fov = F.col("slice_thickness"), F.col("fov_mm")
    thickness = F.when(t.isNull(), 0).when(t.between(*cfg.best_thickness), 50).when(t <= cfg.max_thickness, 20).otherwise(-100)
    full = F.upper("description").contains("75%")
    body = F.when(full & text.contains("body"), 200).when(full, 0).when(text.contains("cardiac"), -200).otherwise(0)
    view = F.when(fov.isNull(), 0).when(fov <= cfg.cardiac_fov, 80).when(fov <= cfg.borderline_fov, 0).when(fov <= cfg.wide_fov, -150).otherwise(-300)
    extra = F.when(text.contains("coronary"), 30).otherwise(0) + F.when(text.contains("segment"), -30).otherwise(0)
    total = F.least("num_slices", F.lit(400)) + by_phase + thickness + body + view + extra
    out = F.lit(False)
    for word in cfg.excluded:
        out = out | text.contains(word)
    return F.when(out, -1000).when(F.col("num_slices") < cfg.min_slices, -500).otherwise(total).cast("double")


def scored(series: DataFrame, cfg: SeriesConfig = SeriesConfig()) -> DataFrame:
    rows = series.withColumn("selection_score", series_score(cfg))
    candidate = F.col("selection_score").cast("int").isin(-1000, -500)
    return rows.withColumn("is_candidate", ~candidate).withColumn("phase", F.when(~candidate, phase_of(F.col("description"), cfg)))


def quality_warnings(cfg: SeriesConfig = SeriesConfig()) -> Column:
    """Short names of what speaks against a chosen series."""
    found = F.array(
        F.when(F.col("fov_mm") > cfg.borderline_fov, "wide fov"), F.when(F.col("selection_score") < 200, "low score"), F.when(F.lower("description").contains("segment"), "segment reconstruction")
    )
    return F.filter(found, lambda x: x.isNotNull())


def best_series(series: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Of each case the candidate with the highest score above 0, ties to the smaller number; an override (case_id, series_number) that the case has wins."""
    rows = series.withColumn("forced", F.lit(False))
    if overrides is not None:
        rows = series.join(overrides.select(*SERIES, F.lit(True).alias("forced")), SERIES, "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    rows = rows.filter(F.col("forced") | (F.col("is_candidate") & (F.col("selection_score") > 0)))
    order = Window.partitionBy("case_id").orderBy(F.desc("forced"), F.desc("selection_score"), "series_number")
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def with_z(slices: DataFrame) -> DataFrame:
    """The header's z, else the instance number, else 0."""
    return slices.withColumn("z", F.coalesce("z_position", F.col("instance_number").cast("double"), F.lit(0.0)))


def dedup_slices(slices: DataFrame, share: float = 0.95) -> DataFrame:
    """Where unique z (2 decimals) are fewer than 95 % of a series' slices, the first of each z stays, in order of z and path."""
    by = Window.partitionBy(*SERIES)
    rows = slices.withColumn("z2", F.bround("z", 2)).withColumn("nth", F.row_number().over(Window.partitionBy(*SERIES, "z2").orderBy("z", "filepath")))
    rows = rows.withColumn("many", F.count_if(F.col("nth") == 1).over(by) < F.count("*").over(by) * share)
    return rows.filter(~F.col("many") | (F.col("nth") == 1)).drop("z2", "nth", "many")


def largest_position(slices: DataFrame, factor: float = 10.0, least_mm: float = 5.0) -> DataFrame:
    """Series are cut where z jumps by more than max(10 x the upper median gap, 5 mm); the cluster with most slices stays, the first on a tie."""
    by = Window.partitionBy(*SERIES)
    order = by.orderBy("z", "filepath")
    rows = slices.withColumn("gap", F.col("z") - F.lag("z").over(order)).withColumn("n_gaps", F.count("gap").over(by))
    ranked = rows.withColumn("gap_place", F.row_number().over(by.orderBy(F.col("gap").asc_nulls_last())))
    middle = F.max(F.when(F.col("gap_place") == F.floor(F.col("n_gaps") / 2) + 1, F.col("gap"))).over(by)
    cut = (F.col("n_gaps") >= 2) & (F.col("gap") > F.greatest(F.col("middle") * factor, F.lit(least_mm)))
    rows = ranked.withColumn("middle", middle).withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int"))
    rows = rows.withColumn("cluster", F.sum("cut").over(order))
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy(*SERIES, "cluster")))
    best = F.min_by("cluster", F.struct(-F.col("size"), F.col("cluster"))).over(by)
    return rows.withColumn("best", best).filter("cluster = best").drop("gap", "n_gaps", "gap_place", "middle", "cut", "cluster", "size", "best")


def volume_checks(volumes: DataFrame) -> DataFrame:
    """Problems of volumes (n_slices, z_spacing, expected_slices, arrays): too few slices, wide spacing, too few of those expected, no image array."""
    found = F.array(
        F.when(F.col("n_slices") < 50, "few slices"), F.when(F.col("z_spacing") > 50, "wide spacing"),
        F.when(F.col("n_slices") < F.col("expected_slices") * 0.8, "slices missing"), F.when(~F.array_contains("arrays", "image"), "no image"),
    )
    return volumes.withColumn("problems", F.filter(found, lambda x: x.isNotNull()))


def stage_rows(volumes: DataFrame, stage: str) -> DataFrame:
    """A status row a case; a failed rule becomes an error text."""
    return volumes.select("case_id", F.lit(stage).alias("stage"), F.when(F.size("problems") > 0, "error").otherwise("success").alias("status"), F.concat_ws("; ", "problems").alias("error"), "n_slices")


def image_label_cases(paths: DataFrame) -> DataFrame:
    """Cases that have both an image and a label file, from paths."""
    name = F.substring_index("path", "/", -1)
    images = paths.select(F.regexp_extract(name, r"^(\d+)\.img\.nii\.gz$", 1).alias("case_id"), F.col("path").alias("image")).filter("case_id <> ''")
    labels = paths.select(F.regexp_extract(name, r"^(\d+)\.label\.nii\.gz$", 1).alias("case_id"), F.col("path").alias("label")).filter("case_id <> ''")
    return images.join(labels, "case_id")


def directory_cases(paths: DataFrame) -> DataFrame:
    """Directories named case-*."""
    return paths.select(F.explode(F.split("path", "/")).alias("case_id")).filter(F.col("case_id").startswith("case-")).distinct()


def report_paths(cases: DataFrame, paths: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each case's report: the file named after it, else its manifest entry."""
    sibling = paths.filter(F.col("path").endswith(".json")).select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.json$", "").alias("case_id"), F.col("path").alias("own"))
    rows = cases.join(sibling, "case_id", "left").join(manifest.select("case_id", F.col("report").alias("listed")), "case_id", "left")
    return rows.select("case_id", F.coalesce("own", "listed").alias("report"))
