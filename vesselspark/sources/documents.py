"""JSON documents as rows: run configs, vessel trees, reader reports; and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

PARAMETERS = "STRUCT<hu_min: DOUBLE, hu_max: DOUBLE, target_spacing: ARRAY<DOUBLE>, target_orientation: STRING, zscore_clip: ARRAY<DOUBLE>>"
CONFIG = f"""
model_type STRING, loss_type STRING, description STRING,
training_config STRUCT<model_type: STRING, loss_type: STRING, hu_min: DOUBLE, hu_max: DOUBLE, target_spacing: ARRAY<DOUBLE>, target_orientation: STRING, zscore_clip: ARRAY<DOUBLE>>,
preprocessing STRUCT<config: STRUCT<parameters: {PARAMETERS}>>, final_metrics STRUCT<best_val_dice: DOUBLE>,
data_splits STRUCT<train_case_ids: ARRAY<STRING>, val_case_ids: ARRAY<STRING>, test_case_ids: ARRAY<STRING>>
"""
TREE = """
vessel_tree STRUCT<
  nodes: MAP<STRING, STRUCT<id: INT, position: ARRAY<INT>, radius_mm: DOUBLE, is_bifurcation: BOOLEAN, is_endpoint: BOOLEAN, neighbors: ARRAY<INT>>>,
  segments: MAP<STRING, STRUCT<id: INT, node_ids: ARRAY<INT>, centerline_points: ARRAY<ARRAY<DOUBLE>>, arc_length_mm: ARRAY<DOUBLE>, radii_mm: ARRAY<DOUBLE>, length_mm: DOUBLE>>,
  edges: ARRAY<ARRAY<INT>>>
"""
FINDING = "STRUCT<artery: STRING, stenosis_percent: DOUBLE, severity: STRING, severity_name: STRING>"
REPORT = f"training_labels STRUCT<arteries: MAP<STRING, {FINDING}>, segments: MAP<STRING, {FINDING}>, dominance: STRING, serial_number: STRING, gender: STRING>, report_data STRUCT<scan_date: STRING, study_quality: STRING>"


def model_catalog(configs: DataFrame) -> DataFrame:
    """Name and label of models that have a config (name, json) and a checkpoint; the label has type, loss and Dice, the last from the metrics or else the description."""
    rows = configs.filter("has_checkpoint and json is not null").withColumn("c", F.from_json("json", CONFIG))
    training = F.col("c.training_config").isNotNull()
    kind = F.coalesce(F.when(training, F.col("c.training_config.model_type")).otherwise(F.col("c.model_type")), F.lit("?"))
    loss = F.when(training, F.col("c.training_config.loss_type")).otherwise(F.col("c.loss_type"))
    told = F.regexp_extract(F.coalesce("c.description", F.lit("")), r"best_val_dice=([\d.]+)", 1)
    best = F.col("c.final_metrics.best_val_dice")
    dice = F.when(best.isNotNull(), F.format_string("Dice=%.4f", best)).when(told != "", F.concat(F.lit("Dice="), told))
    return rows.select("name", F.concat_ws("  |  ", "name", kind, F.nullif(loss, F.lit("")), dice).alias("label"))


def run_config(configs: DataFrame) -> DataFrame:
    """Preprocessing parameters, else those of the training config, each key with its default. The two sources are not mixed."""
    rows = configs.withColumn("c", F.from_json("json", CONFIG))
    pick = lambda key, default: F.coalesce(F.when(F.col("c.preprocessing.config.parameters").isNotNull(), F.col(f"c.preprocessing.config.parameters.{key}")).otherwise(F.col(f"c.training_config.{key}")), default)
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    clip = pick("zscore_clip", pair(-3.0, 3.0))
    return rows.select("name", pick("hu_min", F.lit(-50.0)).alias("hu_min"), pick("hu_max", F.lit(700.0)).alias("hu_max"), clip[0].alias("clip_low"), clip[1].alias("clip_high"), pick("target_spacing", F.array(F.lit(0.5)))[0].alias("spacing"), pick("target_orientation", F.lit("RAS")).alias("orientation"))


def split_membership(configs: DataFrame) -> DataFrame:
    """(name, case_id, split)."""
    s = F.from_json("json", CONFIG)["data_splits"]

    def named(split: str) -> Column:
        ids = F.coalesce(s[f"{split}_case_ids"], F.array().cast("array<string>"))
        return F.transform(ids, lambda x: F.struct(x.alias("case_id"), F.lit(split).alias("split")))

    return configs.select("name", F.inline(F.concat(*map(named, ("train", "val", "test")))))


def tree_nodes(trees: DataFrame) -> DataFrame:
    """(case_id, json) to rows of nodes."""
    rows = trees.select("case_id", F.explode(F.from_json("json", TREE)["vessel_tree"]["nodes"]).alias("key", "n"))
    return rows.select("case_id", F.col("key").cast("int").alias("node_id"), "n.position", "n.radius_mm", F.coalesce("n.is_bifurcation", F.lit(False)).alias("is_bifurcation"), F.coalesce("n.is_endpoint", F.lit(False)).alias("is_endpoint"))


def tree_points(trees: DataFrame) -> DataFrame:
    """(case_id, json) to points of segments, with the bifurcation flags of their first and last nodes. Documents are parsed once; flags are joined by node."""
    tree = F.from_json("json", TREE)["vessel_tree"]
    parsed = written(trees.select("case_id", tree["nodes"].alias("nodes"), tree["segments"].alias("segments")), "trees")
    rows = parsed.select("case_id", F.explode("segments").alias("key", "s")).withColumn("seg_id", F.col("key").cast("long"))
    nodes = parsed.select("case_id", F.explode("nodes").alias("key", "n")).filter("n.is_bifurcation").select("case_id", F.col("key").alias("node"))
    node = lambda at: F.try_element_at("s.node_ids", F.lit(at)).cast("string").alias("node")
    ends = rows.select("case_id", "seg_id", F.inline(F.array(F.struct(node(1), F.lit(True).alias("first")), F.struct(node(-1), F.lit(False).alias("first")))))
    flags = ends.join(nodes, ["case_id", "node"]).groupBy("case_id", "seg_id").agg(F.bool_or("first").alias("start_bif"), F.bool_or(~F.col("first")).alias("end_bif"))
    rows = rows.select("case_id", "seg_id", F.coalesce("s.length_mm", F.lit(0.0)).alias("length_mm"), F.posexplode(F.arrays_zip("s.arc_length_mm", "s.radii_mm", "s.centerline_points")).alias("idx", "p"))
    rows = rows.filter("p.radii_mm is not null").join(flags, ["case_id", "seg_id"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select("case_id", "seg_id", "idx", F.col("p.arc_length_mm").alias("arc_mm"), F.col("p.radii_mm").alias("radius_mm"), "length_mm", flag("start_bif"), flag("end_bif"), *(F.col("p.centerline_points")[k].alias(f"p{k}") for k in range(3)))


def report_findings(reports: DataFrame) -> DataFrame:
    """(case_id, json) to the reader's findings: those by segment, or by artery where there are none by segment."""
    rows = reports.withColumn("r", F.from_json("json", REPORT)).withColumn("t", F.col("r.training_labels"))
    found = F.when(F.coalesce(F.size("t.segments"), F.lit(0)) > 0, F.col("t.segments")).otherwise(F.col("t.arteries"))
    rows = rows.select("case_id", F.col("t.dominance").alias("dominance"), F.explode(found).alias("name", "f"))
    return rows.select("case_id", "dominance", "name", "f.artery", F.coalesce("f.stenosis_percent", F.lit(0.0)).alias("pct"), F.coalesce("f.severity_name", "f.severity").alias("severity"))


def write_chunks(voxels: DataFrame, path: str, size: int = 160, mode: str = "overwrite") -> None:
    """Voxels as Parquet, a folder a case; chunk columns c0, c1, c2 let a box read few row groups."""
    rows = voxels.withColumns({f"c{k}": F.floor(F.col(f"a{k}") / size).cast("int") for k in range(3)})
    rows.repartition("case_id", "c0", "c1", "c2").sortWithinPartitions("case_id", "c0", "c1", "c2", "a0", "a1", "a2").write.mode(mode).partitionBy("case_id").parquet(path)


def read_chunks(spark: SparkSession, path: str, box: dict[str, tuple[int, int]] | None = None, size: int = 160) -> DataFrame:
    """Voxels of the box {axis: (first, last)}; chunk predicates reach the scan."""
    rows = spark.read.parquet(path)
    for axis, (low, high) in (box or {}).items():
        k = axis[1:]
        rows = rows.filter(F.col(f"c{k}").between(low // size, high // size) & F.col(axis).between(low, high))
    return rows.drop("c0", "c1", "c2")


def write_results(rows: DataFrame, path: str, kind: str = "json", mode: str = "overwrite") -> None:
    """Results as JSON or Parquet, a folder a case."""
    rows.write.mode(mode).partitionBy("case_id").format(kind).save(path)


def as_json(*columns: str) -> Column:
    """Columns of a row as one JSON document."""
    return F.to_json(F.struct(*columns))
