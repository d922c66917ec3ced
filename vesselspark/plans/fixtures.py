"""The driver's tables as domain tables, each in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import size_by_memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    size_by_memory(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centerline points: a segment for each user of `events`, in time order."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    by = Window.partitionBy("user_id")
    rows = events.withColumn("idx", F.row_number().over(by.orderBy("ts", "event_id")) - 1).withColumn("n", F.count("*").over(by))
    return rows.select(
        (F.col("user_id") % 10).alias("case_id"), F.col("user_id").alias("seg_id"), "idx", (F.col("idx") * 0.6).alias("arc_mm"), ((F.col("n") - 1) * 0.6).alias("length_mm"),
        (0.15 + 0.15 * (F.col("user_id") % 5) + F.least("value", F.lit(120.0)) / 80).alias("radius_mm"),
        (F.col("user_id") % 2 == 0).alias("start_bif"), (F.col("user_id") % 3 == 0).alias("end_bif"),
        F.col("idx").cast("double").alias("p0"), (F.col("user_id") % 8).cast("double").alias("p1"), F.lit(0.0).alias("p2"),
    )


POINTS = """
points AS (SELECT user_id % 10 AS case_id, user_id AS seg_id, idx, idx * 0.6::DOUBLE AS arc_mm, (n - 1) * 0.6::DOUBLE AS length_mm,
    0.15::DOUBLE + 0.15::DOUBLE * (user_id % 5) + least(value, 120.0::DOUBLE) / 80 AS radius_mm, user_id % 2 = 0 AS start_bif, user_id % 3 = 0 AS end_bif,
    idx::DOUBLE AS p0, (user_id % 8)::DOUBLE AS p1, 0.0::DOUBLE AS p2
  FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events))
"""


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice headers: a case for each supplier of `lineitem`, two series in each; every column breaks ties of the file name."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    rows = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    name = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.date_format("l_shipdate", "yyyyMMdd"))
    return rows.select(
        F.col("l_suppkey").alias("case_id"), F.concat(F.lit("f"), name, F.when(F.col("l_linenumber") % 7 == 0, F.lit("")).otherwise(F.lit(".dcm"))).alias("filepath"),
        F.when(F.col("l_orderkey") % 97 == 0, F.lit(None)).otherwise(F.col("l_partkey") % 2).cast("int").alias("series_number"),
        F.concat_ws(" ", F.when(F.col("p_size") % 5 == 0, "75% body").when(F.col("p_size") % 5 == 1, "cardiac 70%").when(F.col("p_size") % 5 == 2, "coronary segment"), "p_type", "p_name").alias("series_description"),
        F.lit("CT").alias("modality"), F.lit(512).alias("rows"), F.lit(512).alias("cols"), (0.4 + 10 * F.col("l_discount")).alias("slice_thickness"),
        F.array(0.3 + F.col("p_size") / 100, 0.3 + F.col("p_size") / 100).alias("pixel_spacing"), F.col("l_linenumber").alias("instance_number"),
        F.when(F.col("l_orderkey") % 89 == 0, F.lit(None)).otherwise(F.col("l_quantity") + F.col("l_linenumber") / 10 + F.when(F.col("l_returnflag") == "R", 100.0).otherwise(0.0)).alias("z_position"),
        F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.col("p_size") * 8.0).cast("double").alias("reconstruction_diameter"),
    )


SLICES = """
slices AS (SELECT l_suppkey AS case_id, 'f' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 100)::BIGINT, strftime(l_shipdate, '%Y%m%d'))
      || CASE WHEN l_linenumber % 7 = 0 THEN '' ELSE '.dcm' END AS filepath,
    CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_partkey % 2 END::INT AS series_number,
    concat_ws(' ', CASE p_size % 5 WHEN 0 THEN '75% body' WHEN 1 THEN 'cardiac 70%' WHEN 2 THEN 'coronary segment' END, p_type, p_name) AS series_description,
    'CT' AS modality, 512 AS rows, 512 AS cols, 0.4::DOUBLE + 10 * l_discount AS slice_thickness, [0.3::DOUBLE + p_size / 100.0::DOUBLE, 0.3::DOUBLE + p_size / 100.0::DOUBLE] AS pixel_spacing,
    l_linenumber AS instance_number,
    CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE l_quantity + l_linenumber / 10.0::DOUBLE + CASE l_returnflag WHEN 'R' THEN 100.0 ELSE 0.0 END::DOUBLE END AS z_position,
    CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 8.0::DOUBLE END AS reconstruction_diameter
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense volumes: a case for each label of `embeddings`, its vectors stacked as 8 x 8 slices."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("case_id"), "vec_id", "embedding")
    a0 = F.row_number().over(Window.partitionBy("case_id").orderBy("vec_id")) - 1
    # numbered first: a window beside an explode would number the exploded rows
    # dealt again by slice, or the voxels of a case would all be made in the task that numbered its slices
    rows = rows.withColumn("a0", a0).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "case_id", "a0").select("case_id", "a0", F.posexplode("embedding").alias("pos", "value"))
    return rows.select("case_id", "a0", F.floor(F.col("pos") / 8).cast("int").alias("a1"), (F.col("pos") % 8).alias("a2"), F.col("value").cast("double").alias("value"))


VOXELS = """
voxels AS (SELECT case_id, a0, pos // 8 AS a1, pos % 8 AS a2, value FROM (
    SELECT label AS case_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS a0, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings))
"""


def masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prediction, truth, sparse mask) as foreground rows."""
    rows = voxels(spark, sf_dir)
    key = ["case_id", "a0", "a1", "a2"]
    truth = F.col("value") > 0.10 + 0.10 * ((F.col("a0") + F.col("a1") + F.col("a2")) % 2)
    return rows.filter("value > 0.15").select(key), rows.filter(truth).select(key), rows.filter("value > 0.25").select(key)


MASKS = """
pred AS (SELECT case_id, a0, a1, a2 FROM voxels WHERE value > 0.15),
truth AS (SELECT case_id, a0, a1, a2 FROM voxels WHERE value > 0.10::DOUBLE + 0.10::DOUBLE * ((a0 + a1 + a2) % 2)),
sparse AS (SELECT case_id, a0, a1, a2 FROM voxels WHERE value > 0.25)
"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded findings of reader and pipeline: a case for each customer of `orders`, an artery for each priority."""
    rows = table(spark, sf_dir, "orders")
    artery = F.element_at(F.array(*map(F.lit, ("LM", "proximal LAD", "LCX", "RCA", "D1_prox"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return rows.select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("finding_id"), artery.alias("artery"), (F.floor("o_totalprice") % 100).cast("double").alias("gt_pct"),
        ((F.floor("o_totalprice") + 13 * (F.col("o_orderkey") % 7)) % 100).cast("double").alias("pred_pct"), (1 + F.col("o_orderkey") % 9 / 10).alias("ref_radius"), (F.col("o_custkey") % 3).alias("model"),
    )


GRADED = """
graded AS (SELECT o_custkey AS case_id, o_orderkey AS finding_id, ['LM', 'proximal LAD', 'LCX', 'RCA', 'D1_prox'][substr(o_orderpriority, 1, 1)::INT] AS artery,
    (floor(o_totalprice)::BIGINT % 100)::DOUBLE AS gt_pct, ((floor(o_totalprice)::BIGINT + 13 * (o_orderkey % 7)) % 100)::DOUBLE AS pred_pct, 1 + o_orderkey % 9 / 10.0::DOUBLE AS ref_radius, o_custkey % 3 AS model
  FROM orders)
"""


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select
