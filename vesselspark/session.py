"""Session helpers: the shared folder, written intermediate tables and checked broadcasts."""

from __future__ import annotations

import gc
import math
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/vesselspark/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str = "table", codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read back. It cuts the lineage, and unlike a local checkpoint it survives lost executors."""
    spark, schema, path = df.sparkSession, df.schema, new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_written(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that written() made and that no later job reads."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of DataFrames that are out of use; else they stay until the driver happens to collect
    its garbage. The first round lets go of the Python side's handles, the second of what only they held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def free_name(columns: list[str], name: str) -> str:
    """A name like `name` that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes in memory for a byte of a file: written voxel and list tables take 30 to 50 times their compressed columns.
IN_MEMORY = 40


def size_by_memory(spark: SparkSession) -> None:
    """Has the planner judge files by about what they take in memory, so that no large table becomes a broadcast because it compresses well; sides
    that are measured small while a query runs are still broadcast. A session with a larger factor keeps it."""
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) < IN_MEMORY:
        spark.conf.set(name, str(float(IN_MEMORY)))


def maybe_broadcast(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A broadcast hint only if the counted rows are within the bound; else the planner's shuffled join."""
    return F.broadcast(df) if rows <= most else df


def parts_for(spark: SparkSession, amount: float, per_part: float, least: int | None = None) -> int:
    """Number of buckets so that each holds about per_part; it grows with the data and has no upper bound."""
    least = least or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(amount / per_part))


@contextmanager
def keyed_by_part(spark: SparkSession):
    """What runs in here may join tables that are dealt by a part of the join's key as they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
