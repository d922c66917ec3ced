"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, free_name, maybe_broadcast, written

#: Columns the operator adds.
ADDED = ("keep_id", "group_size", "kept", "full_hash")


def progressive_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, carry: list[str] | None = None, broadcast_rows: int = 100_000, prefix: str = "") -> DataFrame:
    """Every row of docs (columns `carry`, else all) with keep_id, group_size, kept and full_hash, their names after `prefix`; columns of docs by such names are left out.

    Rows are equal when their whole texts are identical; null counts as empty. Of equal rows the one with the largest id
    stays (null ids count as smallest; of rows that share that id too, exactly one is marked kept). group_size counts
    all rows of the group. full_hash is null for rows that an earlier, cheaper level already told apart.

    Level 1 counts rows by length, level 2 by a hash of the prefix among lengths that occur twice, both on a narrow key
    table; only rows whose (length, prefix) occurs twice have their whole text hashed. Equal keys are counted before the
    shuffle, and groups are only joined back as one row each against a written table, where Spark splits hot keys.
    """
    spark = docs.sparkSession
    carry = [c for c in carry or docs.columns if c.lower() not in {prefix + a for a in ADDED}]
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, start = F.octet_length(text).cast("long"), F.xxhash64(F.substring(text, 1, prefix_chars))
    keys = written(docs.select(size.alias("__len"), start.alias("__pre")), "keys")
    lengths = written(keys.groupBy("__len").count().filter("count > 1").select("__len"), "lengths")
    n = lengths.count()
    level2 = keys.join(maybe_broadcast(lengths, n, broadcast_rows), "__len", "left_semi")
    groups = written(level2.groupBy("__len", "__pre").count().filter("count > 1").select("__len", "__pre", F.lit(True).alias("__again")), "prefixes")
    n = groups.count()
    drop_written(spark, keys, lengths)

    # the caller's columns travel in one struct, so that their names can't clash with the operator's
    rows = docs.select(F.struct(*(docs[c] for c in carry), F.lit(0).alias(free_name(carry, "end"))).alias("__own"), F.col(id_col).cast("long").alias("__id"), text.alias("__text"), size.alias("__len"), start.alias("__pre"))
    rows = rows.join(maybe_broadcast(groups, n, broadcast_rows), ["__len", "__pre"], "left")
    rows = rows.select("__own", "__id", F.when(F.col("__again"), F.sha2("__text", 256)).alias("__hash"))
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    rank = F.struct(F.col("__id").isNotNull().alias("known"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    best = rows.filter("__hash is not null").groupBy("__hash").agg(F.max(rank).alias("__best"), F.count("*").alias("__size"))
    best = written(best.select("__hash", F.col("__best.id").alias("__keep_id"), F.col("__best.row").alias("__keep"), "__size"), "best")
    added = lambda *columns: [c.alias(prefix + name) for c, name in zip(columns, ADDED, strict=True)]
    own = [F.col("__own")[c].alias(c) for c in carry]
    again = rows.filter("__hash is not null").join(best, "__hash").select(*own, *added(F.col("__keep_id"), F.col("__size"), F.col("__row") == F.col("__keep"), F.col("__hash")))
    alone = rows.filter("__hash is null").select(*own, *added(F.col("__id"), F.lit(1).cast("long"), F.lit(True), F.col("__hash")))
    return again.unionByName(alone)
