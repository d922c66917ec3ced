"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import free_name, maybe_broadcast, written

#: Columns the operator adds.
ADDED = ("copy", "n_copies", "shuffle_key")
#: A document with more copies than that has them made by several tasks.
MANY = 1024


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by '|'; null counts as 'null'."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def most_copies(mean: Column) -> Column:
    """Ten deviations past the mean of a Poisson X: no draw goes further."""
    return F.ceil(mean + 10 * F.sqrt(mean) + 20)


def poisson_draw(mean: Column, u: Column) -> Column:
    """How many of P(X <= 0), P(X <= 1), ... for a Poisson X are u or less. It takes most_copies(mean) steps, and nothing is kept of them. Logs keep large means from underflowing."""
    start = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("total"), (F.exp(-mean) <= u).cast("long").alias("n"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(mean) - F.log(k.cast("double"))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), (acc["n"] + (total <= u).cast("long")).alias("n"))

    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), most_copies(mean)), start, step, lambda a: a["n"])).otherwise(F.lit(0).cast("long"))


def rates(docs: DataFrame, weights: dict[str, float], rest: float = 1.0, source_col: str = "source", epochs: float = 1.0) -> DataFrame:
    """(source, rate): the mean number of copies that brings each source to its share of epochs x all rows. Sources that weights doesn't name get `rest` each."""
    name = F.coalesce(F.col(source_col), F.lit(""))
    counts = docs.groupBy(name.alias("__source")).agg(F.count("*").alias("n"))
    weight = F.lit(float(rest))
    for source, w in weights.items():
        weight = F.when(F.col("__source") == source, F.lit(float(w))).otherwise(weight)
    counts = written(counts.withColumn("w", weight), "counts")
    all_n, all_w = counts.agg(F.sum("n"), F.sum("w")).first()
    mean = F.lit(float(epochs)) * F.col("w") * F.lit(float(all_n or 0)) / (F.lit(float(all_w or 1) or 1.0) * F.col("n"))
    return written(counts.select("__source", mean.alias("rate")), "rates")


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, rest: float = 1.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", epochs: float = 1.0, prefix: str = "") -> DataFrame:
    """Every document repeated a Poisson number of times, with its copy number (from 0), n_copies and the shuffle key that orders the result.

    The mean is the rate of the document's source (see rates()); null sources form one source of their own, the empty
    one. The draw inverts the distribution at a number hashed from seed and id, so it is the same on every run and
    partitioning; rows that share an id share the draw, and null ids too. Documents that draw 0 are left out. The
    result is range-partitioned and sorted by the key, a hash of seed, id and copy: a global shuffle. The rates table
    has a row for each source; it is broadcast only while that is at most 10,000 rows. Where a source is so rare that its
    documents may have more than MANY copies, those copies are dealt to tasks in parts. `prefix` stands before the
    names of the added columns; a column of docs by such a name is left out.
    """
    table = rates(docs, weights or {}, rest, source_col, epochs)
    top = table.agg(F.max(most_copies(F.col("rate")))).first()[0] or 0
    table = maybe_broadcast(table.withColumnRenamed("rate", "__rate"), table.count(), 10_000)
    copy, n_copies, shuffle_key = (prefix + c for c in ADDED)
    kept = [c for c in docs.columns if c.lower() not in (copy, n_copies, shuffle_key)]
    # the caller's columns travel in one struct, so that their names can't clash with the operator's
    own = F.struct(*(docs[c] for c in kept), F.lit(0).alias(free_name(kept, "end"))).alias("__own")
    rows = docs.select(own, F.col(id_col).cast("string").alias("__id"), F.coalesce(F.col(source_col), F.lit("")).alias("__source"), unit_hash(F.lit(seed), F.col(id_col)).alias("__u")).join(table, "__source")
    rows = rows.withColumn("__n", poisson_draw(F.col("__rate"), F.col("__u"))).filter("__n > 0")
    zero, last = F.lit(0).cast("long"), F.col("__n") - 1
    if top > MANY:
        dealt = rows.filter(F.col("__n") > MANY).withColumn("__part", F.explode(F.sequence(zero, F.floor(last / MANY)))).repartition("__part", "__u")
        dealt = dealt.withColumn("__copy", F.explode(F.sequence(F.col("__part") * MANY, F.least(last, (F.col("__part") + 1) * MANY - 1)))).drop("__part")
        rows = rows.filter(F.col("__n") <= MANY).withColumn("__copy", F.explode(F.sequence(zero, last))).unionByName(dealt)
    else:
        rows = rows.withColumn("__copy", F.explode(F.sequence(zero, last)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("__id", F.lit("null")), F.col("__copy").cast("string")))
    rows = rows.select(*(F.col("__own")[c].alias(c) for c in kept), F.col("__copy").alias(copy), F.col("__n").alias(n_copies), key.alias(shuffle_key))
    return rows.repartitionByRange(shuffle_key).sortWithinPartitions(shuffle_key)
