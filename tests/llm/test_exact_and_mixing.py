import math
from collections import Counter, defaultdict

import pytest
from compare import compare
from pyspark.sql import functions as F

from vesselspark.llm import mixing, queries
from vesselspark.llm.exact import progressive_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op8_poisson_mix"])
def test_sql(spark, name):
    assert compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF) > 0


def test_dedup_odd(spark, odd_docs, no_docs):
    rows = progressive_dedup(odd_docs.withColumn("kept", odd_docs.n_chars)).collect()
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[r.text or ""].append(r.doc_id)
    assert len(rows) == odd_docs.count()
    assert sum(r.kept for r in rows) == len(groups)
    for r in rows:
        ids = groups[r.text or ""]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert progressive_dedup(no_docs).count() == 0


def test_dedup_without_broadcast(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {(r.doc_id, r.kept, r.group_size) for r in progressive_dedup(docs).collect()}
    assert a == {(r.doc_id, r.kept, r.group_size) for r in progressive_dedup(docs, broadcast_rows=0, prefix_chars=4).collect()}


def test_mix_odd(spark, odd_docs, no_docs):
    rows = mixing.poisson_mix(odd_docs, {"a": 5.0}, epochs=40.0).collect()
    assert {r.source for r in rows} == {r.source for r in odd_docs.collect()}
    for (i, text), n in Counter((r.doc_id, r.text) for r in rows).items():
        times = sum((r.doc_id, r.text) == (i, text) for r in odd_docs.collect())
        assert n == times * next(r.n_copies for r in rows if (r.doc_id, r.text) == (i, text))
    assert mixing.poisson_mix(no_docs).count() == 0


def test_mix_reaches_weights(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', if(id % 100 = 1, 'b', 'c')) as source")
    got = {r.source: r["count"] for r in mixing.poisson_mix(docs, {"a": 2.0, "b": 1.0, "c": 1.0}).groupBy("source").count().collect()}
    for source, share in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
        assert abs(got[source] / 40_000 - share) < 0.02


@pytest.mark.parametrize("mean", [0.4, 30.0, 5000.0, 1e6])
def test_poisson_draws(spark, mean):
    """The draw is the inverse of the distribution, at means up to a million."""
    got = spark.createDataFrame([(k, (k + 0.5) / 40) for k in range(40)], "k int, u double").select("u", mixing.poisson_draw(F.lit(mean), F.col("u")).alias("n")).collect()
    for r in got:
        below, at = (math.fsum(math.exp(-mean + j * math.log(mean) - math.lgamma(j + 1)) for j in range(max(0, int(mean - 12 * mean**0.5) - 20), r.n + d)) for d in (0, 1))
        assert below <= r.u + 1e-6 and at > r.u - 1e-6


def test_rare_source(spark):
    """One row whose source must make up half of all: its copies come from many tasks, none missing."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "rare").otherwise("common").alias("source"), F.lit("text").alias("text"))
    rows = mixing.poisson_mix(docs, {"rare": 1.0, "common": 1.0}).filter("doc_id = 0").collect()
    assert len(rows) == rows[0].n_copies > 2 * mixing.MANY and sorted(r.copy for r in rows) == list(range(len(rows)))
