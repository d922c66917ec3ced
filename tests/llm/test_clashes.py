"""Columns of a caller whose names are the operators' own, and ids that say nothing."""

import re
from functools import partial
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vesselspark import llm
from vesselspark.llm import bpe, exact, mixing, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with a column of each name that the operators use inside."""
    sources = [*Path(llm.__file__).parent.glob("*.py"), Path(corpus_pipeline.__file__)]
    names = {n for p in sources for n in re.findall(r'"(__?[a-z0-9_]+)"', p.read_text())} | {"__own_keep", "__own_kept", "__own_copy", "__own_n_copies", "hash", "pattern", "text_", "end", "end_"}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    assert len(names) > 15
    return docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in sorted(names)))


def same(rows, docs):
    """The documents' own columns still say what they said."""
    own = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    rows = rows.select("doc_id", *own).collect()
    assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in own)


def test_operators(spark, crowded):
    same(exact.progressive_dedup(crowded), crowded)
    same(mixing.poisson_mix(crowded), crowded)
    same(quality.classify_quality(crowded), crowded)
    same(bpe.encode_documents(crowded, partial(bpe.from_ranks, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), crowded)


def test_stages(spark, crowded):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, crowded, SF)
        assert out.columns == crowded.columns
        same(out, crowded)


@pytest.fixture(scope="module")
def kept_by_own_ids(documents):
    return {r.doc_id for r in quality.classify_quality(documents).filter("keep").collect()}


@pytest.mark.parametrize("ids", ["null", "1", "doc_id % 10", "if(doc_id % 2 = 0, -1, doc_id)", "if(doc_id % 10 = 0, -1, doc_id)"])
def test_quality_needs_no_ids(documents, kept_by_own_ids, ids):
    """Of the documents kept with ids of their own, none goes and none comes where ids repeat or lack."""
    keyed = documents.withColumn("own", F.col("doc_id"))
    got = {r.own for r in quality.classify_quality(keyed.withColumn("doc_id", F.expr(ids).cast("long"))).filter("keep").collect()}
    assert 0.5 * documents.count() < len(kept_by_own_ids) and got == kept_by_own_ids


def test_quality_hot_text(documents):
    """A text that makes up a third of the rows is one text of the sample and scores as each of its copies."""
    one = documents.filter("length(text) > 200").orderBy("doc_id").limit(1)
    many = documents.unionByName(one.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("again"))
    rows = quality.classify_quality(many)
    own = rows.filter(F.col("doc_id") == one.first().doc_id).agg(F.count_distinct("score"), F.count("*")).first()
    assert own[0] == 1 and own[1] == 501
    assert rows.filter("keep").count() > 0.5 * documents.count()
