"""A corpus pipeline over `documents`: quality, exact copies, near copies, mixing, tokens."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselspark.llm import bpe, cpsjoin, exact, mixing, quality
from vesselspark.llm.queries import WEIGHTS
from vesselspark.session import maybe_broadcast, new_path, written


def apart(docs: DataFrame) -> str:
    """What goes before the names of columns that an operator adds, so that the documents' own columns stay as they are: no name of theirs begins so."""
    prefix = "__own_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. An empty table stays empty; null texts are judged as empty ones."""
    own = apart(docs)
    return quality.classify_quality(docs, prefix=own).filter(f"{own}keep").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id; null texts are one group with empty ones."""
    own = apart(docs)
    return exact.progressive_dedup(docs, prefix=own).filter(f"{own}kept").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word Jaccard of 0.8 or more, that with the smallest doc_id. Rows without a doc_id stay.

    A doc_id goes if none of its rows carries its group's smallest id, so of rows that share an id all stay or all go.
    """
    groups = cpsjoin.jaccard_groups(docs.select("doc_id", "text"))
    gone = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("class_id")).alias("stays")).filter("not stays").select("doc_id")
    gone = written(gone, "near_copies")
    return docs.join(maybe_broadcast(gone, gone.count(), 500_000), "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources reach their target weights, in a global random order.

    Null sources are one source; rows that share a doc_id, or have none, share their number of copies. An empty table stays empty.
    """
    return mixing.poisson_mix(docs, WEIGHTS, prefix=apart(docs)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each row; null texts have no ids."""
    load = partial(bpe.from_ranks, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs, load, ("n_tokens", "ids"), keep=["doc_id", "lang", "source"])


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mix", mixed), ("encode", encoded)]
#: EM, a trained scorer, MinHash recursion and BPE have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
