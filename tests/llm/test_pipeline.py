from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql.functions import concat, lit
from test_join import brute

from vesselspark.llm import bpe, mixing, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.good_quality(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert all(i in ids for i, q in labels.items() if q == 1) and sum(i in ids for i, q in labels.items() if q == 0) <= 1

    once = corpus_pipeline.without_copies(spark, docs, SF)
    groups = defaultdict(list)
    for i, r in before.items():
        groups[r.text].append(i)
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} == {max(g) for g in groups.values()}

    near = corpus_pipeline.without_near_copies(spark, docs, SF)
    want = brute([(i, " ".join(r.text.split())) for i, r in before.items()])
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {i for i, (c, _) in want.items() if i == c}

    mix = corpus_pipeline.mixed(spark, docs, SF).collect()
    copies = {r.doc_id: r.n_copies for r in mixing.poisson_mix(docs, queries.WEIGHTS).collect()}
    assert Counter(r.doc_id for r in mix) == copies

    tokens = corpus_pipeline.encoded(spark, docs, SF).collect()
    plain = bpe.from_ranks(queries.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert len(tokens) == len(before)
    assert all(plain.decode(plain.encode([before[r.doc_id].text])[0]) == before[r.doc_id].text.encode() and r.n_tokens == len(r.ids) for r in tokens)


def test_odd_rows(spark, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
    before = Counter(odd_docs.collect())
    rows = lambda name: Counter(dict(corpus_pipeline.STAGES)[name](spark, odd_docs, SF).collect())
    # every row that a filtering stage keeps is one of its input; rows of one text share its verdict, and null ones that of empty ones
    kept = rows("quality")
    same = lambda text: {kept[r] == n for r, n in before.items() if (r.text or "") == text}
    assert kept <= before and all(len(same(r.text or "")) == 1 for r in before)
    once = rows("exact_dedup")
    assert once <= before and {r.text or "" for r in once} == {r.text or "" for r in before} and sum(once.values()) == len({r.text or "" for r in before})
    assert {r.doc_id for r in once if r.text and r.text.startswith("one two")} == {2}
    near = rows("near_dedup")
    assert near == Counter({r: n for r, n in before.items() if r.doc_id != 2})
    mix = rows("mix")
    assert set(mix) <= set(before)
    tokens = dict(corpus_pipeline.STAGES)["encode"](spark, odd_docs, SF).collect()
    assert len(tokens) == sum(before.values()) and all(r.n_tokens == len(r.ids) for r in tokens) and sum(r.n_tokens == 0 for r in tokens) == sum(n for r, n in before.items() if not r.text)


def test_clashing_columns(spark):
    """Columns of the documents that are called like what operators add come through with their own values."""
    names = ["kept", "keep_id", "group_size", "full_hash", "score", "posterior", "Keep", "copy", "n_copies", "shuffle_key", "rate"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in names:
        docs = docs.withColumn(name, concat(lit(f"{name} of "), docs.doc_id.cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF)
        assert rows.columns == docs.columns and rows.dtypes == docs.dtypes, name
        got = rows.collect()
        assert got and all(r[n] == f"{n} of {r.doc_id}" for r in got for n in names), name


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    got = rows.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    groups = defaultdict(list)
    for i, r in docs.items():
        groups[r.text].append(i)
    # no rejected and no exact copy is left, sources and languages are those of the documents, ids decode to the texts
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 0}
    assert {r.doc_id for r in got} <= {max(g) for g in groups.values()} and len({r.doc_id for r in got} & bad) <= 1
    plain = bpe.from_ranks(queries.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert all((docs[r.doc_id].lang, docs[r.doc_id].source) == (r.lang, r.source) for r in got)
    assert all(b"".join(plain.bytes[k] for k in r.ids).decode() == docs[r.doc_id].text for r in got)
    assert len({r.doc_id for r in got}) > 50
