import random

import numpy as np
import pytest

from vesselspark.llm import queries
from vesselspark.llm.cpsjoin import Join, jaccard_groups, miss_chance, runs_for, signatures

SF = "/root/testdata/sf0.001"


def brute(docs, threshold=0.8, ngram=5):
    """{id: (class, links)} by comparing all distinct sets."""
    sets, of = {}, {}
    for i, text in docs:
        words = (text or "").split(" ") if text and "\n" not in text else (text or "").split()
        words = [w for w in words if w]
        items = frozenset(tuple(words[k : k + ngram]) for k in range(max(1, len(words) - ngram + 1))) if words else None
        if items:
            sets.setdefault(items, []).append(i)
        of[i] = items
    keys = list(sets)
    parent, links = list(range(len(keys))), [0] * len(keys)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(keys)):
        for y in range(x):
            small, large = sorted((len(keys[x]), len(keys[y])))
            if small >= threshold * large:
                both = len(keys[x] & keys[y])
                if both >= threshold * (small + large - both) - 1e-9:
                    links[x] += 1
                    links[y] += 1
                    parent[root(x)] = root(y)
    least = {}
    for x, items in enumerate(keys):
        least[root(x)] = min(least.get(root(x), 10**9), *sets[items])
    at = {items: x for x, items in enumerate(keys)}
    return {i: (i, 0) if items is None else (least[root(at[items])], links[at[items]]) for i, items in of.items()}


def as_map(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def test_op4(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert as_map(queries.op4_ngram_join(spark, SF)) == brute([(i, " ".join(t.split())) for i, t in docs])


@pytest.mark.parametrize("limit", [4, 64])
def test_groups_and_common_passage(spark, limit):
    """Near copies in numbers beyond the bucket limit, under a passage that all documents share."""
    rng = random.Random(limit)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(15)]
    docs = []
    for _ in range(6):
        base = [word() for _ in range(90)]
        for _ in range(rng.choice([1, 2, 40])):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = word()
            docs.append((len(docs), " ".join(passage + words)))
    docs += [(len(docs) + k, " ".join(passage + [word() for _ in range(60)])) for k in range(80)]
    docs += [(1000, docs[0][1]), (1001, ""), (1002, "two words"), (1003, "two words"), (1004, None)]
    got = as_map(jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"), limit=limit))
    assert got == brute(docs)


@pytest.mark.parametrize("limit", [4096, 300])
def test_large_groups(spark, limit):
    """A base with 900 copies at all distances, 500 copies of one word's difference and unrelated texts, in one task and in many."""
    rng = np.random.default_rng(limit)
    word = lambda: f"w{rng.integers(10**9)}"
    bases, docs = [[word() for _ in range(150)] for _ in range(2)], []
    for base, n, most in ((bases[0], 900, 14), (bases[1], 500, 2)):
        for _ in range(n):
            words = list(base)
            for _ in range(rng.integers(most)):
                words[rng.integers(len(words))] = word()
            docs.append(words)
    docs += [bases[0][:20] + [word() for _ in range(rng.integers(20, 200))] for _ in range(600)]
    docs = [(int(k), " ".join(docs[at])) for k, at in enumerate(rng.permutation(len(docs)))]
    sets, of = {}, []
    for _, text in docs:
        words = text.split()
        of.append(sets.setdefault(frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)), len(sets)))
    number = {}
    for items in sets:
        for x in items:
            number.setdefault(x, len(number))
    matrix = np.zeros((len(sets), len(number)), np.float32)
    for row, items in enumerate(sets):
        matrix[row, [number[x] for x in items]] = 1
    both, size = matrix @ matrix.T, matrix.sum(1)
    linked = both >= 0.8 * (size[:, None] + size - both) - 1e-6
    np.fill_diagonal(linked, False)
    label = np.arange(len(sets))
    while True:
        new = np.minimum(label, np.where(linked, label, len(sets)).min(1))
        if (new == label).all():
            break
        label = new
    least = {}
    for (i, _), row in zip(docs, of, strict=True):
        least.setdefault(label[row], i)
    got = {r.doc_id: r for r in jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"), limit=limit).collect()}
    assert {i: r.class_id for i, r in got.items()} == {i: least[label[row]] for (i, _), row in zip(docs, of, strict=True)}
    want = linked.sum(1)
    found = [got[i].n_links for i, _ in docs]
    assert all(f <= want[row] for f, row in zip(found, of, strict=True))
    assert sum(found) >= 0.999 * sum(want[row] for row in of)


def test_odd(spark, odd_docs, no_docs):
    rows = jaccard_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.doc_id, r.class_id) for r in rows if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    assert {r.class_id for r in rows if r.doc_id is None} == {None}
    assert jaccard_groups(no_docs).count() == 0


def test_runs():
    assert runs_for(0.9) < runs_for(0.99) < runs_for(0.999)


def test_recall_of_deep_splits(spark):
    """Pairs at exactly 0.8 whose shared tokens are all common, so that nearly every bucket is split four or five times; none counts as dense."""
    rng = np.random.default_rng(3)
    pool, sets = rng.integers(1, 2**63, 600, dtype=np.uint64), []
    for _ in range(1500):
        order = rng.permutation(600)
        sets += [order[:225], np.r_[order[:200], order[225:250]]]
    sig = signatures(pool[np.concatenate(sets)], np.arange(len(sets)) * 225)
    reps = spark.createDataFrame([(k, 225, bytearray(s.tobytes())) for k, s in enumerate(sig)], "c long, n long, sig binary")
    join = Join(0.8, 0.999, 4, 5)
    join.similar_to_most = lambda rows: rows.filter("false").select("path", "c")
    pairs = join.candidates(reps, None)[0]
    assert pairs.filter("a % 2 = 0 and b = a + 1").count() >= 1500 - 4


def test_chance_of_a_miss():
    for threshold, recall, depth in [(0.8, 0.999, 5), (0.8, 0.999, 8), (0.5, 0.99, 5), (0.8, 0.99999, 5)]:
        join = Join(threshold, recall, 64, depth)
        assert miss_chance(threshold, depth, len(join.seeds), join.repeats, join.least) <= 1 - recall
