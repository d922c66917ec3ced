import hashlib
import random
import re

import pytest

from vesselspark.llm import queries
from vesselspark.llm.substring import remove_repeats

SF = "/root/testdata/sf0.001"


def brute(docs, window=20):
    """(id, words, removed flags) of each row; a window is repeated if it starts at a smaller (id, word) anywhere."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] != (i, k):
                gone[k : k + window] = [True] * window
        out.append((i, words, gone))
    return out


def check(got, docs, window=20):
    want = sorted((i, len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for i, w, g in brute(docs, window))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    for r in got:
        assert sum(s.length for s in r.spans) == r.n_removed


def test_op2(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for i, w, g in brute(docs))
    got = sorted(tuple(r)[:4] for r in queries.op2_substring_dedup(spark, SF).collect())
    assert got == want
    assert sum(r[2] for r in got) > 100


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    passage = [rng.choice("abcdefg") for _ in range(60)]
    docs = []
    for i in range(60):
        words = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            a, at = rng.randrange(40), rng.randrange(len(words) + 1)
            words[at:at] = passage[a : a + rng.randrange(15, 30)]
        docs.append((rng.randrange(100), rng.choice([" ", "\n", " \t "]).join(words)))
    docs = list({i: (i, t) for i, t in docs}.values()) + [(1000, "w " * 50), (1001, None), (1002, " ".join(passage * 2)), (1003, "")]
    check(remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect(), docs)


def test_odd(spark, odd_docs, no_docs):
    rows = remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {(r.doc_id, r.n_words): r for r in rows}
    # rows that share an id count as one document, so a repeated row loses nothing to its twin; what repeats inside it goes
    assert by[(1, 30)].n_removed == 20 and by[(2, 30)].n_removed == 30
    assert remove_repeats(no_docs).count() == 0


def test_hot_line(spark):
    """A line that most texts carry, at odd places, stuttered texts, and copies under one id."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    line = [word() for _ in range(33)]
    docs = []
    for k in range(300):
        words = [word() for _ in range(rng.randrange(40))]
        if k % 3:
            words += line + [word() for _ in range(rng.randrange(30))]
        if k % 50 == 7:
            words += ["again"] * 70
        docs.append((k, " ".join(words)))
    docs += [(5, docs[5][1])]
    check(remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect(), docs)
