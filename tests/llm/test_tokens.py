import base64
import hashlib
import zlib
from functools import partial

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vesselspark.llm import bpe, dac
from vesselspark.llm.queries import op1_byte_bpe, op3_token_files
from vesselspark.session import new_path

RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab '\n\t1é.\U0001f600", max_size=60), max_size=5))
def test_encode_as_plain_libraries(plain, texts):
    mine = [x.tolist() for x in bpe.from_ranks(RANKS).encode(texts)]
    assert mine == [plain.encode_ordinary(t) for t in texts]
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    assert [x.tolist() for x in bpe.from_json(JSON).encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for t, ids in zip(texts, bpe.from_ranks(RANKS).encode(texts), strict=True):
        assert bpe.from_ranks(RANKS).decode(ids) == t.encode()
        assert "".join(bpe.decode_pieces(bpe.from_ranks(RANKS), [ids[k : k + 1] for k in range(len(ids))])) == t
        for e, (a, b) in zip(ids, bpe.from_ranks(RANKS).offsets(t, ids), strict=True):
            assert bpe.from_ranks(RANKS).bytes[e] in t[a:b].encode()


def test_unassigned_characters_and_special_text(plain):
    texts = ["a՘՘b c\U0003fc3b 1՘", "x<|endoftext|>y", None, "", "word " * 50_000]
    assert [x.tolist() for x in bpe.from_ranks(RANKS).encode(texts)] == [plain.encode_ordinary(t or "") for t in texts]


def test_op1(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: plain.encode_ordinary(d.text or "") for d in docs}
    got = op1_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    texts = {d.doc_id: d.text or "" for d in docs}
    for r in got:
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op1_odd(spark, odd_docs, no_docs):
    load = partial(bpe.from_ranks, RANKS)
    rows = bpe.encode_documents(odd_docs, load, ("n_tokens", "ids", "offsets", "decoded")).collect()
    assert len(rows) == odd_docs.count()
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.ids) == len(r.offsets) for r in rows)
    assert bpe.encode_documents(no_docs, load).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=1500))
def test_dac(ids):
    ids = np.array(ids, np.uint32)
    levels = dac.dac_encode(ids)
    assert (dac.dac_decode(levels) == ids).all()
    at = np.arange(len(ids))[::-1]
    assert (dac.dac_get(levels, at) == ids[at]).all()


def check_files(spark, docs, path, segment_tokens=1 << 18):
    dac.write_tokens(docs, partial(bpe.from_json, JSON), path, segment_tokens=segment_tokens)
    tokenizer = Tokenizer.from_file(JSON)
    rows = sorted(docs.collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.text or ""))
    want, flat = [], []
    for d in rows:
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2]
        want.append((d.doc_id, len(flat), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        flat += ids
    assert [tuple(r) for r in dac.read_tokens(spark, path, with_ids=True).orderBy("start").collect()] == want
    for at in [0, len(flat) // 3, len(flat) - 1, len(flat)] if flat else [0]:
        assert dac.read_token(spark, path, at) == (flat[at] if at < len(flat) else None)


def test_op3(spark, odd_docs, no_docs):
    check_files(spark, spark.read.parquet(f"{SF}/documents.parquet").repartition(5), new_path(spark, "t"), 5000)
    check_files(spark, odd_docs, new_path(spark, "t"))
    check_files(spark, no_docs, new_path(spark, "t"))
    assert op3_token_files(spark, SF).count() == 200


def test_op3_added_tokens(spark):
    """The file's own added token, in and around words, at ends, repeated and alone."""
    end = "<|endoftext|>"
    texts = [f"x{end}y", end, f"{end}{end} a", f"one two {end}\n three's{end}", "", None, "<|endoftext|", f"<|{end}|> it'{end}s", "plain words", f"\u00e9{end}\U0001f600"]
    tokenizer = Tokenizer.from_file(JSON)
    assert [x.tolist() for x in bpe.from_json(JSON).encode(texts)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    check_files(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), new_path(spark, "t"))


def test_more_words_than_the_table_holds(plain, monkeypatch):
    """One text with more distinct words than a worker remembers."""
    monkeypatch.setattr(bpe, "MOST_WORDS", 1000)
    monkeypatch.setattr(bpe, "SLOTS", 1 << 21)
    own = bpe.WordBpe(bpe.from_ranks(RANKS).tokenizer)
    text = " ".join(f"{k * 7919 % 100_003:x}é" for k in range(9000))
    for _ in range(2):
        got = own.encode([text, None, "tail", text[:5000]])
        assert [g.tolist() for g in got] == [plain.encode_ordinary(t) for t in (text, "", "tail", text[:5000])]


def test_words_beyond_all_slots():
    """2.2 million distinct words in one text, more than the table has slots."""
    own = bpe.from_ranks(RANKS)
    text = " ".join(f"{k:x}" for k in range(2_200_000))
    ids, ends = own.encode_flat([text])
    assert ends.tolist() == [len(ids)] and own.decode(ids).decode() == text
