"""Byte-level BPE over Arrow batches with the tokenizers library: encoding with offsets, and decoding through the reversed byte table.

Words are those of the pattern of the byte-level vocabularies here: endings of contractions, runs of letters, numbers or others with one space before, and white space.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import free_name
from .text import finish, powers, slices

#: Most distinct words whose ids a worker remembers (and most words it looks up at once), and slots of its table.
MOST_WORDS, SLOTS = 1_200_000, 1 << 21
#: Classes of characters as the word pattern knows them.
OTHER, LETTER, NUMBER, SPACE = range(4)
#: White space beside ASCII's, and what an apostrophe at a word's start takes along.
WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


def byte_to_char() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable in Latin-1, else the next one from 256 on."""
    table = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - 188)
    return table


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point. For characters that this Python's Unicode tables lack, the tokenizers library is asked: it knows some as letters or numbers, the rest are OTHER, like symbols."""
    import regex
    from tokenizers import pre_tokenizers

    first = {"L": LETTER, "N": NUMBER}
    names = [unicodedata.category(chr(k)) for k in range(0x110000)]
    table = np.array([first.get(n[0], OTHER) for n in names], np.uint8)
    newer = regex.findall(r"[\p{L}\p{N}]", "".join(chr(k) for k, n in enumerate(names) if n == "Cn"))
    for kind, before in ((LETTER, "b"), (NUMBER, "7")):
        cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str("".join(f"{before}{x} " for x in newer))
        ends = {end for _, (_, end) in cut}
        for k, x in enumerate(newer):
            # no cut between the letter or number and the character
            if 3 * k + 1 not in ends:
                table[ord(x)] = kind
    table[[0x20, *range(0x09, 0x0E), *map(ord, WIDE_SPACES)]] = SPACE
    return table


def word_starts(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point of texts that begin at `begin`: words are runs of letters, numbers or other characters, with a
    space before them if there is one, endings such as 's, and what white space is left, all but its last character together."""
    kind = classes()[points]
    start = np.ones(len(points), bool)
    start[1:] = kind[1:] != kind[:-1]
    first = np.zeros(len(points) + 1, bool)
    first[begin] = True
    start |= first[:-1]
    # a white space run's last character: alone, or with the word after it if it is a space
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:-1]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    quote = np.flatnonzero(start & (points == 0x27))
    if len(quote):
        tail = np.append(points, [0, 0, 0])
        last = np.append(begin[np.searchsorted(begin, quote, "right") % len(begin)], 0)[:-1]
        last = np.where(np.searchsorted(begin, quote, "right") < len(begin), last, len(points))
        one = np.isin(tail[quote + 1], list(map(ord, SHORT_ENDINGS))) & (quote + 1 < last)
        two = np.zeros(len(quote), bool)
        for a, b in LONG_ENDINGS:
            two |= (tail[quote + 1] == ord(a)) & (tail[quote + 2] == ord(b)) & (quote + 2 < last)
        start[quote[one | two] + 1] = False
        for at in (quote[one] + 2, quote[two] + 3):
            start[at[at < len(points)]] = True
    return start


class IdTable:
    """A hash table of words' ids in arrays: keys of 64 and 32 bits, and where a word's ids stand in a pool."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint32)
        self.at, self.length = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.pool, self.used, self.n = np.zeros(1 << 20, np.uint32), 0, 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it has none."""
        out = np.full(len(key), -1)
        slot, live = (key >> np.uint64(43)).astype(np.int64), np.arange(len(key))
        while len(live):
            own = self.key[slot]
            hit = (own == key[live]) & (self.check[slot] == check[live])
            out[live[hit]] = slot[hit]
            on = ~hit & (own != 0)
            live, slot = live[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[list[int]]) -> None:
        """Adds distinct keys that are not there."""
        sizes = np.array([len(i) for i in ids])
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(flat), self.n + len(key)
        slot, live = (key >> np.uint64(43)).astype(np.int64), np.arange(len(key))
        while len(live):
            free = self.key[slot] == 0
            self.key[slot[free]], self.check[slot[free]] = key[live[free]], check[live[free]]
            placed = free & (self.key[slot] == key[live]) & (self.check[slot] == check[live])
            self.at[slot[placed]], self.length[slot[placed]] = at[live[placed]], sizes[live[placed]]
            live, slot = live[~placed], (slot[~placed] + 1) & (SLOTS - 1)


class WordBpe:
    """A byte-level tokenizer that is asked once for each distinct word; BPE never joins words. Words are cut, hashed and looked up as arrays. With `added`, texts are cut at the tokenizer's added tokens first, as the library does."""

    def __init__(self, tokenizer, added: bool = False):
        from tokenizers import pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        found = {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items()} if added else {}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in found.values()) or (found and tokenizer.normalizer):
            raise ValueError("added tokens that strip, ask for whole words or follow a normalizer are not supported")
        self.added = {content: i for content, (i, _) in found.items()}
        # the longest of those that begin at one place
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # the words between added tokens hold none
        tokenizer.encode_special_tokens = True
        self.tokenizer, self.table = tokenizer, IdTable()
        back = {c: b for b, c in byte_to_char().items()}
        vocab = tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes])

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids); null counts as empty."""
        if not self.cut or not any(self.cut.search(t) for t in texts if t):
            return self.encode_words(texts)
        pieces = [self.cut.split(t or "") for t in texts]
        counts = np.array([len(p) // 2 + 1 for p in pieces])
        ids, ends = self.encode_words([x for p in pieces for x in p[::2]])
        last = np.cumsum(counts) - 1
        inner = np.ones(len(ends), bool)
        inner[last] = False
        special = np.array([self.added[x] for p in pieces for x in p[1::2]], np.uint32)
        return np.insert(ids, ends[inner], special), ends[last] + np.cumsum(counts - 1)

    def encode_words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """encode_flat() of texts without added tokens."""
        sizes = np.array([len(t or "") for t in texts], np.int64)
        text = "".join(t for t in texts if t)
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        begin = np.unique((ends - sizes)[sizes > 0])
        start = word_starts(points, begin)
        first = np.flatnonzero(start)
        word = np.cumsum(start) - 1
        place = np.arange(len(points)) - first[word]
        power = powers(int(place.max()) + 1, 7)[place]
        coded = points.astype(np.uint64) + np.uint64(1)
        size = np.diff(np.append(first, len(points)))
        key = np.maximum(finish(np.add.reduceat(coded * power, first)), np.uint64(1))
        check = np.add.reduceat(coded.astype(np.uint32) * ((power >> np.uint64(32)).astype(np.uint32) | np.uint32(1)), first, dtype=np.uint32) + size.astype(np.uint32)
        # however long a text is, the table never has to hold more words than it has room for
        found = [self.look_up(text, *(x[a : a + MOST_WORDS] for x in (first, size, key, check))) for a in range(0, len(first), MOST_WORDS)]
        total = np.cumsum(np.concatenate([n for _, n in found]))
        return np.concatenate([ids for ids, _ in found]), np.append(0, total)[np.searchsorted(first, ends, "left")]

    def look_up(self, text: str, first: np.ndarray, size: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words of text, number of each word's ids); words that are new are encoded."""
        slot = self.table.find(key, check)
        if (slot < 0).any():
            if self.table.n + int((slot < 0).sum()) > MOST_WORDS:
                self.table.clear()
                slot[:] = -1
            lost = np.flatnonzero(slot < 0)
            _, at = np.unique(key[lost], return_index=True)
            new = lost[at]
            words = [text[a : a + n] for a, n in zip(first[new].tolist(), size[new].tolist(), strict=True)]
            self.table.add(key[new], check[new], [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])
            slot[lost] = self.table.find(key[lost], check[lost])
        length = self.table.length[slot].astype(np.int64)
        total = np.cumsum(length)
        return self.table.pool[np.repeat(self.table.at[slot] - total + length, length) + np.arange(int(total[-1]))], length

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, ends = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(np.append(0, ends).tolist(), ends.tolist(), strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; any slice of a text's ids gives a slice of its bytes, which may begin or end inside a character."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """For each token the first character it touches and the one after the last; tokens that share a character overlap there."""
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        end = np.cumsum(self.lengths[ids])
        begin = end - self.lengths[ids]
        return np.stack([char[begin], char[end - 1] + 1], 1) if len(ids) else np.zeros((0, 2), np.int64)


def decode_pieces(bpe: WordBpe, pieces: Iterator[np.ndarray]) -> Iterator[str]:
    """Text of ids that come in pieces: a character that two pieces share comes whole with the later one; bytes that are no UTF-8 become U+FFFD."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in pieces:
        yield decoder.decode(bpe.decode(ids))
    yield decoder.decode(b"", True)


@lru_cache(4)
def from_ranks(path: str) -> WordBpe:
    """From a file of base64 tokens with ranks. A pair merges at the rank of what it joins to, so each way to cut a token in two known ones is a merge rule, in order of the token's rank; a word that is itself a token is taken whole."""
    from tokenizers import Tokenizer, models

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    table = byte_to_char()
    name = lambda token: "".join(table[b] for b in token)
    cuts = ((t[:k], t[k:]) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)))
    merges = [(name(a), name(b)) for a, b in cuts if a in ranks and b in ranks]
    return WordBpe(Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)))


@lru_cache(4)
def from_json(path: str) -> WordBpe:
    """From a file of the tokenizers library that holds a byte-level BPE."""
    from tokenizers import Tokenizer

    return WordBpe(Tokenizer.from_file(path), added=True)


COLUMNS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "offsets": (T.ArrayType(T.ArrayType(T.IntegerType())), pa.list_(pa.list_(pa.int32()))),
    "decoded": (T.BinaryType(), pa.binary()),
}


def encode_documents(docs: DataFrame, load: Callable[[], WordBpe], outputs: tuple[str, ...] = ("n_tokens", "ids"), text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all of docs if none) and the outputs: n_tokens, ids, offsets (first and last character of each token), decoded (the ids' bytes, decoded again).

    Null counts as empty and gives no ids. Each row stands alone, so ties, repeated rows and ids don't matter; a column
    of docs by an output's name is left out. Texts are worked on in slices of about 2 MB, a longer text by itself.
    """
    keep = [c for c in keep or docs.columns if c not in outputs]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, COLUMNS[c][0]) for c in outputs])
    own = free_name(keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for batch in slices(batches, own):
            texts = batch.column(own).to_pylist()
            flat, ends = bpe.encode_flat(texts)
            ends = np.append(0, ends)
            ids = [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            made = {"n_tokens": lambda: pa.array(np.diff(ends))}  # noqa: B023
            made["ids"] = lambda: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))  # noqa: B023
            made["offsets"] = lambda: pa.array([bpe.offsets(t or "", i).tolist() for t, i in zip(texts, ids, strict=True)], COLUMNS["offsets"][1])  # noqa: B023
            made["decoded"] = lambda: pa.array([bpe.decode(i) for i in ids], pa.binary())  # noqa: B023
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(made[c]().cast(COLUMNS[c][1]) for c in outputs)], names=[*keep, *outputs])

    return docs.select(*keep, docs[text_col].alias(own)).mapInArrow(run, schema)
