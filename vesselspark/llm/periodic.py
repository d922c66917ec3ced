"""Periodic runs of words: Lyndon roots extended both ways by common extensions, which suffix trees of a text and its reversal give in constant time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, slices, utf8


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers 1.., walked once in an Euler tour.

    rank has the place of each suffix among all in order (the empty one is first). Between two leaves the tour comes up to their lowest common
    ancestor, whose depth is the length of their common start; `up` keeps how far it comes up before each leaf, with minima over
    spans of 2^k leaves, so a question takes two looks.
    """

    def __init__(self, numbers: list[int]):
        self.n, self.base = len(numbers), (max(numbers) if numbers else 0) + 1
        self.text = [*numbers, 0]
        self.grow()
        self.order()
        self.rank, up = self.tour(self.kids)
        self.up = [up]
        while 2 << (len(self.up) - 1) <= len(up):
            half = 1 << (len(self.up) - 1)
            self.up.append(np.minimum(self.up[-1][:-half], self.up[-1][half:]))
        del self.edges

    def grow(self) -> None:
        """Adds the text from left to right; a node has where its edge starts and ends in the text, its edges lie in one dictionary."""
        text, base, many = self.text, self.base, len(self.text)
        start, end, link, edges = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, c in enumerate(text):
            waiting += 1
            pending = 0
            while waiting:
                if not length:
                    edge = i
                key = node * base + text[edge]
                down = edges.get(key)
                if down is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(many)
                    link.append(0)
                    target = node
                else:
                    first, last = start[down], end[down]
                    size = (last if last <= i else i + 1) - first
                    if length >= size:
                        node, edge, length = down, edge + size, length - size
                        continue
                    if text[first + length] == c:
                        length += 1
                        if pending:
                            link[pending] = node
                        break
                    target = len(start)
                    edges[key] = target
                    start += (first, i)
                    end += (first + length, many)
                    link += (0, 0)
                    start[down] = first + length
                    edges[target * base + text[first + length]] = down
                    edges[target * base + c] = target + 1
                if pending:
                    link[pending] = target
                pending = target if target != node else 0
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.start, self.end, self.edges = start, end, edges

    def order(self) -> None:
        """Children of each node by their first numbers, as spans [begin, begin of the next node) of one list."""
        keys = np.fromiter(self.edges.keys(), np.int64, len(self.edges))
        by = np.argsort(keys)
        self.kids = np.fromiter(self.edges.values(), np.int64, len(self.edges))[by].tolist()
        self.first = keys[by] % self.base
        self.begin = np.searchsorted(keys[by] // self.base, np.arange(len(self.start) + 1)).tolist()

    def tour(self, kids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        start, end, begin, many = self.start, self.end, self.begin, len(self.text)
        suffixes, ups, depth = [], [], [0] * len(self.start)
        up, stack = 0, [(0, 0, False)]
        while stack:
            node, above, again = stack.pop()
            if again:
                up = above
            here = above + end[node] - start[node]
            own = kids[begin[node] : begin[node + 1]]
            if own:
                stack += [(k, here, True) for k in own[:0:-1]]
                stack.append((own[0], here, False))
            else:
                suffixes.append(many - here)
                ups.append(up)
        rank = np.empty(many, np.int64)
        rank[suffixes] = np.arange(many)
        return rank, np.array(ups, np.int64)

    def backwards(self) -> np.ndarray:
        """Ranks of the suffixes when larger numbers come first; the empty one still goes before all."""
        node = np.repeat(np.arange(len(self.start)), np.diff(self.begin))
        back = np.lexsort((np.where(self.first == 0, -self.base, -self.first), node))
        return self.tour(np.array(self.kids)[back].tolist())[0]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common start of suffixes i and j, which differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.up[k][low[at]], self.up[k][high[at] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank: the end of the longest Lyndon word that starts there."""
    out, values = [0] * len(rank), rank.tolist()
    for i in range(len(values) - 2, -1, -1):
        j = i + 1
        while values[j] > values[i]:
            j = out[j]
        out[i] = j
    return np.array(out[:-1], np.int64)


def runs_of(numbers: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words and two periods, by start, then period.

    A run's root in Lyndon form is the longest Lyndon word where it starts, for one of the two orders of the words; so each place gives one
    candidate period an order, and what extends it to both sides says whether it is a run.
    """
    n = len(numbers)
    if n < max(2, least):
        return []
    tree = SuffixTree(numbers)
    ends = [next_smaller(tree.rank), next_smaller(tree.backwards())]
    i = np.tile(np.arange(n), 2)
    j = np.concatenate(ends)
    right = tree.common(i, j)
    del tree
    left = SuffixTree(numbers[::-1]).common(n - i, n - j)
    begin, end, period = i - left, j + right, j - i
    good = end - begin >= np.maximum(least, 2 * period)
    found = np.unique(np.stack([begin[good], period[good], end[good]]), axis=1)
    return [(b, e - b, p) for b, p, e in found.T.tolist()]


def stretches(hashes: np.ndarray, owner: np.ndarray, size: int, rounds: int = 4) -> list[tuple[int, int]]:
    """Spans of words that may hold runs: a run of at least 2 size words consists of windows of `size` words that come again inside it, so other words are left out,
    and then what is left between them is looked at alone. More rounds leave out more; none loses a run."""
    n = len(hashes) - size + 1
    if n <= 0:
        return []
    # windows are told apart by a hash of their words' hashes; equal hashes can only leave in too much
    window = np.zeros(n, np.uint64)
    for k in range(size):
        window = window * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    part, where = owner, np.arange(n)
    for _ in range(rounds):
        where = where[part[where] == part[where + size - 1]]
        order = np.lexsort((window[where], part[where]))
        own, of = window[where][order], part[where][order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (own[1:] == own[:-1]) & (of[1:] == of[:-1])
        before, where = len(where), np.sort(where[order[same[1:] | same[:-1]]])
        mark = np.bincount(where, minlength=len(hashes) + 1) - np.bincount(where + size, minlength=len(hashes) + 1)
        inside = np.cumsum(mark)[:-1] > 0
        new = np.ones(len(hashes), bool)
        new[1:] = (part[1:] != part[:-1]) | (inside[1:] != inside[:-1])
        part = np.cumsum(new)
        if len(where) == before:
            break
    first = np.flatnonzero(new & inside)
    last = np.append(np.flatnonzero(new), len(hashes))
    return [(b, int(last[np.searchsorted(last, b, "right")])) for b in first.tolist()]


def find_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_words, runs (start, length, period, in words, by start, then period), and the text without the
    repeats of its runs, words joined by one space (collapsed; with digest its SHA-256 instead).

    A run is a stretch of words with smallest period q, of at least `least` words and two periods, that no neighbouring word extends; of each run all
    words after the first q go. Words are whatever lies between the six ASCII spaces, known by 64-bit hashes. Texts without repeated
    windows are settled by a sort of a batch; only stretches of repeated windows become trees, which take some 700 bytes a word while they are built, one
    after the other. Null counts as empty. Rows stand alone: ties, repeated rows and null ids are kept as they are.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            words = Words(data, offsets)
            hashes = words.hashes()
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            for begin, end in stretches(hashes, words.doc, least // 2):
                if end - begin >= least:
                    numbers = np.unique(hashes[begin:end], return_inverse=True)[1] + 1
                    at = int(words.pos[begin])
                    found[int(words.doc[begin])] += [(at + s, n, p) for s, n, p in runs_of(numbers.tolist(), least)]
            left = []
            for k, own in enumerate(found):
                kept = data[offsets[k] : offsets[k + 1]].tobytes().split()
                if own:
                    own.sort(key=lambda r: (r[0], r[2]))
                    gone = np.zeros(len(kept) + 1, np.int64)
                    for s, n, p in own:
                        gone[s + p] += 1
                        gone[s + n] -= 1
                    kept = [kept[w] for w in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                text = b" ".join(kept)
                left.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found], pa.list_(run_type))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.n, pa.int64()), runs, pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    fields = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, fields)


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth document, by a hash of its id, the words from a place on become repetitions of the first of them. Rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.greatest(F.size("words"), F.lit(1)), F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", n).withColumn("a", (g % n).cast("int")).withColumn("g", g)
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), made).otherwise(F.col("text")).alias("text"))
