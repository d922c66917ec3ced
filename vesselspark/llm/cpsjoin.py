"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled tokens they share; small buckets are compared pair by pair, and runs repeat until the target recall."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from ..session import drop_written, free_shuffles, maybe_broadcast, parts_for, written
from .text import Words, finish, slices, utf8

#: Candidates: pairs (a, b), or packed blocks; deep ones come from below level 1, where buckets may hold a pair more than once.
FOUND = "a long, b long, left binary, right binary, bits binary, deep boolean"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]
FOUND_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
#: Buckets of at most so many rows are compared by products of whole columns, pair by pair over all of them at once.
FEW = 64
#: Most rows and items of sets on a side of a packed block.
BLOCK_ROWS, BLOCK_ITEMS = 1024, 1 << 20
#: Length of the MinHash embedding: a set's token i is its smallest shingle under hash i. Jaccard is the chance that two sets share a token.
TOKENS = 64
MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct word n-grams, by document and hash. A text of fewer words is one shingle."""
    hashes = words.hashes()
    where, key = words.windows(hashes, size)
    doc = words.doc[where]
    few = np.flatnonzero((words.n > 0) & (words.n < size))
    for row in few.tolist():
        own = hashes[words.base[row] : words.base[row] + words.n[row]]
        total = np.uint64(len(own))
        for h in own:
            total = finish(total + h)
        key, doc = np.append(key, total), np.append(doc, row)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], key[new]


def set_keys(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each document, size, two hashes of the set)."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[first, len(doc)])
    return first, size, np.add.reduceat(finish(key), first).view(np.int64), np.add.reduceat(finish(key ^ np.uint64(0x5851F42D4C957F2D)), first).view(np.int64)


def signatures(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, TOKENS) smallest hashes."""
    out = np.empty((len(first), TOKENS), np.uint32)
    for i, m in enumerate(MULTIPLIERS):
        out[:, i] = np.minimum.reduceat(((key ^ (key >> np.uint64(29))) * m >> np.uint64(32)).astype(np.uint32), first)
    return out


def sampled(path: np.ndarray, threshold: float) -> np.ndarray:
    """(paths, TOKENS): the tokens on which each path's node splits, each with chance 1 / (threshold * TOKENS)."""
    draw = finish(path.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return draw.astype(np.float64) / 2.0**64 < 1 / (threshold * TOKENS)


def child(path: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    return finish(finish(path.astype(np.int64).view(np.uint64) ^ finish(token.astype(np.uint64) + np.uint64(77))) + value.astype(np.uint64)).view(np.int64)


def runs_for(recall: float, depth: int = 3) -> int:
    """Runs after which a pair at the threshold has met with chance `recall`: a pair survives a level of a run like a branching process with mean 1."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def least_shared(threshold: float, recall: float) -> int:
    """Shared tokens from which on a pair is a candidate: four deviations of the estimate are let through, more where pairs at the threshold would fall below with more than a quarter of the chance to miss them."""
    least = math.ceil(TOKENS * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / TOKENS)) - 1e-9)
    below = np.cumsum([math.comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k) for k in range(TOKENS + 1)])
    return max(0, min(least, int(np.searchsorted(below, (1 - recall) / 4, "right"))))


def miss_chance(threshold: float, depth: int, n_seeds: int, repeats: int, least: int = 0) -> float:
    """Chance that a pair exactly at the threshold never meets in a bucket of level `depth`: level 1 has n_seeds tokens, each split below by `repeats` runs.

    Its shared tokens are the same at all levels, so the sum is over their number; fewer than `least` are a miss.
    """
    miss, split = 0.0, 1 / (threshold * TOKENS)
    for k in range(TOKENS + 1):
        chance = math.comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k)
        meet = 1.0
        for _ in range(depth - 1):
            meet = 1 - (1 - min(1.0, split) * meet) ** k
        lost = (1 - meet) ** repeats
        # of the seeds, h are among the k shared tokens
        drawn = [math.comb(n_seeds, h) * math.comb(TOKENS - n_seeds, k - h) * lost**h for h in range(max(0, k + n_seeds - TOKENS), min(k, n_seeds) + 1)]
        miss += chance * (sum(drawn) / math.comb(TOKENS, k) if k >= least else 1)
    return miss


def repeats_for(recall: float, threshold: float, depth: int, n_seeds: int) -> int:
    """Runs below each token of level 1 after which a pair at the threshold has met with chance `recall`, even where all its buckets are split to the last level."""
    least, repeats = least_shared(threshold, recall), 1
    while miss_chance(threshold, depth, n_seeds, repeats, least) > 1 - recall:
        repeats += 1
        if repeats > 1000:
            raise ValueError(f"recall {recall} cannot be reached with {TOKENS} tokens")
    return repeats


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS) if len(column) else np.zeros((0, TOKENS), np.uint32)


def alike(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Whether pairs pass the size bound and share `least` tokens or more."""
    close = np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b)
    at = np.flatnonzero(close)
    close[at] = (a[at] == b[at]).sum(1) >= least
    return close


@dataclass
class Rows:
    """Rows of one bucket: set, size, sketch, the seeds in whose bucket of level 1 it is in a small bucket (leaf) or a point, as bits, and its ball (0: none)."""

    c: np.ndarray
    n: np.ndarray
    sig: np.ndarray
    leaf: np.ndarray
    point: np.ndarray
    ball: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table) -> Rows:
        sig = batch.column("sig")
        return cls(*(batch.column(x).to_numpy() for x in ("c", "n")), matrix(sig), *(batch.column(x).to_numpy() for x in ("leaf", "point", "ball")))

    def take(self, at: np.ndarray | slice) -> Rows:
        return Rows(self.c[at], self.n[at], self.sig[at], self.leaf[at], self.point[at], self.ball[at])


def close_pairs(left: Rows, right: Rows, seeds: np.ndarray, seed: int, threshold: float, least: int, at_once: int = 64) -> np.ndarray:
    """(left, right) whether a pair is a candidate that no bucket of an earlier seed compares (of any seed, if seed is -1); two of one ball are none."""
    out = np.zeros((len(left.c), len(right.c)), bool)
    other = np.ascontiguousarray(right.sig.T)
    before = {int(t): q for q, t in enumerate(seeds if seed < 0 else seeds[:seed])}
    bit = lambda masks, q: masks >> q & 1 > 0
    for begin in range(0, len(left.c), at_once):
        own = left.take(slice(begin, begin + at_once))
        shared = np.zeros((len(own.c), len(right.c)), np.uint8)
        done = np.zeros(shared.shape, bool)
        for t in range(TOKENS):
            same = own.sig[:, t, None] == other[t]
            shared += same
            if (q := before.get(t)) is not None:
                done |= same & (bit(own.leaf, q)[:, None] & bit(right.leaf, q) | bit(own.point, q)[:, None] | bit(right.point, q))
        size = np.minimum(own.n[:, None], right.n) >= threshold * np.maximum(own.n[:, None], right.n)
        apart = (own.ball[:, None] != right.ball) | (own.ball[:, None] == 0)
        out[begin : begin + at_once] = (shared >= least) & ~done & size & apart & (own.c[:, None] != right.c)
    return out


def block_cuts(n: np.ndarray) -> list[int]:
    """Where rows with sets of n items are cut, so that a block has at most BLOCK_ROWS rows and, unless it is a single row, BLOCK_ITEMS items."""
    cuts, items = [0], 0
    for at, size in enumerate(n.tolist()):
        if at > cuts[-1] and (items + size > BLOCK_ITEMS or at - cuts[-1] >= BLOCK_ROWS):
            cuts.append(at)
            items = 0
        items += size
    return [*cuts, len(n)]


def found_table(left: np.ndarray, right: np.ndarray, bits: np.ndarray, deep: bool) -> pa.RecordBatch:
    """Candidates of a block: a row a pair if they are few, else a single row with the two sides and a bit a pair."""
    i, j = np.nonzero(bits)
    if len(i) > 2 * (len(left) + len(right)):
        rows, columns = bits.any(1), bits.any(0)
        data = ([None], [None], [left[rows].tobytes()], [right[columns].tobytes()], [np.packbits(bits[rows][:, columns]).tobytes()], [deep])
    else:
        none = [None] * len(i)
        data = (np.minimum(left[i], right[j]), np.maximum(left[i], right[j]), none, none, none, np.full(len(i), deep))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(data, FOUND_TYPES, strict=True)], names=FOUND_NAMES)


def pairs_in_groups(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs inside each run of rows."""
    row = np.arange(int(count.sum()))
    start = np.repeat(first, count)
    before = row + (first[0] if len(first) else 0) - start
    left = np.repeat(start, before)
    total = np.cumsum(before) - before
    return left + np.arange(int(before.sum())) - np.repeat(total, before), np.repeat(row + (first[0] if len(first) else 0), before)


def groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by a column, recut so that no group is split; groups are small here."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(by).to_numpy()
        new = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column(by)[-1].as_py() != key[0]:
            yield pa.concat_batches(held)
            held = []
        if len(new):
            yield pa.concat_batches([*held, batch.slice(0, int(new[-1]))])
            held = [batch.slice(int(new[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def first_covered(sig_a: np.ndarray, sig_b: np.ndarray, leaf: np.ndarray, point: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For pairs the first seed whose bucket compares them, -1 if none does: they share its token, and the bucket is small (leaf) or one of them is a point of it."""
    met = (sig_a[:, seeds] == sig_b[:, seeds]) & ((leaf | point)[:, None] >> np.arange(len(seeds)) & 1 > 0)
    return np.where(met.any(1), met.argmax(1), -1)


def common_items(left: list[np.ndarray], right: list[np.ndarray], at_once: int = 400_000, columns: int = 4096) -> np.ndarray:
    """(left, right) sizes of intersections of sorted item arrays, by products of 0/1 matrices. Items are hashes, so slices of their range hold about at_once of them each, however long the sets are."""
    both = [*left, *right]
    out = np.zeros((len(left), len(right)), np.int64)
    slices_n = -(-sum(map(len, both)) // at_once)
    for k in range(slices_n):
        low, high = np.uint64(2**64 // slices_n * k), np.uint64(2**64 // slices_n * (k + 1) - 1 if k + 1 < slices_n else 2**64 - 1)
        parts = [x[np.searchsorted(x, low, "left") : np.searchsorted(x, high, "right")] for x in both]
        items, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(both)), [len(x) for x in parts])
        # what a single row has is common to none
        shared = times > 1
        column, row, items = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]], items[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for begin in range(0, len(items), columns):
            a, b = np.searchsorted(column, [begin, begin + columns])
            own = np.zeros((len(both), columns), np.float32)
            own[row[a:b], column[a:b] - begin] = 1
            out += np.rint(own[: len(left)] @ own[len(left) :].T).astype(np.int64)
    return out


def spanning(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the linked pairs of a block join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = int(left[i]), int(right[j])
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[ry] = rx
            out.append((x, y))
    return out


class Join:
    """One join; params as jaccard_groups()."""

    def __init__(self, threshold: float, recall: float, limit: int, depth: int):
        self.threshold, self.limit, self.depth = threshold, limit, depth
        roots = finish(np.arange(1, runs_for(recall) + 1, dtype=np.uint64)).view(np.int64)
        # runs that split on the same token at their root make the same buckets there, so one of them stands for all;
        # below, each of these buckets is split by `repeats` runs of their own
        self.seeds = np.unique(np.nonzero(sampled(roots, threshold))[1])
        self.repeats, self.least = repeats_for(recall, threshold, depth, len(self.seeds)), least_shared(threshold, recall)

    def first_level(self, reps: DataFrame) -> DataFrame:
        seeds = self.seeds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sig = matrix(batch.column("sig"))
                token = np.repeat(seeds, len(sig))
                path = child(np.full(len(token), 12345), token, sig[:, seeds].T.ravel())
                c = np.tile(batch.column("c").to_numpy(), len(seeds))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(seeds)), len(sig)), pa.int32()), pa.array(path), pa.array(c)], names=["seed", "path", "c"])

        return reps.select("c", "sig").mapInArrow(run, "seed int, path long, c long")

    def leaves(self, rows: DataFrame) -> DataFrame:
        """Candidates of buckets of at most `limit` rows (path, seed, c, n, sig, leaf, point, ball), each pair only in the bucket of level 1 that first compares it, or in any deeper one (seed -1) if none does."""
        threshold, seeds, least = self.threshold, self.seeds, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in groups(batches, "path"):
                path, seed, rows = batch.column("path").to_numpy(), batch.column("seed").to_numpy(), Rows.of(batch)
                first = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
                count = np.diff(np.r_[first, len(path)])
                for at, m in zip(first[count > FEW].tolist(), count[count > FEW].tolist(), strict=True):
                    own = rows.take(slice(at, at + m))
                    bits = np.triu(close_pairs(own, own, seeds, int(seed[at]), threshold, least), 1)
                    cuts = block_cuts(own.n)
                    for x, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for c, d in zip(cuts[x:], cuts[x + 1 :], strict=False):
                            if bits[a:b, c:d].any():
                                yield found_table(own.c[a:b], own.c[c:d], bits[a:b, c:d], bool(seed[at] < 0))
                few = np.repeat(count <= FEW, count)
                rows, seed, count = rows.take(few), seed[few], count[count <= FEW]
                a, b = pairs_in_groups(np.cumsum(count) - count, count)
                for k in range(0, len(a), 200_000):
                    i, j = a[k : k + 200_000], b[k : k + 200_000]
                    good = (rows.c[i] != rows.c[j]) & ((rows.ball[i] != rows.ball[j]) | (rows.ball[i] == 0)) & alike(rows.sig[i], rows.sig[j], rows.n[i], rows.n[j], threshold, least)
                    i, j = i[good], j[good]
                    own = first_covered(rows.sig[i], rows.sig[j], rows.leaf[i] & rows.leaf[j], rows.point[i] | rows.point[j], seeds) == seed[i]
                    i, j = i[own], j[own]
                    none = pa.nulls(len(i), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rows.c[i], rows.c[j])), pa.array(np.maximum(rows.c[i], rows.c[j])), none, none, none, pa.array(seed[i] < 0)], names=FOUND_NAMES)

        return rows.repartition("path").sortWithinPartitions("path").mapInArrow(run, FOUND)

    def blocks(self, points: DataFrame, rows: DataFrame) -> DataFrame:
        """Candidates of each point with all rows of its bucket, in blocks; columns path, seed, c, n, sig, leaf, point, ball.

        A pair of points counts where the smaller is on the left. A row goes to as many blocks as its bucket has blocks of points. The points of the ball that
        most of a bucket's points are in do not meet each other, so a group of near-identical sets costs what is beside it.
        """
        main = points.filter("ball <> 0").groupBy("path", "ball").count().groupBy("path").agg(F.max_by("ball", F.struct("count", "ball")).alias("main"))
        main = written(main, "main")
        side = lambda df: df.join(main, "path", "left").withColumn("inside", F.coalesce(F.col("ball") == F.col("main"), F.lit(False))).drop("main")
        points, rows = written(side(points), "points"), written(side(rows), "rows")
        return self.met(points.filter("not inside"), rows).unionByName(self.met(points.filter("inside"), rows.filter("not inside")))

    def met(self, points: DataFrame, rows: DataFrame) -> DataFrame:
        """blocks() of given points with given rows."""
        threshold, seeds, least = self.threshold, self.seeds, self.least
        parts = lambda df, name: df.groupBy("path").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_ITEMS)).cast("int").alias(name))
        sizes = written(parts(points, "many").join(parts(rows, "most"), "path"), "sizes")
        block = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        both = ["seed", "c", "n", "sig", "leaf", "point", "ball"]
        left = points.join(sizes, "path").select("path", block("many").alias("i"), spread("most").alias("j"), *both, F.lit(0).alias("side"))
        right = rows.join(sizes, "path").select("path", spread("many").alias("i"), block("most").alias("j"), *both, F.lit(1).alias("side"))

        def run(table: pa.Table) -> pa.Table:
            batch = table.combine_chunks().to_batches()[0]
            side, seed, rows = batch.column("side").to_numpy(), int(batch.column("seed")[0].as_py()), Rows.of(batch)
            left, right = rows.take(side == 0), rows.take(side == 1)
            bits = close_pairs(left, right, seeds, seed, threshold, least)
            # of two points the smaller is on the left; deep pairs may come twice
            if seed >= 0:
                bits &= (right.point >> seed & 1 == 0) | (left.c[:, None] < right.c)
            return pa.Table.from_batches([found_table(left.c, right.c, bits, seed < 0)])

        return left.unionByName(right).groupBy("path", "i", "j").applyInArrow(run, FOUND)

    def similar_to_most(self, rows: DataFrame, probes: int = 8, often: float = 0.05) -> DataFrame:
        """(path, c, near) of rows whose mean similarity to their bucket's others, by token counts, is 0.9 of the threshold or more: most of
        the pairs they are in are near the threshold, so comparing them with all costs about what there is to find.

        Only tokens that a share `often` of a bucket has are looked at, so a bucket's counts are a small map, joined once a row.
        Counts are summed within a batch before the shuffle. This chooses how rows are compared, not which.
        """
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sig = matrix(batch.column("sig"))[:, TOKENS - probes :]
                token = child(np.repeat(batch.column("path").to_numpy(), probes), np.tile(np.arange(probes), len(sig)), sig.ravel())
                ends = pa.array(np.arange(0, len(token) + 1, probes, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("path", "c", "cnt")), pa.ListArray.from_arrays(ends, pa.array(token))], names=["path", "c", "cnt", "tokens"])

        tokens = written(rows.select("path", "c", "cnt", "sig").mapInArrow(spread, "path long, c long, cnt long, tokens array<long>"), "tokens")

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                token, at, m = np.unique(batch.column("tokens").flatten().to_numpy(), return_index=True, return_counts=True)
                path, cnt = (batch.column(x).to_numpy()[at // probes] for x in ("path", "cnt"))
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(cnt), pa.array(token), pa.array(m)], names=["path", "cnt", "token", "m"])

        counts = tokens.select("path", "cnt", "tokens").mapInArrow(combine, "path long, cnt long, token long, m long")
        counts = counts.groupBy("path", "token").agg(F.sum("m").alias("m"), F.any_value("cnt").alias("cnt"))
        counts = counts.filter((F.col("m") > 1) & (F.col("m") >= often * F.col("cnt")))
        counts = written(counts.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("token", "m"))).alias("often")), "often")
        shared = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.coalesce(F.try_element_at("often", t), F.lit(1)) - 1)
        near = tokens.join(counts, "path").select("path", "c", (shared / (F.col("cnt") - 1) / probes).alias("near"))
        return written(near.filter(F.col("near") >= 0.9 * self.threshold), "points")

    def balls(self, points: DataFrame, sets: Callable[[DataFrame], DataFrame], at_once: int = 512) -> DataFrame:
        """(c, ball) of points of large buckets so near to their bucket's nearest point that all of a ball are linked to each other.

        The Jaccard distance is a metric, so two sets within half the linking distance of a third are linked. Each point is compared with one other, in parts of about at_once.
        """
        radius = 1 - (1 - self.threshold) / 2
        pivots = written(points.groupBy("path").agg(F.min_by("c", F.struct(-F.col("near"), F.col("c"))).alias("pivot"), F.ceil(F.count("*") / at_once).cast("int").alias("parts")), "pivots")
        items = sets(points.select("c"))
        own = pivots.join(items, pivots["pivot"] == items["c"]).select("path", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("c"), "items")
        both = own.unionByName(points.join(pivots, "path").join(items, "c").select("path", F.pmod(F.xxhash64("c"), "parts").cast("int").alias("part"), "c", "items"))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each pivot comes before its points."""
            own, mine = None, np.zeros(0, np.uint64)
            for batch in batches:
                good = []
                for path, c, items in zip(*(batch.column(x).to_pylist() for x in ("path", "c", "items")), strict=True):
                    other = np.frombuffer(items, np.uint64)
                    if c is None:
                        own, mine = path, other
                    elif path == own and path != 0:
                        both = len(np.intersect1d(mine, other, assume_unique=True))
                        if both >= radius * (len(mine) + len(other) - both):
                            good.append((path, c))
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in range(2)], names=["path", "c"])

        held = both.repartition("path", "part").sortWithinPartitions("path", "part", F.col("c").asc_nulls_first()).mapInArrow(near, "path long, c long")
        return written(held.groupBy("c").agg(F.min("path").alias("ball")), "balls")

    def split(self, rows: DataFrame, repeats: int = 1) -> DataFrame:
        """Each row under each token its node samples: (path, c). More repeats are as many nodes, whose subtrees have nothing in common."""
        threshold = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c, sig = batch.column("c").to_numpy(), matrix(batch.column("sig"))
                for run_no in range(repeats):
                    path = batch.column("path").to_numpy()
                    if run_no:
                        path = child(path, np.full(len(path), TOKENS), np.full(len(path), run_no))
                    row, token = np.nonzero(sampled(path, threshold))
                    yield pa.RecordBatch.from_arrays([pa.array(child(path[row], token, sig[row, token])), pa.array(c[row])], names=["path", "c"])

        return rows.select("path", "c", "sig").mapInArrow(run, "path long, c long")

    def counted(self, frontier: DataFrame) -> DataFrame:
        """The rows whose path others share, with cnt."""
        counts = written(frontier.groupBy("path").agg(F.count("*").alias("cnt")).filter("cnt > 1"), "counts")
        return written(frontier.join(counts, "path"), "shared")

    def candidates(self, reps: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pairs, dense, balls) of reps (c, n, sig): pairs (a < b, deep) that may be similar, packed blocks of many such pairs, and balls (c, ball), all of one being linked.
        What is not deep comes once, and no pair of one ball. sets gives (c, items) for a table of c."""
        rows = self.counted(written(self.first_level(reps), "frontier"))
        big = written(rows.filter(F.col("cnt") > self.limit).join(reps, "c"), "big")
        points = self.similar_to_most(big)
        bits = lambda df, name: df.groupBy("c").agg(F.bit_or(F.expr("shiftleft(1L, seed)")).alias(name))
        small = rows.filter(F.col("cnt") <= self.limit)
        masks = bits(small, "leaf").join(bits(big.join(points, ["path", "c"], "left_semi"), "point"), "c", "full")
        # too small a bucket of level 1 is no place for balls: its rows are compared anyway
        balls = reps.sparkSession.createDataFrame([], "c long, ball long") if points.isEmpty() else self.balls(points, sets)
        masks = masks.join(balls, "c", "left")
        masks = written(masks.select("c", *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("leaf", "point", "ball"))), "masks")
        full = lambda df: df.join(masks, "c", "left").withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in ("leaf", "point", "ball")})
        found = [written(self.leaves(full(small.join(reps, "c"))), "found")]
        for level in range(2, self.depth + 2):
            if big.isEmpty():
                break
            if not points.isEmpty():
                hot = written(points.select("path").distinct(), "hot")
                found.append(written(self.blocks(full(big.join(points, ["path", "c"], "left_semi")), full(big.join(hot, "path", "left_semi"))), "found"))
            rest = big.join(points, ["path", "c"], "left_anti")
            rows = self.counted(written(self.split(rest, self.repeats if level == 2 else 1), "frontier")).withColumn("seed", F.lit(-1))
            found.append(written(self.leaves(full(rows.filter(F.col("cnt") <= self.limit).join(reps, "c"))), "found"))
            big = written(rows.filter(F.col("cnt") > self.limit).join(reps, "c"), "big")
            # past the last level all that is left is compared in blocks
            points = self.similar_to_most(big) if level < self.depth else written(big.select("path", "c"), "points")
        free_shuffles(reps.sparkSession)
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        pairs = every.filter("a is not null").select("a", "b", "deep").distinct()
        return written(pairs, "candidates"), written(every.filter("a is null").drop("a", "b").withColumn("block", F.monotonically_increasing_id()), "dense"), balls


def jaccard_links(docs: DataFrame, threshold: float = 0.8, ngram: int = 5, recall: float = 0.999, limit: int = 4096, depth: int = 5, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, partners: int = 512) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of sets that are alike; parameters as jaccard_groups(), `limit` being the most rows of a bucket that one task compares pair by pair.

    Returns (members, degrees, edges): members has a row per row of docs with words and an id (doc_id, c: the number of its shingle set, n: the set's size);
    degrees (c, n_links) counts the sets linked to each; edges (a, b) are links, enough of them to join what all links join."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, key = shingle_sets(Words(*utf8(batch.column("text"))), ngram)
            if len(doc):
                first, size, h1, h2 = set_keys(doc, key)
                sig = signatures(key, first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[first])), pa.array(h1), pa.array(h2), pa.array(size, pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "h1", "h2", "n", "sig"])

    sketches = written(rows.filter("doc_id is not null").mapInArrow(sketch, "doc_id long, h1 long, h2 long, n long, sig binary"), "sketches")
    reps = sketches.groupBy("h1", "h2", "n").agg(F.any_value("sig").alias("sig"))
    reps = written(reps.withColumn("c", F.monotonically_increasing_id()), "reps")
    members = written(sketches.drop("sig").join(reps.drop("sig"), ["h1", "h2", "n"]).select("doc_id", "c", "n"), "members")
    drop_written(spark, sketches)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, key = shingle_sets(Words(*utf8(batch.column("text"))), ngram)
            if len(doc):
                first, size, h1, h2 = set_keys(doc, key)
                data = [key[a : a + n].tobytes() for a, n in zip(first.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(size, pa.int64()), pa.array(data, pa.binary())], names=["h1", "h2", "n", "items"])

    def read(wanted: DataFrame) -> DataFrame:
        """(c, items) of the sets of a table of c, from the texts of one document a set; other rows that share its id drop out by their sets."""
        needed = written(members.join(wanted.distinct(), "c", "left_semi").groupBy("c").agg(F.min("doc_id").alias("doc_id")).join(reps.drop("sig"), "c"), "needed")
        n = needed.count()
        texts = rows.join(maybe_broadcast(needed.select("doc_id").distinct(), n, broadcast_rows), "doc_id", "left_semi")
        made = texts.select("text").mapInArrow(sets, "h1 long, h2 long, n long, items binary")
        return written(made.join(maybe_broadcast(needed.drop("doc_id"), n, broadcast_rows), ["h1", "h2", "n"]).groupBy("c").agg(F.any_value("items").alias("items")), "sets")

    pairs, dense, balls = Join(threshold, recall, limit, depth).candidates(reps.select("c", "n", "sig"), read)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, left, right in zip(*(batch.column(x).to_pylist() for x in ("block", "left", "right")), strict=True):
                c = np.union1d(np.frombuffer(left, np.int64), np.frombuffer(right, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), block)), pa.array(c)], names=["block", "c"])

    in_blocks = written(dense.select("block", "left", "right").mapInArrow(sides, "block long, c long"), "in_blocks")
    made = read(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).union(in_blocks.select("c")))
    # a set that many pairs begin with is sent to several tasks, each with a part of its partners
    parts = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / partners).cast("int").alias("parts")), "parts")
    own = made.join(parts.withColumnRenamed("a", "c"), "c").select(F.col("c").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.lit(False).alias("deep"), "items")
    other = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b", "deep")
    both = own.union(other.join(made.withColumnRenamed("c", "b"), "b").select("a", "part", "b", "deep", "items"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set comes before its partners; only one is held."""
        own, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for a, b, deep, items in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "deep", "items")), strict=True):
                other = np.frombuffer(items, np.uint64)
                if b is None:
                    own, mine = a, other
                elif a == own:
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if both >= threshold * (len(mine) + len(other) - both) - 1e-9:
                        good.append((a, b, deep))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "deep"])

    links = written(both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(verify, "a long, b long, deep boolean"), "links")

    def verify_block(left: pa.Table, right: pa.Table) -> pa.Table:
        """Edges (a, b) that join the block's links, and for each set its number of links, or the linked sets if the block is deep."""
        row = left.to_pylist()[0]
        items = {c: np.frombuffer(x.as_buffer(), np.uint64) for c, x in zip(right["c"].to_pylist(), right["items"], strict=True)}
        a, b = np.frombuffer(row["left"], np.int64), np.frombuffer(row["right"], np.int64)
        asked = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=len(a) * len(b)).reshape(len(a), len(b)).astype(bool)
        mine, other = [items[x] for x in a.tolist()], [items[x] for x in b.tolist()]
        both = common_items(mine, other)
        total = np.array([len(x) for x in mine])[:, None] + np.array([len(x) for x in other]) - both
        linked = asked & (both >= threshold * total - 1e-9)
        edges = spanning(a, b, linked)
        out = [(x, y, 0, None) for x, y in edges]
        for ids, partners_of, rows in ((a, b, linked), (b, a, linked.T)):
            some = np.flatnonzero(rows.any(1))
            out += [(int(ids[k]), None, 0, partners_of[rows[k]].tolist()) if row["deep"] else (int(ids[k]), None, int(rows[k].sum()), None) for k in some.tolist()]
        return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("partners", pa.list_(pa.int64()))))})

    fed = in_blocks.join(made, "c")
    counted = written(dense.groupBy("block").cogroup(fed.groupBy("block")).applyInArrow(verify_block, "a long, b long, n long, partners array<long>"), "block_links")
    drop_written(spark, made)
    ends = links.select(F.col("a").alias("c"), "b", "deep").union(links.select("b", "a", "deep"))
    once = ends.filter("not deep").select("c", F.lit(1).cast("long").alias("n")).union(counted.filter("b is null and partners is null").select("a", "n"))
    lists = ends.filter("deep").select("c", F.array("b").alias("partners")).union(counted.filter("partners is not null").select("a", "partners"))
    lists = lists.groupBy("c").agg(F.size(F.array_distinct(F.flatten(F.collect_list("partners")))).cast("long").alias("n"))
    sizes = balls.groupBy("ball").agg((F.count("*") - 1).alias("n"), F.min("c").alias("least"))
    in_ball = written(balls.join(sizes, "ball").filter("n > 0").select("c", "n", "least"), "in_ball")
    degrees = once.union(in_ball.select("c", "n")).union(lists).groupBy("c").agg(F.sum("n").alias("n_links"))
    edges = links.select("a", "b").union(counted.filter("b is not null").select("a", "b"))
    return members, degrees, edges.union(in_ball.filter("c <> least").select("least", "c"))


def jaccard_groups(docs: DataFrame, threshold: float = 0.8, ngram: int = 5, recall: float = 0.999, limit: int = 4096, depth: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, class_id (smallest id of all documents linked to it, over any number of links), n_links and set_size.

    Documents are linked when the sets of their distinct word n-grams (words as they stand, cut at white space; a text of
    fewer words is one shingle) have a Jaccard similarity of the threshold or more. Equal sets are one: they share class and links;
    n_links counts the other sets linked to a document's own. Links are found with chance `recall` or more at the
    threshold itself and verified exactly. Null or empty texts and rows without an id have no links and class_id is
    their own id. Rows that share an id are judged each by its text. An empty table gives no rows.
    """
    members, degree, edges = jaccard_links(docs, threshold, ngram, recall, limit, depth, id_col, text_col)
    parts = connected_components(edges, src="a", dst="b").withColumnRenamed("node", "c")
    sets = members.groupBy("c").agg(F.min("doc_id").alias("least"))
    sets = written(sets.join(parts, "c", "left").join(degree, "c", "left").withColumn("component", F.coalesce("component", "c")), "classes")
    classes = written(sets.groupBy("component").agg(F.min("least").alias("class_id")), "class_ids")
    named = written(sets.join(classes, "component").select("c", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "named")
    out = members.join(named, "c").select("doc_id", "class_id", "n_links", F.col("n").alias("set_size"))
    worded = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", "") != ""
    rest = docs.filter(F.col(id_col).isNull() | ~worded).select(F.col(id_col).cast("long").alias("doc_id"))
    return out.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("set_size")))
