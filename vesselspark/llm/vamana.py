"""Approximate nearest neighbours by cosine: a robust-pruned directed graph in each shard, searched by beams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import parts_for, written

INDEX = "shard int, dims int, n int, vectors binary, leaders binary, edges binary, ids array<array<long>>"


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, width: int, hop: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy search of all queries in step: (nodes nearest first, distances), each (queries, width) with -1 where fewer, and how many nodes each query looked at.

    Each step expands the `hop` nearest nodes of each beam that were not expanded yet, until every beam is done.
    """
    q, n = len(queries), len(x)
    width = min(width, n)
    nodes = np.full((q, width), -1)
    far = np.full((q, width), np.inf, np.float32)
    done = np.ones((q, width), bool)
    nodes[:, 0], far[:, 0], done[:, 0] = start, 1 - queries @ x[start], False
    seen = np.zeros((q, n + 1), bool)
    seen[:, start] = seen[:, n] = True
    live = np.arange(q)
    while len(live):
        pick = np.argsort(done[live], axis=1, kind="stable")[:, :hop]
        fresh = ~np.take_along_axis(done[live], pick, 1)
        at = np.where(fresh, np.take_along_axis(nodes[live], pick, 1), -1)
        done[live[:, None], pick] = True
        near = np.where(at[:, :, None] >= 0, edges[at], -1).reshape(len(live), -1)
        near[near < 0] = n
        near = np.sort(np.where(seen[live[:, None], near], n, near), 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[live[:, None], near] = True
        gap = 1 - np.einsum("qkd,qd->qk", x[np.minimum(near, n - 1)], queries[live])
        gap[near == n] = np.inf
        all_far = np.concatenate([far[live], gap.astype(np.float32)], 1)
        order = np.argsort(all_far, 1, kind="stable")[:, :width]
        far[live] = np.take_along_axis(all_far, order, 1)
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], np.where(near == n, -1, near)], 1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near == n], 1), order, 1)
        live = live[~done[live].all(1)]
    return nodes, far, seen[:, :n].sum(1)


def robust_prune(x: np.ndarray, points: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point up to `degree` of its candidates `near` (-1: none): again and again the nearest one left, after which every candidate goes that lies alpha times nearer to it than to the point."""
    near = near.copy()
    near[near == points[:, None]] = -1
    away = 1 - np.einsum("pkd,pd->pk", x[near], x[points])
    away[near < 0] = np.inf
    order = np.argsort(away, 1, kind="stable")
    near, away = np.take_along_axis(near, order, 1), np.take_along_axis(away, order, 1)
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    vectors = x[near]
    for k in range(degree):
        best = np.argmin(away, 1)
        some = np.isfinite(away[rows, best])
        if not some.any():
            break
        out[:, k] = np.where(some, near[rows, best], -1)
        between = 1 - np.einsum("pkd,pd->pk", vectors, vectors[rows, best])
        away[(alpha * between <= away) & some[:, None]] = np.inf
        away[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int, width: int, alpha: float, batch: int = 128) -> tuple[np.ndarray, int]:
    """(edges, start): points come in growing batches; greedy searches from the centre propose neighbours, pruning keeps diverse ones, and edges go back, pruned again where a point has too many. A second round over all points relaxes the pruning by alpha."""
    n = len(x)
    start = int(np.argmax(x @ x.mean(0)))
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(5).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    for relax in (1.0, alpha):
        begin = 1 if relax == 1.0 else 0
        while begin < n:
            end = min(n, begin + (min(batch, max(1, begin)) if relax == 1.0 else batch))
            points = order[begin:end]
            found = beam_search(x, edges, x[points], start, width)[0]
            near = np.concatenate([found, edges[points]], 1)
            edges[points] = robust_prune(x, points, near, degree, relax)
            add_back(x, edges, points, degree, relax)
            begin = end
    return edges, start


def add_back(x: np.ndarray, edges: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    """Edges from the neighbours of points back to them."""
    to, source = edges[points].ravel(), np.repeat(points, degree)
    source, to = source[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    targets, first, count = np.unique(to, return_index=True, return_counts=True)
    extra = np.full((len(targets), int(count.max(initial=0))), -1)
    extra[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(first, count)] = source
    near = np.sort(np.concatenate([edges[targets], extra], 1), 1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    full = (near >= 0).sum(1) > degree
    packed = -np.sort(-near, 1)[:, :degree]
    edges[targets[~full]] = packed[~full]
    for begin in range(0, int(full.sum()), 256):
        some = np.flatnonzero(full)[begin : begin + 256]
        edges[targets[some]] = robust_prune(x, targets[some], near[some], degree, alpha)


def direction(embedding: F.Column) -> F.Column:
    """A vector by its largest entry: parallel vectors, if their multiples are exact, become equal."""
    most = F.array_max(F.transform(embedding, F.abs))
    return F.transform(embedding, lambda v: v / most)


def float_error(dims: int) -> float:
    """Bound of the error of a cosine of unit vectors in single precision, and of the difference of two."""
    return (dims + 4) * 2.0**-23


def leaders(x: np.ndarray) -> np.ndarray:
    """For each vector a leader that single precision can't tell from it, itself or one before it; leaders can be told apart.

    Vectors that near lie as near on any line, so only those next to each other on one are compared.
    """
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    line = np.random.default_rng(2).normal(size=x.shape[1])
    at, reach = u @ (line / np.linalg.norm(line)), 1.01 * np.sqrt(4 * float_error(x.shape[1]))
    order = np.argsort(at, kind="stable")
    low, high = np.searchsorted(at[order], at - reach, "left"), np.searchsorted(at[order], at + reach, "right")
    out = np.full(len(x), -1)
    for k in range(len(x)):
        if out[k] < 0:
            near = order[low[k] : high[k]]
            near = near[out[near] < 0]
            out[near[u[near] @ u[k] >= 1 - 2 * float_error(x.shape[1])]] = k
            out[k] = k
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding as doubles, dims) of rows whose vector is neither null nor zero and holds finite numbers only."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter("vec_id is not null").filter(finite & F.exists("embedding", lambda v: v != 0)).withColumn("dims", F.size("embedding"))


def build_index(vectors: DataFrame, k: int = 5, shard_size: int = 20_000, degree: int = 32, width: int = 64, alpha: float = 1.2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The written index: a row a shard with its distinct vectors, graph, and the k + 1 smallest ids of each vector.

    Every usable vector is in it. Parallel vectors are one node, and nodes that single
    precision can't tell apart are one node of the graph, all of whose vectors a search scores; since no search for k answers can need more than their
    k + 1 smallest ids, those are picked before the shuffle, so a vector that a third of the rows share costs no more
    than another. Shards hold about shard_size vectors by hash, so their number grows with the table and their size doesn't.
    """
    rows = usable(vectors, id_col, vector_col).withColumn("embedding", direction(F.col("embedding"))).distinct()
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    nodes = written(few.groupBy("dims", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = parts_for(vectors.sparkSession, nodes.count(), shard_size, least=1)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda c: c.map(lambda ids: ids[0]))
        x = np.stack(rows["embedding"].to_numpy())
        lead = leaders(x)
        edges, start = build_graph(unit(x[np.unique(lead)]), degree, width, alpha)
        edges = np.concatenate([np.full((1, degree), start), edges])
        return pd.DataFrame({"shard": [key[1]], "dims": [key[0]], "n": [len(x)], "vectors": [x.tobytes()], "leaders": [lead.astype(np.int32).tobytes()], "edges": [edges.astype(np.int32).tobytes()], "ids": [rows["ids"].tolist()]})

    return written(nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")).groupBy("dims", "shard").applyInPandas(build, INDEX), "index")


class Shard:
    """A shard's graph, ready to be searched."""

    def __init__(self, row: dict):
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dims"])
        own_leader = np.frombuffer(row["leaders"], np.int32)
        lead, group = np.unique(own_leader, return_inverse=True)
        self.members, self.first = np.argsort(group, kind="stable"), np.searchsorted(np.sort(group), np.arange(len(lead) + 1))
        edges = np.frombuffer(row["edges"], np.int32).reshape(len(lead) + 1, -1)
        self.start, self.follow, self.ids = int(edges[0, 0]), edges[1:].astype(np.int64), row["ids"]
        self.nodes, norms = unit(self.x[lead]), np.linalg.norm(self.x, axis=1)
        self.radius = np.sqrt(2 * np.maximum(0, 1 - np.einsum("nd,nd->n", self.x, self.x[own_leader]) / (norms * norms[own_leader])).max()) * 1.01

    def search(self, own: list[int], q: np.ndarray, k: int, width: int) -> list[tuple[int, int, float]]:
        """(query, id, score) of the nearest of up to 256 queries."""
        x = self.x
        found, away = beam_search(self.nodes, self.follow, unit(q), self.start, width)[:2]
        # no vector outside a beam is more alike than its last node allows
        edge = np.arccos(np.clip(1 - np.where(found[:, -1] < 0, 0, away[:, -1]) + float_error(x.shape[1]), -1, 1)) - self.radius
        limit = np.where(edge > 0, np.cos(np.maximum(edge, 0)), np.inf)
        out = []
        for query, vector, near, most in zip(own, q, found, limit.tolist(), strict=True):
            near = near[near >= 0]
            if len(self.nodes) < len(x):
                near = np.concatenate([self.members[self.first[g] : self.first[g + 1]] for g in near])
            hits = best_hits(query, near, cosine(x[near], vector), self.ids, k)
            if len(near) < len(x) and (len(hits) < k or hits[-1][2] <= most):
                hits = best_hits(query, np.arange(len(x)), cosine(x, vector), self.ids, k)
            out += hits
        return out


def search_index(index: DataFrame, queries: DataFrame, k: int = 5, width: int = 48, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found by cosine, its own id left out, ties to the smaller id.

    Each shard is sent to one task, once, and the queries go to it and stream by behind it, so neither vectors nor graphs are sent again however many
    queries there are, and a task holds one shard and one batch of queries. A shard's graph is searched by beams of `width`, which look at some hundreds
    of its nodes, and all vectors of the beam's nodes are scored exactly in double precision. Where the beam's last node is within the error of single
    precision (and the nodes' radius) of the k-th best, or the beam found fewer nodes than it has room for, the whole
    shard is scored. Queries whose vector is unusable give no rows, as do queries with
    nothing to find; a vector is only compared with vectors of its own length. Rows that share a query's id and vector
    count once.
    """
    spark = index.sparkSession
    asked = usable(queries, id_col, vector_col).distinct().select(F.col("vec_id").alias("query_id"), "embedding", "dims")
    last = index.agg(F.max("shard")).first()[0] or 0
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    names = [c for c in index.columns if c not in ("shard", "dims")]
    stream = index.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True).select("dims", "shard", "asks", "query_id", "embedding", *names)
    # as many tasks as shards at least
    few = last + 1 <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (stream.repartition("dims", "shard") if few else stream.repartition(last + 1, "dims", "shard")).sortWithinPartitions("dims", "shard", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        for batch in batches:
            asks, keys = batch.column("asks").to_pylist(), list(zip(batch.column("dims").to_pylist(), batch.column("shard").to_pylist(), strict=True))
            at = 0
            while at < batch.num_rows:
                if not asks[at]:
                    key, shard, at = keys[at], Shard(batch.slice(at, 1).to_pylist()[0]), at + 1
                    continue
                end = at + 1
                while end < batch.num_rows and end - at < 256 and asks[end] and keys[end] == keys[at]:
                    end += 1
                if keys[at] == key:
                    own = batch.slice(at, end - at)
                    q = np.asarray(pc.list_flatten(own.column("embedding")), np.float64).reshape(end - at, -1)
                    hits = shard.search(own.column("query_id").to_pylist(), q, k, width)
                    yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])
                at = end

    hits = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision."""
    return x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))


def best_hits(own: int, nodes: np.ndarray, score: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int, float]]:
    """(own, id, score) of the k best distinct ids of nodes but own, ties to the smaller id."""
    best: dict[int, float] = {}
    last = -np.inf
    for at in np.argsort(-score, kind="stable").tolist():
        if len(best) >= k and score[at] < last:
            break
        last = score[at]
        for i in ids[nodes[at]]:
            if i != own:
                best.setdefault(int(i), float(last))
    return sorted(((own, i, s) for i, s in best.items()), key=lambda h: (-h[2], h[1]))[:k]
