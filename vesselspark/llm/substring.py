"""Substring dedup with fixed-block anchors: blocks of words are indexed, every rolling window probes them, and hits grow to maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, free_shuffles, parts_for, written
from .text import Words, pack, slices, unpack, utf8

#: Windows and documents that a bucket holds on average. Buckets grow in number with the table, not in size.
BUCKET_WINDOWS, BUCKET_DOCS = 1_000_000, 300
#: Marks of places: on a block, and already known as a hit (or a repeat), so that it only passes through its bucket.
BLOCK, KNOWN = 1, 2
#: Stands for a null id.
NO_ID = -(2**63)
PACKED = "bucket int, n int, docs binary, places binary, keys binary, more binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]
KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def packed(bucket: np.ndarray, doc: np.ndarray, place: np.ndarray, keys: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Rows of bucket, document id, word number and two key columns as one row a bucket of packed columns."""
    if not len(bucket):
        return pa.RecordBatch.from_arrays([pa.array([], k) for k in KINDS], names=NAMES)
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    bucket, doc, place, keys, more = (a[order] for a in (bucket, doc, place, keys, more))
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    rows = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        step = np.diff(place[a:b], prepend=0).astype(np.int32)
        rows.append((bucket[a], b - a, pack(np.diff(doc[a:b], prepend=0)), pack(step), pack(keys[a:b]), pack(more[a:b])))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


def unpacked(table: pa.Table, keys: type, more: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = table.to_pylist()
    docs = [np.cumsum(unpack(r["docs"], r["n"], np.int64)) for r in rows]
    places = [np.cumsum(unpack(r["places"], r["n"], np.int32)) for r in rows]
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(docs, np.int64), join(places, np.int64), join([unpack(r["keys"], r["n"], keys) for r in rows], keys), join([unpack(r["more"], r["n"], more) for r in rows], more)


def doc_buckets(doc: np.ndarray, n: int) -> np.ndarray:
    """The bucket of documents by id; the same rule as pmod() below."""
    return (doc % n).astype(np.int32)


def first_and_later(doc: np.ndarray, place: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first place by document and word of each window, places after it); windows at the same word of the same document count once."""
    order = np.lexsort((place, doc, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    # in the order they came: packed columns are small then
    return np.sort(order[new]), np.sort(order[(doc[order] != doc[first]) | (place[order] != place[first])])


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, kept (kept words joined by a space, or the SHA-256 of that if digest) and spans (first word and length of each maximal removed repeat).

    A word goes if a window of `window` words that covers it starts earlier too: in a document with a smaller id, or
    earlier in its own. Windows are judged on the input. Null counts as empty; a null id counts as smaller than all
    others. Rows that share an id count as one document: a window is not earlier than one at the same word of a row
    with the same id.

    1. Anchors. Blocks of window // 2 words at whole multiples of that length are the index, all rolling windows of that
       length the probes: any repeat of `window` words holds a whole block on either side. Hashes meet by bucket as
       packed columns; places whose hash comes twice, once as a block, are hits. 2. Extension. Windows of `window` words around hits get
       96-bit hashes; those that come first by (id, word) stay, the others are repeats, and overlapping ones make up the
       maximal repeats. Both steps settle what they can within a batch of texts, so a window that very many texts share
       sends its bucket one place a batch. Hash equality stands for word equality (96 bits, compared within a bucket only). 3. Each document's removed words are cut out.
    """
    block = window // 2
    out = (lambda data: hashlib.sha256(data).hexdigest()) if digest else bytes.decode
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    n_docs, n_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = parts_for(spark, (n_bytes or 0) / 6, BUCKET_WINDOWS)
    parts = parts_for(spark, n_docs, BUCKET_DOCS)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            ids = batch.column("doc").to_numpy()
            words = Words(*utf8(batch.column("text")))
            where, key = words.windows(words.hashes(), block)
            if len(where):
                # bucket and these 32 bits tell windows apart well enough; what they let through, step 2 drops
                low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                bucket, doc, place = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), ids[words.doc[where]], words.pos[where]
                mark = (place % block == 0).astype(np.uint8) * np.uint8(BLOCK)
                # a window that comes again here, once as a block, is a hit at all its places: one of them stands for it at its bucket, so a window that fills a third of all texts costs its bucket a place a batch
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
                count = np.diff(np.r_[first, len(key)])
                sure = (count > 1) & (np.add.reduceat(mark[order].astype(np.int64), first) > 0)
                known = order[np.repeat(sure, count)]
                bucket[known], mark[known], kept = doc_buckets(doc[known], buckets), KNOWN, low[order[first[sure]]]
                low[known] = 0
                own = order[first[sure]]
                bucket[own], mark[own], low[own] = (key[own] >> np.uint64(32)) % np.uint64(buckets), BLOCK | KNOWN, kept
                yield packed(bucket, doc, place, low, mark)

    def meet(table: pa.Table) -> pa.Table:
        doc, place, key, mark = unpacked(table, np.uint32, np.uint8)
        known, order = np.flatnonzero(mark & KNOWN), np.flatnonzero(mark != KNOWN)
        order = order[np.argsort(key[order], kind="stable")]
        if not len(order):
            at, none = known, np.zeros(len(known), np.uint8)
            return pa.Table.from_batches([packed(doc_buckets(doc[at], parts), doc[at], place[at], none, none)])
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        count = np.diff(np.r_[first, len(order)])
        hit = (count > 1) & (np.add.reduceat(mark[order].astype(np.int64) & BLOCK, first) > 0)
        at = np.union1d(known, order[np.repeat(hit, count)])
        none = np.zeros(len(at), np.uint8)
        return pa.Table.from_batches([packed(doc_buckets(doc[at], parts), doc[at], place[at], none, none)])

    hits = written(rows.mapInArrow(probe, PACKED).groupBy("bucket").applyInArrow(meet, PACKED), "hits")
    free_shuffles(spark)
    part = F.pmod("doc", F.lit(parts)).cast("int")
    out_names = ["kind", "doc", "text", "n_words", *NAMES]

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        """Documents without a hit are done. Others go on with their text, and their windows around hits as packed rows."""
        doc, place, _, _ = unpacked(right, np.uint8, np.uint8)
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        pieces = []
        for batch in slices(iter(left.select(["doc", "text"]).combine_chunks().to_batches()), "text", 4 << 20):
            ids = batch.column("doc").to_numpy()
            words = Words(*utf8(batch.column("text")))
            begin, end = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
            near = np.zeros(len(words.start) + 1, np.int64)
            for row in np.flatnonzero(end > begin).tolist():
                own = place[begin[row] : end[row]]
                own = own[own < words.n[row]] + words.base[row]
                np.add.at(near, np.maximum(own - (window - block), words.base[row]), 1)
                np.add.at(near, own + 1, -1)
            some = np.cumsum(near[:-1]) > 0
            again = np.zeros(len(ids), bool)
            if some.any():
                where, h1 = words.windows(words.hashes(1), window, 1)
                own = some[where]
                where, h1 = where[own], h1[own]
                _, h2 = words.windows(words.hashes(2), window, 2)
                h2 = (h2[own] >> np.uint64(32)).astype(np.uint32)
                again[words.doc[where]] = True
                own, at = ids[words.doc[where]], words.pos[where]
                # only the first of equal windows is judged against other batches; those after it are repeats already
                first, later = first_and_later(own, at, h1, h2)
                none = np.zeros(len(later), np.uint8)
                for kind, piece in (("windows", packed((h1[first] % np.uint64(buckets)).astype(np.int32), own[first], at[first], h1[first], h2[first])), ("repeats", packed(doc_buckets(own[later], parts), own[later], at[later], none, none))):
                    pieces.append(pa.table({"kind": pa.array([kind] * piece.num_rows, pa.string()), "doc": pa.nulls(piece.num_rows, pa.int64()), "text": pa.nulls(piece.num_rows, pa.string()), "n_words": pa.nulls(piece.num_rows, pa.int64())} | dict(zip(NAMES, piece.columns, strict=True))))
            texts = batch.column("text").to_pylist()
            kept = [t if a else out(joined(words, r)) for r, (t, a) in enumerate(zip(texts, again, strict=True))]
            pieces.append(pa.table({"kind": pa.array(np.where(again, "go on", "done").tolist(), pa.string()), "doc": pa.array(ids), "text": pa.array(kept, pa.string()), "n_words": pa.array(words.n, pa.int64())} | {n: pa.nulls(len(ids), k) for n, k in zip(NAMES, KINDS, strict=True)}))
        return pa.concat_tables(pieces) if pieces else pa.table({n: pa.array([], k) for n, k in zip(out_names, [pa.string(), pa.int64(), pa.string(), pa.int64(), *KINDS], strict=True)})

    state = rows.withColumn("bucket", part).groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(extend, f"kind string, doc long, text string, n_words long, {PACKED}")
    state = written(state, "state")
    drop_written(spark, hits)
    del hits
    free_shuffles(spark)

    def judge(table: pa.Table) -> pa.Table:
        doc, place, h1, h2 = unpacked(table, np.uint64, np.uint32)
        later = first_and_later(doc, place, h1, h2)[1]
        none = np.zeros(len(later), np.uint8)
        return pa.Table.from_batches([packed(doc_buckets(doc[later], parts), doc[later], place[later], none, none)])

    repeats = state.filter("kind = 'windows'").select(*NAMES).groupBy("bucket").applyInArrow(judge, PACKED)
    repeats = repeats.unionByName(state.filter("kind = 'repeats'").select(*NAMES))
    span = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, place, _, _ = unpacked(right, np.uint8, np.uint8)
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        pieces = []
        for batch in slices(iter(left.select(["doc", "text"]).combine_chunks().to_batches()), "text", 4 << 20):
            ids = batch.column("doc").to_numpy()
            words = Words(*utf8(batch.column("text")))
            begin, end = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
            kept, removed, spans = [], [], []
            for row in range(len(ids)):
                own = place[begin[row] : end[row]]
                own = own[own + window <= words.n[row]]
                cover = np.zeros(int(words.n[row]) + 1, np.int64)
                np.add.at(cover, own, 1)
                np.add.at(cover, own + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept.append(out(joined(words, row, ~gone)))
                removed.append(int(gone.sum()))
                spans.append([{"first": a, "length": b - a} for a, b in runs_of(gone)])
            pieces.append(pa.table({"doc_id": pa.array(ids), "n_words": pa.array(words.n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, span)}))
        return pa.concat_tables(pieces) if pieces else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string()), "spans": pa.array([], span)})

    schema = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first: long, length: long>>"
    going = state.filter("kind = 'go on'").select("doc", "text", part.alias("bucket"))
    changed = going.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(cut, schema)
    same = state.filter("kind = 'done'").select(F.col("doc").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("text").alias("kept"), F.array().cast("array<struct<first: bigint, length: bigint>>").alias("spans"))
    return changed.unionByName(same).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def joined(words: Words, row: int, keep: np.ndarray | None = None) -> bytes:
    """A document's words, or those to keep, joined by one space. bytes.split() cuts at the very bytes that end a word here."""
    parts = words.data[words.offsets[row] : words.offsets[row + 1]].tobytes().split()
    return b" ".join(parts if keep is None else compress(parts, keep.tolist()))
