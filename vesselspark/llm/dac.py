"""Token files of directly addressable codes: ids split into byte levels with continuation bitmaps and rank directories."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import WordBpe
from .text import pack, slices, unpack

#: Bits of a chunk, and bits that one entry of the rank directory covers.
CHUNK, RANKED = 8, 512


def dac_encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of chunks, lowest first. All but the last have a bitmap (bit i: chunk i goes on in the next level) and its rank directory (set bits before each 512)."""
    rest, levels = ids.astype(np.uint64), []
    while True:
        more = rest >> np.uint64(CHUNK) > 0
        level = {"chunks": (rest & np.uint64(255)).astype(np.uint8).tobytes(), "bitmap": b"", "ranks": b""}
        levels.append(level)
        if not more.any():
            return levels
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANKED // 8), np.uint8)])
        counts = np.bitwise_count(bits.reshape(-1, RANKED // 8)).sum(1, dtype=np.uint32)
        level |= {"bitmap": bits.tobytes(), "ranks": (np.cumsum(counts, dtype=np.uint32) - counts).astype(np.uint32).tobytes()}
        rest = rest[more] >> np.uint64(CHUNK)


def dac_decode(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    parts = [np.frombuffer(x["chunks"], np.uint8).astype(np.uint32) for x in levels]
    for k in range(len(levels) - 2, -1, -1):
        more = np.unpackbits(np.frombuffer(levels[k]["bitmap"], np.uint8), count=len(parts[k]), bitorder="little").astype(bool)
        parts[k][more] += parts[k + 1] << np.uint32(CHUNK)
    return parts[0]


def dac_get(levels: list[dict[str, bytes]], at: np.ndarray) -> np.ndarray:
    """The ids at some places, without decoding others: each level is one lookup, the next place the rank of the set bit."""
    at = np.asarray(at, np.int64)
    out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
    for k, level in enumerate(levels):
        out[live] |= np.frombuffer(level["chunks"], np.uint8)[at].astype(np.uint32) << np.uint32(CHUNK * k)
        if not level["bitmap"]:
            return out
        bits = np.frombuffer(level["bitmap"], np.uint8)
        more = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
        at, live = at[more], live[more]
        block = at // RANKED
        inside = bits.reshape(-1, RANKED // 8)[block]
        mask = np.arange(RANKED // 8) < ((at % RANKED) >> 3)[:, None]
        part = inside[np.arange(len(at)), (at % RANKED) >> 3] & ((1 << (at & 7).astype(np.uint8)) - 1).astype(np.uint8)
        at = np.frombuffer(level["ranks"], np.uint32)[block].astype(np.int64) + np.bitwise_count(np.where(mask, inside, 0)).sum(1, dtype=np.int64) + np.bitwise_count(part).astype(np.int64)
    return out


DIRECTORY = ("shard", "segment", "first_token", "n_tokens", "n_docs", "min_doc_id", "max_doc_id", "doc_ids", "known", "lengths")
SEGMENT = "shard int, segment int, first_token long, n_tokens long, n_docs int, min_doc_id long, max_doc_id long, doc_ids binary, known binary, lengths binary, levels array<struct<chunks: binary, bitmap: binary, ranks: binary>>"
LEVELS = pa.list_(pa.struct([("chunks", pa.binary()), ("bitmap", pa.binary()), ("ranks", pa.binary())]))


def write_tokens(docs: DataFrame, load: Callable[[], WordBpe], path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = 1 << 18) -> None:
    """Writes the ids of all texts, an end id after each, in ascending order of id (null first; ties by text) as path/segments and path/shards.

    A segment is a row with whole documents of about segment_tokens ids: a directory of documents and the levels of its
    ids. Shards are the range partitions; path/shards has the number of all tokens before each. Null counts as empty.
    An empty table gives no segment. Spark's commit makes a lost task's files whole again.
    """
    names = [*DIRECTORY, "levels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, shard, segment, first = load(), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal segment, first
            ids = np.concatenate([x for _, x in held])
            doc_ids = [i for i, _ in held]
            some = [i for i in doc_ids if i is not None]
            row = [shard, segment, first, len(ids), len(held), min(some, default=None), max(some, default=None)]
            row += [pack(np.diff(np.array([i or 0 for i in doc_ids], np.int64), prepend=0)), np.array([i is not None for i in doc_ids], np.uint8).tobytes(), pack(np.array([len(x) for _, x in held], np.int64)), dac_encode(ids)]
            segment, first = segment + 1, first + len(ids)
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), LEVELS]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        size = 0
        for batch in slices(batches, "text"):
            for i, ids in zip(batch.column("id").to_pylist(), bpe.encode(batch.column("text").to_pylist()), strict=True):
                held.append((i, np.append(ids, np.uint32(end_id))))
                size += len(ids) + 1
                if size >= segment_tokens:
                    yield close()
                    size = 0
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(run, SEGMENT).write.parquet(f"{path}/segments")
    shards = docs.sparkSession.read.parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards.withColumn("tokens_before", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row per document of the files at path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit), and its ids if asked for."""
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    rows = segments.join(spark.read.parquet(f"{path}/shards").select("shard", "tokens_before"), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = dac_decode(row["levels"]).astype("<u4")
                lengths = unpack(row["lengths"], row["n_docs"], np.int64)
                doc_ids = np.cumsum(unpack(row["doc_ids"], row["n_docs"], np.int64))
                ends = np.cumsum(lengths)
                own = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                out = [pa.array(doc_ids, mask=np.frombuffer(row["known"], np.uint8) == 0), pa.array(row["tokens_before"] + row["first_token"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                if with_ids:
                    out.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_token(spark: SparkSession, path: str, at: int) -> int | None:
    """The id at one place of all tokens: a filter picks the segment's row, one lookup a level the id."""
    shards = spark.read.parquet(f"{path}/shards").filter(F.col("tokens_before") <= at).orderBy(F.desc("tokens_before")).limit(1)
    hit = shards.select("shard", "tokens_before").first()
    if hit is None:
        return None
    local = at - hit["tokens_before"]
    row = spark.read.parquet(f"{path}/segments").filter((F.col("shard") == hit["shard"]) & (F.col("first_token") <= local) & (F.col("first_token") + F.col("n_tokens") > local)).first()
    return None if row is None else int(dac_get([x.asDict() for x in row["levels"]], [local - row["first_token"]])[0])
