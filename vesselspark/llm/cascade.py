"""URL filters: longest-match host and path rules, and a cascade of Bloom filters for exact membership in a list over a known universe of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import parts_for, written
from .text import finish

#: The default rules as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words of host names, cut at '.' and '-', whose urls are listed unless a rule says otherwise.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
CASCADE = "shard int, levels array<struct<bits: binary, size: long, hashes: int>>"


def host_of(url: Column) -> Column:
    """From the first '://' up to '/', '?', '#' or the end, A-Z lowered; empty for null or no '://'."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def winning_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent domain of it and whose path the url's begins with; nulls if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.concat(F.lit("second|"), key)).alias("h2")]


def places(h1: np.ndarray, h2: np.ndarray, level: int, size: int, k: int) -> np.ndarray:
    """The bits of one level that a key's two hashes pick."""
    a = finish(h1.astype(np.int64).view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    b = finish(h2.astype(np.int64).view(np.uint64) ^ np.uint64(level * 0xC2B2AE3D27D4EB4F % 2**64)) | np.uint64(1)
    return (a + np.arange(k, dtype=np.uint64)[:, None] * b) % np.uint64(size)


def holds(level: dict, number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(level["bits"], np.uint8)
    at = places(h1, h2, number, level["size"], level["hashes"])
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(0)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[dict]:
    """Level 0 holds the listed keys; each further level holds the keys of the other side that passed the level before, until none does."""
    inside, outside, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
    while len(inside):
        # the first level lets through about as many of the others as it holds, later levels about half
        rate = min(0.5, max(len(inside) / max(len(outside), 1), 1e-4)) * (0.7 if not levels else 1.0)
        k = max(1, round(-np.log2(rate)))
        size = max(64, int(np.ceil(1.45 * k * len(inside))))
        bits = np.zeros(-(-size // 8), np.uint8)
        at = places(h1[inside], h2[inside], len(levels), size, k)
        np.bitwise_or.at(bits, at.ravel() >> np.uint64(3), (1 << (at.ravel() & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        levels.append({"bits": bits.tobytes(), "size": size, "hashes": k})
        inside, outside = outside[holds(levels[-1], len(levels) - 1, h1[outside], h2[outside])], inside
        if len(levels) > 200:
            raise ValueError("a listed key and another one share both hashes")
    return levels


def member(levels: list[dict], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe: the parity of the first level that lacks the key."""
    out, live = np.zeros(len(h1), bool), np.arange(len(h1))
    for number, level in enumerate(levels):
        live = live[holds(level, number, h1[live], h2[live])]
        out[live] = number % 2 == 0
    return out


def build_cascade(universe: DataFrame, shard_keys: int = 100_000, listed: Column | None = None) -> DataFrame:
    """The written cascade of the rows of a universe of keys, one row of bit arrays a shard of about shard_keys keys by hash.

    Repeated keys count once; `listed` says of a key's rows whether it is listed, by default whether any row has the mark
    `listed`. An empty universe or list gives shards without levels, or no shard: nothing is a member.
    """
    keys = universe.groupBy("key").agg((F.max("listed") if listed is None else listed).alias("listed"))
    keys = written(keys.select(*key_hashes(F.col("key")), "listed"), "keys")
    n = parts_for(keys.sparkSession, keys.count(), shard_keys, least=1)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(rows["h1"].to_numpy(), rows["h2"].to_numpy(), rows["listed"].to_numpy(bool))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "levels": [levels]})

    return written(keys.withColumn("shard", F.pmod("h1", F.lit(n)).cast("int")).groupBy("shard").applyInPandas(build, CASCADE).withColumn("shards", F.lit(n)), "cascade")


def mark_members(rows: DataFrame, key: Column, cascade: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """rows with `listed`: whether the key is in the cascade's list; exact for keys of its universe.

    The bit arrays go to each task if they are within most_bytes, measured; no row is shuffled then. Beyond that, rows meet their
    shard's arrays by shard, each shard's rows cut in salted parts, since one key may hold a third of them.
    """
    shards = cascade.agg(F.max("shards")).first()[0] or 1
    size = cascade.select(F.explode("levels").alias("x")).agg(F.sum(F.length("x.bits"))).first()[0] or 0
    hashed = rows.select("*", *key_hashes(key)).withColumn("__shard", F.pmod("h1", F.lit(shards)).cast("int"))
    own = rows.columns
    columns = [*own, "listed"]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("listed", "boolean")])

    def mark(batch: pa.RecordBatch, levels: dict[int, list[dict]]) -> pa.RecordBatch:
        h1, h2, shard = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "__shard"))
        out = np.zeros(batch.num_rows, bool)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            out[at] = member(levels.get(int(s), []), h1[at], h2[at])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(out)], names=columns)

    if size <= most_bytes:
        sent = rows.sparkSession.sparkContext.broadcast({r["shard"]: [x.asDict() for x in r["levels"]] for r in cascade.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield mark(batch, sent.value)

        return hashed.mapInArrow(run, schema)

    salts = parts_for(rows.sparkSession, 8, 1)
    salted = hashed.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = cascade.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        levels = {r["shard"]: r["levels"] for r in right.to_pylist()}
        if not left.num_rows:
            return left.select(own).append_column("listed", pa.array([], pa.bool_()))
        return pa.Table.from_batches([mark(b, levels) for b in left.combine_chunks().to_batches()])

    by = salted.groupBy("__shard", "__salt").cogroup(copies.withColumnRenamed("shard", "__shard").withColumn("shard", F.col("__shard")).groupBy("__shard", "__salt"))
    return by.applyInArrow(meet, schema)


def judge_urls(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", most_bytes: int = 32 << 20,
    words: tuple[str, ...] = LISTED_WORDS, listed: DataFrame | None = None,
) -> DataFrame:
    """Each page's id, host, path, rule and verdict: block if the cascade holds its key, else allow.

    The key is host and path, the universe all keys of the pages. The cascade holds the keys that a blocking rule wins and, of
    those without a rule, the ones whose host has one of `words` among its parts between dots and hyphens, and those in the table
    `listed` (column key). Rules only name themselves and build the list: verdicts come from the cascade alone, so later stages
    can ask it without the rules. A null url or one without '://' has an empty host and path, no rule, and is not listed.
    Repeated rows and null ids are judged like others; other columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = winning_rule(F.col("host"), F.col("path"), rules)
    key = F.concat(F.col("host"), F.col("path"))
    named = F.arrays_overlap(F.split("host", "[.-]"), F.lit(list(words)).cast("array<string>"))
    # 3 and 2: a rule blocks or allows; 1 and 0: listed or not; the largest of a key's marks holds
    mark = F.when(verdict == "block", 3).when(verdict == "allow", 2).when(named, 1).otherwise(0)
    universe = rows.select(key.alias("key"), mark.alias("mark"))
    if listed is not None:
        universe = universe.unionByName(listed.filter("key is not null").select("key", F.lit(1).alias("mark")))
    cascade = build_cascade(universe, listed=F.max("mark").isin(1, 3))
    marked = mark_members(rows.withColumn("rule", rule), key, cascade, most_bytes)
    return marked.select("page_id", "host", "path", "rule", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
