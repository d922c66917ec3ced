"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from . import bpe, cascade, conversation, cpsjoin, dac, exact, licence, mixing, periodic, pii, quality, substring, vamana


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = partial(bpe.from_ranks, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = bpe.encode_documents(table(spark, sf_dir, "documents"), load, ("n_tokens", "ids", "decoded"), keep=["doc_id"])
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return rows.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    dac.write_tokens(table(spark, sf_dir, "documents"), partial(bpe.from_json, public_tokenizers.path("byte_bpe_50k.json")), path)
    return dac.read_tokens(spark, path)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpsjoin.jaccard_groups(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact.progressive_dedup(docs, carry=["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vamana.search_index(vamana.build_index(vectors), vectors.filter("vec_id % 50 = 0"))


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judge_urls(table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH h AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS x FROM pages),
p AS (SELECT page_id, translate(x.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.path AS path FROM h),
r AS (SELECT *, split_part(rule, '/', 1) AS own, substr(rule, strpos(rule, '/')) AS start FROM (VALUES ('allow', 'org/'),
      ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')) v(verdict, rule)),
m AS (SELECT page_id, host, path, rule, verdict, length(rule) AS n FROM p LEFT JOIN r
      ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC) = 1
"""


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licence.scan_licences(table(spark, sf_dir, "documents"))
    own = F.transform(F.filter("spans", lambda s: s["coverage"] >= 0.6), lambda s: s["label"])
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["first"])
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base))).alias("base_labels"), F.concat_ws(",", F.array_sort(F.array_union(base, own))).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_conversations(conversation.damaged(table(spark, sf_dir, "conversations")), absent="absent")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_personal(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, pii.BASE), F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.find_runs(periodic.made_periodic(table(spark, sf_dir, "documents")), digest=True)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))))
    rows = rows.withColumn("longest", longest)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: The target shares of op8: two sources are raised, one is lowered, the others get one part each.
WEIGHTS = {"src0": 2.0, "src1": 4.0, "src2": 0.5}


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), WEIGHTS)


OP8_SQL = """
WITH RECURSIVE
s AS (SELECT coalesce(source, '') AS src, count(*)::DOUBLE AS n,
             CASE coalesce(source, '') WHEN 'src0' THEN 2.0 WHEN 'src1' THEN 4.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END::DOUBLE AS w
      FROM documents GROUP BY ALL),
r AS (SELECT src, w * (SELECT sum(n) FROM s) / ((SELECT sum(w) FROM s) * n) AS rate FROM s),
c AS (SELECT src, rate, 0 AS k, -rate AS log_p, exp(-rate) AS cdf FROM r
      UNION ALL
      SELECT src, rate, k + 1, log_p + ln(rate) - ln((k + 1)::DOUBLE), cdf + exp(log_p + ln(rate) - ln((k + 1)::DOUBLE))
      FROM c WHERE k < ceil(rate + 10 * sqrt(rate) + 20)),
d AS (SELECT *, coalesce(source, '') AS src, ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM documents),
m AS (SELECT d.doc_id, count(*) AS n_copies FROM d JOIN c ON c.src = d.src AND c.cdf <= d.u GROUP BY d.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, x.copy, m.n_copies,
       md5('7|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || x.copy::VARCHAR) AS shuffle_key
FROM d JOIN m USING (doc_id), LATERAL (SELECT unnest(range(m.n_copies)) AS copy) x
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_substring_dedup, op3_token_files, op4_ngram_join, op5_exact_dedup, op6_graph_neighbours, op7_url_cascade, op8_poisson_mix, op9_licence_scan, op10_quality, op11_conversation_repair, op12_personal_data, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op7_url_cascade": OP7_SQL, "op8_poisson_mix": OP8_SQL}
