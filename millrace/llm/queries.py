"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, embeddings, languages, minhash, mixing, quality, records, scratch, sharding, substrings, urls

MULTILINGUAL = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENGLISH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: (host, path, verdict)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
SHARDS = 24
END_ID = 2


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, MULTILINGUAL, public_tokenizers.PATTERN, decoded="decoded"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_documents(spark, sf_dir), SHARDS)


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write(_documents(spark, sf_dir), ENGLISH, END_ID, scratch.folder(spark, "records"))
    return records.read(spark, manifest).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality.judge(_documents(spark, sf_dir).select("doc_id", "text"), trusted)  # no other column is read
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = languages.train(docs.filter(~languages.held_out(F.col("doc_id"))), PIECES)
    found = languages.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_urls, op3_minhash, op4_mixing, op5_sharding, op6_records, op7_embeddings, op8_quality, op9_language, op10_substrings)}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op2_urls": """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT p.page_id, p.host, p.path, f.rule AS rule, coalesce(f.r_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
""",
    "op4_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), r AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS lim, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM s
), c AS (
  SELECT *, CAST(coalesce(sum(lim) OVER q, 0) AS DOUBLE) AS lim_before, CAST(coalesce(sum(w) OVER q, 0) AS DOUBLE) AS w_before,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total, CAST(sum(w) OVER () AS DOUBLE) AS w_all
  FROM r WINDOW q AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), x AS (
  SELECT *, (total - lim_before) / (w_all - w_before) AS rate FROM c
), y AS (
  SELECT *, (SELECT arg_min(z.rate, z.lim_before) FROM x z WHERE z.rate <= z.ratio) AS the_rate FROM x
), t AS (
  SELECT source, source_size, CASE WHEN lim <= the_rate * w THEN lim ELSE the_rate * w END AS target FROM y
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t
), e AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, target - passes * source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e
""",
    "op7_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  AND len(list_filter(x, lambda c: c <> 0)) > 0
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93
), reach(u, v) AS (
  SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u
), least AS (
  SELECT u, min(v) AS m FROM reach GROUP BY u
), n AS (
  SELECT u, count(*) AS n_links FROM link GROUP BY u
)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(least.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(least.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN least ON least.u = e.vec_id
""",
}
