"""Registered queries of this subpackage: each operator over its whole table, with the parameters meant for use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldlens.llm import block_naming, compression, fingerprints, mixing, ngram_join, packing, repeats, reply_trees, sharding, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(_read(spark, sf_dir, "documents"))


def op2_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.dedup(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees.digests(reply_trees.with_probe(_read(spark, sf_dir, "conversations")))


def op6_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)


def op7_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"))


def op8_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), [1.0, 2.0, 3.0])


def queries() -> dict:
    found = [op1_syncmers, op2_block_naming, op3_toxicity, op4_packing, op5_reply_trees, op6_rendezvous, op7_prefix_doubling, op8_compression, op9_ngram_join, op10_mixing]
    return {f.__name__: f for f in found}


OP2_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  -ln((('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / greatest(0.05, 1.0 - 5.0 * (length(coalesce(text, ''))
    - length(regexp_replace(coalesce(text, ''), '[$%&*#|^~<>{}\[\]\\=_@]', '', 'g'))) / greatest(length(coalesce(text, '')), 1)) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
r AS (SELECT *, 3.0 * source_size / weight AS ratio FROM w),
c AS (SELECT *, coalesce(sum(source_size) OVER b, 0)::DOUBLE AS cs, coalesce(sum(weight) OVER b, 0)::DOUBLE AS cw, sum(source_size) OVER ()::DOUBLE AS al, sum(weight) OVER ()::DOUBLE AS aw
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (al - 3.0 * cs) / (aw - cw) AS level FROM c),
t AS (SELECT source, source_size, least(3.0 * source_size, weight * (SELECT min_by(level, ratio) FROM l WHERE level <= ratio))::DOUBLE AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
k AS (SELECT d.*, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS budget,
  (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM k
"""


def oracle_sql() -> dict[str, str]:
    probe = "'" + reply_trees.PROBE + "'"
    turns = f"SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', {probe}), (-1, 1, 'assistant', {probe})"
    return {"op2_block_naming": OP2_SQL, "op5_reply_trees": reply_trees.digests_sql(turns), "op10_mixing": OP10_SQL}
