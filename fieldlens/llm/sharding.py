"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import group_slots

#: Hex digits of an MD5 that fit a double's fraction exactly.
HEX = 13


def rendezvous(key: Column, weights: list[float], salt: str = "") -> Column:
    """The shard (index into weights) that wins the key.

    Each shard draws u from MD5 of "salt key:shard" and scores -ln(u) / weight; the lowest score wins, so a shard wins
    keys in proportion to its weight, and a shard that joins only takes keys to itself. Ties go to the lower index.
    A null key counts as the text "null".
    """
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def score(i: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(F.lit(salt), name, F.lit(f":{i}"))), 1, HEX)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HEX)
        return F.struct((-F.ln(u) / float(weight)).alias("score"), F.lit(i).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"].cast("int")


def shard(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 50_000) -> DataFrame:
    """One row per document: its key, size, text_crc32, law, shard, slot and, with grown weights, grown_shard.

    size is the UTF-8 bytes of the text plus 1 (null text: 1). The key and the weights alone decide the shard, so equal
    keys (repeated rows, ties) share one; slot numbers a shard's rows from 0 without gaps. An empty table gives an empty
    result; other columns of docs are ignored.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    won = rendezvous(F.col(key), weights)
    rows = docs.select(
        F.col(key),
        F.when(F.col(text).isNull(), 0).otherwise(F.octet_length(F.col(text))).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        won.alias("shard"),
        (rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    ).withColumn("size", F.col("size") + 1)
    keys = docs.select(F.col(key), won.alias("shard"))
    total = docs.select(key).count()
    return group_slots(keys, rows, ["shard"], [key], "slot", total, rows_per_bucket).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
