"""Bounded, repeatable samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import Scratch


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor (a null id: that of the empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(divisor)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, divisor: int, held_out: int, per_class: int, natural: int, max_bytes: int) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(balanced, natural) samples of (text, label), from labelled rows outside the held-out remainder.

    The balanced sample has at most per_class rows of either label, from 13 of 16 rows; the natural one at most
    `natural` of the other rows as they come. Rows are taken in the order of an MD5 of their id, so the same ones at
    every run, those of more than a fiftieth of max_bytes last, so that no long text takes the place of many; each sample
    ends before max_bytes of text. These bounds, not the table, size what reaches the driver. Rows without a label or text
    are left out; of several labels of a document the largest counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(remainder(F.col("doc_id"), divisor) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    ordered = known.withColumn("order", F.md5(F.concat(F.lit("sample:"), F.col("doc_id").cast("string"))))
    low = F.col("order") < "d"
    picks = [ordered.where(~low).orderBy("order").limit(natural)] + [ordered.where(low & (F.col("label") == v)).orderBy("order").limit(per_class) for v in (0, 1)]
    chosen = [[(r["order"], r["doc_id"], r["label"]) for r in p.collect()] for p in picks]
    if not any(chosen):
        return [], []
    ids = docs.sparkSession.createDataFrame([(d,) for part in chosen for _, d, _ in part], "doc_id long")
    # one scan of the texts; the sample's own rows are written once and read twice
    held = Scratch(docs.sparkSession, "labels").save(docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(F.broadcast(ids), "doc_id", "left_semi"), "held")
    sizes = {r["doc_id"]: r["n"] for r in held.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).collect()}

    def within(rows: list[tuple]) -> list[tuple]:
        kept, used = [], 0
        for row in sorted(rows, key=lambda r: (sizes.get(r[1], 0) > max_bytes // 50, r)):
            n = sizes.get(row[1])
            if n is not None and used + n <= max_bytes:
                kept.append(row)
                used += n
        return kept

    balanced, usual = within(chosen[1]) + within(chosen[2]), within(chosen[0])
    wanted = docs.sparkSession.createDataFrame([(d,) for _, d, _ in balanced + usual], "doc_id long") if balanced or usual else ids.limit(0)
    texts = {r["doc_id"]: r["text"] for r in held.join(F.broadcast(wanted), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return [(texts[d], v) for _, d, v in balanced], [(texts[d], v) for _, d, v in usual]
