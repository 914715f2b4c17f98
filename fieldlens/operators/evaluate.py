"""Accuracy against ground truth: expected fields joined with detected ones, rates per field, file and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.similarity import block_rate, indel_error, indel_ratio


def with_missing(expected: DataFrame, detected: DataFrame, field: str = "cpf_rg") -> DataFrame:
    """Detections and, for files that expect a field nobody detected, an empty one of it."""
    absent = expected.where(F.col("field") == field).select("file", "field").distinct().join(detected.select("file", "field").distinct(), ["file", "field"], "left_anti")
    return detected.unionByName(absent.withColumn("text", F.lit("")), allowMissingColumns=True)


def chosen_rate(raw: Column, adjusted: Column, mode: int) -> Column:
    """1 the raw text's rate, 2 the adjusted one's, 3 the better of both."""
    return {1: raw, 2: adjusted, 3: F.greatest(raw, adjusted)}[mode]


def matched(expected: DataFrame, detected: DataFrame, rate=block_rate) -> DataFrame:
    """(file, field, expected, text, pos, rate) of all expected fields, one row for each detection of it, rate 0 if none.

    detected has (file, field, text, pos); equal keys join, so a field of a file is one small group.
    """
    joined = expected.join(detected.select("file", "field", "text", "pos"), ["file", "field"], "left")
    scored = joined.withColumn("rate", F.when(F.col("text").isNull(), 0.0).otherwise(rate(F.col("expected"), F.coalesce("text", F.lit("")))))
    return scored.select("file", "field", "expected", "text", "pos", "rate")


def field_rates(rows: DataFrame) -> DataFrame:
    """(file, field, rate) as the wide report has it: the last detection of a field counts."""
    return rows.groupBy("file", "field").agg(F.max_by("rate", F.coalesce("pos", F.lit(-1))).alias("rate"))


def file_accuracy(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(file, matches, fields, accuracy): all detections' rates over the expected fields; strict counts a field once.

    Not strict, a field that is detected twice adds twice, so a file can pass 100 %.
    """
    per_file = rows.groupBy("file").agg(F.sum("rate").alias("matches"), F.countDistinct("field").alias("fields"))
    if strict:
        per_file = field_rates(rows).groupBy("file").agg(F.sum("rate").alias("matches"), F.count("*").alias("fields"))
    return per_file.withColumn("accuracy", F.col("matches") / F.col("fields"))


def detected_accuracy(rows: DataFrame) -> DataFrame:
    """The other denominator: fields detected and expected; 0 if at most two were and at most one has text."""
    seen = F.col("text").isNotNull()
    n = rows.groupBy("file").agg(F.sum("rate").alias("matches"), F.count_if(seen).alias("seen"), F.count_if(seen & (F.trim("text") != "")).alias("filled"), F.sum(F.when(F.trim("text") != "", F.col("rate")).otherwise(0.0)).alias("filled_matches"))
    rate = F.when((F.col("seen") <= 2) & (F.col("filled") <= 1), 0.0).otherwise(F.col("matches") / F.greatest("seen", F.lit(1)))
    return n.select("file", rate.alias("accuracy"), F.when(F.col("filled") > 0, F.col("filled_matches") / F.greatest("filled", F.lit(1))).otherwise(0.0).alias("filled_accuracy"))


def run_accuracy(rows: DataFrame) -> DataFrame:
    """One row: all rates over all expected fields."""
    per_file = file_accuracy(rows)
    return per_file.agg(F.sum("matches").alias("matches"), F.sum("fields").alias("fields"), (F.sum("matches") / F.sum("fields")).alias("accuracy"))


def cpf_hits(rows: DataFrame) -> DataFrame:
    """One row: how many numbers of persons were read without a fault, of those detected."""
    seen = rows.where(F.col("field").startswith("cpf_") & F.col("text").isNotNull())
    return seen.agg(F.count_if(F.col("rate") == 1).alias("right"), F.count_if(F.col("rate") != 1).alias("wrong"))


def wide(rates: DataFrame, fields: list[str]) -> DataFrame:
    """One row per file with a column for each field of a fixed list, blank where it is not expected."""
    return rates.groupBy("file").pivot("field", fields).agg(F.first("rate"))


def ledger(detected: DataFrame, expected: DataFrame) -> DataFrame:
    """Names and parents whose adjusted text differs from the raw one: what correction gained or lost.

    (ocr, adjusted, expected, rate_oe, err_oe, rate_ae, err_ae); quotes become apostrophes.
    """
    joined = detected.join(expected, ["file", "field"]).where(F.col("field").rlike("^(nome_|filiacao_)") & (F.col("expected") != "") & (F.col("ocr") != F.col("adjusted")))
    plain = [F.replace(F.col(c), F.lit('"'), F.lit("'")).alias(c) for c in ("ocr", "adjusted", "expected")]
    rows = joined.select("file", "field", *plain)
    pairs = [("oe", "ocr"), ("ae", "adjusted")]
    scores = [f(F.col("expected"), F.col(c)).alias(f"{kind}_{k}") for k, c in pairs for kind, f in (("rate", indel_ratio), ("err", indel_error))]
    return rows.select("file", "field", "ocr", "adjusted", "expected", *scores)


def confusion(kinds: DataFrame) -> DataFrame:
    """(expected, detected, ok, files) of (expected, detected) kinds."""
    return kinds.groupBy("expected", "detected").agg(F.count("*").alias("files")).withColumn("ok", F.when(F.col("expected") == F.col("detected"), "OK").otherwise(""))


def confusion_rows(files: DataFrame, as_of: Column) -> DataFrame:
    """A row for each file (file, found_rg, found_cnh): expected and detected kind, whether they agree, and what tells them.

    A kind is told by the only one of two signs; none or both make it another. found_* say what was detected in the file,
    its path says what it should be.
    """
    def flag(c: Column) -> Column:
        return F.when(c, "S").otherwise("N")

    def kind(rg: Column, cnh: Column) -> Column:
        return F.when(rg == cnh, "Outros").when(rg, "RG").otherwise("CNH")

    low = F.lower("file")
    in_rg, in_cnh = low.contains("/rg"), low.contains("/cnh")
    expected, detected = kind(in_rg, in_cnh), kind(F.col("found_rg"), F.col("found_cnh"))
    return files.select(
        as_of.alias("ts"), expected.alias("expected"), detected.alias("detected"), F.when(expected == detected, "OK").otherwise("").alias("ok"),
        flag(F.col("found_rg")).alias("detected_rg"), flag(in_rg).alias("dir_rg"), flag(F.col("found_cnh")).alias("detected_cnh"), flag(in_cnh).alias("dir_cnh"), "file",
    )


def client_report(rows: DataFrame) -> DataFrame:
    """(file, match): the mean rate in percent over the fields compared."""
    return rows.where(F.col("text").isNotNull()).groupBy("file").agg((F.avg("rate") * 100).alias("match"))


def detected_names(detected: DataFrame) -> DataFrame:
    """(file, names): distinct field names, sorted."""
    return detected.groupBy("file").agg(F.array_sort(F.collect_set("field")).alias("names"))
