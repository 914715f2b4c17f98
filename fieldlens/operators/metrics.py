"""Times and sizes: laps, timers, summaries, exposition text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def laps(rows: DataFrame, run: str, ts: str, started: Column | None = None) -> DataFrame:
    """rows with lap_us: microseconds since the row before in its run; the first since the start, null if none is given."""
    before = F.lag(ts).over(Window.partitionBy(run).orderBy(ts))
    return rows.withColumn("lap_us", F.expr("0L") + F.timestamp_diff("MICROSECOND", F.coalesce(before, started) if started is not None else before, F.col(ts)))


def timers(marks: DataFrame) -> DataFrame:
    """(request, clock, total_us, laps) of start and end marks (request, clock, ts, mark).

    A start while running and an end while stopped count for nothing.
    """
    w = Window.partitionBy("request", "clock").orderBy("ts", "mark")
    prior = F.lag("mark").over(w)
    turns = marks.withColumn("_turn", (prior.isNull() & (F.col("mark") == "start")) | (prior != F.col("mark"))).where("_turn")
    began = F.lag("ts").over(w)
    ended = turns.withColumn("_us", F.when(F.col("mark") == "end", F.timestamp_diff("MICROSECOND", began, F.col("ts"))))
    return ended.groupBy("request", "clock").agg(F.coalesce(F.sum("_us"), F.lit(0)).alias("total_us"), F.count("_us").alias("laps"))


def printed_timers(totals: DataFrame) -> DataFrame:
    """(request, text) of timers worth printing: several laps, or a millisecond."""
    shown = totals.where((F.col("laps") > 1) | (F.col("total_us") >= 1000))
    part = F.concat("clock", F.lit("="), F.format_string("%.3f", F.col("total_us") / 1e6))
    return shown.groupBy("request").agg(F.array_join(F.array_sort(F.collect_list(part)), " ").alias("text"))


def latency(requests: DataFrame) -> DataFrame:
    """One row of counts and sums of (detect_s, ocr_s): total as exported, which adds an OCR time that already holds
    detection, and as it really was."""
    ocr = F.coalesce("ocr_s", F.lit(0.0))
    return requests.agg(
        F.count("*").alias("requests"), F.sum("detect_s").alias("detect_sum"), F.sum(ocr).alias("ocr_sum"),
        F.sum(F.col("detect_s") + ocr).alias("total_exported"), F.sum(F.greatest(ocr, F.col("detect_s"))).alias("total_actual"),
    )


def time_per_item(rows: DataFrame, group: str, seconds: str) -> DataFrame:
    return rows.groupBy(group).agg(F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"))


def size_stats(rows: DataFrame, group: str, size: str) -> DataFrame:
    """Mean, median and sample deviation."""
    return rows.groupBy(group).agg(F.avg(size).alias("mean"), F.median(size).alias("median"), F.stddev_samp(size).alias("stdev"))


def gpu(samples: DataFrame) -> DataFrame:
    """Gauges of the first card (index 0) over samples (used, total, index)."""
    first = samples.where("index = 0").withColumn("free", F.col("total") - F.col("used"))
    return first.agg(F.count("*").alias("samples"), *[F.sum(c).alias(c) for c in ("used", "total", "free")], F.avg(100 * F.col("used") / F.col("total")).alias("used_percent"))


def mean_field_height(detections: DataFrame, skip: str = "filiacao") -> DataFrame:
    """(file, height): mean over fields but the parents'."""
    return detections.where(~F.col("obj_name").startswith(skip)).groupBy("file").agg(F.avg("height").alias("height"))


def text_entropy(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entropy): bits per character of each text."""
    chars = texts.select(key, F.explode(F.split(text, "")).alias("ch")).groupBy(key, "ch").agg(F.count("*").alias("n"))
    p = F.col("n") / F.col("total")
    return chars.withColumn("total", F.sum("n").over(Window.partitionBy(key))).groupBy(key).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def window_entropy(pixels: DataFrame, key: str, reach: int = 5) -> DataFrame:
    """(key, row, col, entropy, level) of (key, row, col, value): bits per pixel of the window around each, and its level.

    A window goes from `reach` before to `reach` less one after, in rows and columns, as far as the image does. Levels lie
    between the image's least entropy, 0, and its largest, 255 (all 0 where they are equal). Each pixel is sent to the
    windows that hold it, at most (2 * reach)**2, and counted there; no window is collected.
    """
    near = F.sequence(F.lit(1 - reach), F.lit(reach))
    sent = pixels.select(key, "row", "col", "value", F.explode(near).alias("_r")).select(key, (F.col("row") + F.col("_r")).alias("row"), "col", "value", F.explode(near).alias("_c"))
    sent = sent.select(key, "row", (F.col("col") + F.col("_c")).alias("col"), "value")
    held = sent.join(pixels.select(key, "row", "col"), [key, "row", "col"], "left_semi").groupBy(key, "row", "col", "value").agg(F.count("*").alias("n"))
    # -sum(p log p) by the counts alone: log N - sum(n log n) / N
    bits = held.groupBy(key, "row", "col").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
    span = bits.groupBy(key).agg(F.min("entropy").alias("_lo"), F.max("entropy").alias("_hi"))
    level = F.when(F.col("_hi") > F.col("_lo"), F.bround(255.0 * (F.col("entropy") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).otherwise(0.0)
    return bits.join(span, key).select(key, "row", "col", "entropy", level.cast("int").alias("level"))


def exposition(values: DataFrame) -> DataFrame:
    """Text lines of (name, help, count, sum) summaries, as scrapers read them."""
    lines = F.concat_ws(
        "\n", F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), F.col("help")), F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" summary")),
        F.concat(F.col("name"), F.lit("_count "), F.col("count").cast("double").cast("string")), F.concat(F.col("name"), F.lit("_sum "), F.col("sum").cast("double").cast("string")),
    )
    return values.select("name", lines.alias("text"))
