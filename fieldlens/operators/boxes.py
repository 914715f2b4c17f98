"""Boxes of one document together: suppression, text bands, where to split, heights and angles that prevail."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions.geometry import box


def _overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""

    def shared(low: str, size: str) -> Column:
        return F.greatest(F.least(a[low] + a[size], b[low] + b[size]) - F.greatest(a[low], b[low]), F.lit(0))

    both = shared("x_min", "width") * shared("y_min", "height")
    return both / F.greatest(a["width"] * a["height"] + b["width"] * b["height"] - both, F.lit(1e-12))


def suppressed(detections: DataFrame, overlap: float = 0.3, threshold: float = 0.9) -> DataFrame:
    """Detections of each file that survive greedy suppression, whatever their class, with nms_rank.

    By falling score (then class and place) a box stays if it overlaps none that stayed by more. The rule is sequential,
    so a file's boxes, some dozens, are folded as one array; nothing leaves the JVM.
    """
    fields = ["class_index", "x_min", "y_min", "width", "height", "score"]
    strong = detections.where(F.col("score") > threshold)
    rows = strong.groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), *fields))).alias("boxes"))
    none = F.slice("boxes", 1, 0)
    kept = F.aggregate("boxes", none, lambda held, b: F.when(F.exists(held, lambda k: _overlap(k, b) > overlap), held).otherwise(F.array_append(held, b)))
    out = rows.select("file", F.posexplode(kept).alias("nms_rank", "b"))
    return out.select("file", *[F.col(f"b.{c}").alias(c) for c in fields], "nms_rank")


def text_bands(boxes: DataFrame, key: str = "file") -> DataFrame:
    """key, y1, y2, middle of merged vertical stretches (y1, y2): those that overlap are one, those that touch are two."""
    w = Window.partitionBy(key).orderBy("y1", "y2")
    reach = F.max("y2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = boxes.withColumn("_new", F.when(reach.isNull() | (F.col("y1") >= reach), 1).otherwise(0))
    numbered = marked.withColumn("_band", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(key, "_band").agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    return out.select(key, "y1", "y2", F.floor((F.col("y1") + F.col("y2")) / 2).cast("int").alias("middle"))


def half_cuts(bands: DataFrame, heights: DataFrame, key: str = "file") -> DataFrame:
    """key, upper_end, lower_start: where to cut a two-line field so that no band is cut.

    Bands whose middle is in the lower half belong there. Without bands the cut is the middle; a gap between the halves is
    cut at the end nearer to it; overlapping halves keep both.
    """
    joined = heights.join(bands, key, "left").withColumn("half", F.floor(F.col("height") / 2).cast("int"))
    low = F.col("middle") >= F.col("half")
    n = joined.groupBy(key, "half").agg(F.max(F.when(~low, F.col("y2") + 2)).alias("up"), F.min(F.when(low, F.col("y1") - 2)).alias("down"))
    up, down, half = F.col("up"), F.col("down"), F.col("half")
    near_up = F.abs(up - half) < F.abs(down - half)
    gap = down > up
    upper = F.when(up.isNull() & down.isNull(), half).when(up.isNull(), down).when(down.isNull(), up).when(gap & ~near_up, down).otherwise(up)
    lower = F.when(up.isNull() & down.isNull(), half).when(down.isNull(), up).when(up.isNull(), down).when(gap & near_up, up).otherwise(down)
    return n.select(key, upper.alias("upper_end"), lower.alias("lower_start"))


def letter_heights(contours: DataFrame, key: str = "file") -> DataFrame:
    """key, low, high around the heights seen most: 6 about the first, then about the next outside it.

    Contours (area, w, h) under an area of 3 are noise; nearly square ones decide if there are any.
    """
    real = contours.where("area >= 3").withColumn("square", F.least("w", "h") / F.greatest("w", "h") > 0.67)
    real = real.withColumn("any", F.bool_or("square").over(Window.partitionBy(key))).where("square or not any")
    counts = real.groupBy(key, "h").agg(F.count("*").alias("n"))
    top = counts.groupBy(key).agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("first"))
    rest = counts.join(top, key).where(F.abs(F.col("h") - F.col("first")) > 6)
    second = rest.groupBy(key).agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("second"))
    out = top.join(second, key, "left")
    other = F.coalesce("second", "first")
    return out.select(key, F.greatest(F.least("first", other) - 6, F.lit(0)).cast("int").alias("low"), (F.greatest("first", other) + 6).cast("int").alias("high"))


def dominant_angle(angles: DataFrame, key: str = "file") -> DataFrame:
    """key, angle: the median within the 5-degree bin whose boxes are largest in sum of width and height."""
    binned = angles.where("angle <> 0").withColumn("bin", F.bround(F.col("angle") / 5).cast("int") * 5)
    weights = binned.groupBy(key, "bin").agg(F.sum(F.col("w") + F.col("h")).alias("weight"), F.median("angle").alias("median"))
    return weights.groupBy(key).agg(F.max_by("median", F.struct("weight", -F.col("bin"))).alias("angle"))


def largest(rows: DataFrame, key: str, area: str, out: list[str]) -> DataFrame:
    """The row of each key with the largest area, the first by the other columns of equals."""
    best = F.max_by(F.struct(*out), F.struct(F.col(area), *[-F.col(c) for c in out]))
    return rows.groupBy(key).agg(best.alias("_best")).select(key, "_best.*")


def photo_share(detections: DataFrame, key: str = "file") -> DataFrame:
    """key, band: the largest photo by the largest card, as two digits of percent."""
    from fieldlens.functions.geometry import percent_band

    name, area = F.lower("obj_name"), F.col("width") * F.col("height")
    n = detections.groupBy(key).agg(
        F.coalesce(F.max(F.when(name == "foto_cnh", area)), F.lit(0)).alias("photo"), F.coalesce(F.max(F.when(name.isin("cnh", "cnh_frente"), area)), F.lit(0)).alias("card")
    )
    return n.select(key, percent_band(F.col("photo"), F.col("card")).alias("band"))


def side_spans(detections: DataFrame, front: list[str], back: list[str], key: str = "file") -> DataFrame:
    """key and the vertical extent of the fields of either side, for splitting a card's image."""
    name, low, high = F.col("obj_name"), F.col("y_min"), F.col("y_min") + F.col("height")
    aggs = [f(F.when(name.isin(names), v)).alias(f"{side}_{end}") for side, names in (("front", front), ("back", back)) for end, f, v in (("top", F.min, low), ("bottom", F.max, high))]
    return detections.groupBy(key).agg(*aggs)


def filtered_result(results: DataFrame, names: list[str], width: Column | int, height: Column | int) -> DataFrame:
    """Detections (…, obj_name, box) of the wanted names, lower-cased, with their boxes cut to the frame: one pass.

    No names keep all. A box's far corner is cut, too, so a box outside the frame gets no or a negative size, as asked.
    """
    b, (w, h) = F.col("box"), [x if isinstance(x, Column) else F.lit(x) for x in (width, height)]
    x, y = F.greatest(b["x_min"], F.lit(0)), F.greatest(b["y_min"], F.lit(0))
    cut = box(x.cast("int"), y.cast("int"), (F.least(b["x_min"] + b["width"], w) - x).cast("int"), (F.least(b["y_min"] + b["height"], h) - y).cast("int"))
    kept = results.where(F.lower("obj_name").isin(*names)) if names else results
    return kept.withColumn("box", cut)


def decode_images(images: DataFrame, detect, schema: str) -> DataFrame:
    """Rows that a given callable finds in binary images (path, content): the place for a detector or a recogniser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [detect(p, c) for p, c in zip(batch["path"], batch["content"])]
            if found:
                yield pd.concat(found, ignore_index=True)

    return images.select("path", "content").mapInPandas(run, schema)
