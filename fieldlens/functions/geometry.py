"""Boxes, angles and label lines: arithmetic on numbers that detectors and editors leave behind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(x: Column) -> Column:
    """Cut toward zero."""
    return x.cast("int")


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x_min"), y.alias("y_min"), w.alias("width"), h.alias("height"))


def decoded(cx: Column, cy: Column, w: Column, h: Column, width: Column | int, height: Column | int) -> Column:
    """A detector's fractions as pixels: scaled and cut to whole numbers first, corners from those."""
    px, py, pw, ph = whole(cx * width), whole(cy * height), whole(w * width), whole(h * height)
    return box(whole(px - pw / F.lit(2)), whole(py - ph / F.lit(2)), pw, ph)


def clipped(b: Column, width: Column | int, height: Column | int) -> Column:
    """A box inside an image; one that is fully outside gets a negative size."""
    def axis(low: Column, size: Column, limit) -> tuple[Column, Column]:
        first, last = F.greatest(low, F.lit(0)), F.least(low + size, limit if isinstance(limit, Column) else F.lit(limit))
        return first, last - first

    x, w = axis(b["x_min"], b["width"], width)
    y, h = axis(b["y_min"], b["height"], height)
    return box(x, y, w, h)


def trimmed(b: Column, width: Column | int, height: Column | int) -> Column:
    """As evaluation clips: a low edge moves to 0 and keeps the size, then the far edge is cut."""
    x, y = F.greatest(b["x_min"], F.lit(0)), F.greatest(b["y_min"], F.lit(0))
    w = F.when(x + b["width"] > width, width - x).otherwise(b["width"])
    h = F.when(y + b["height"] > height, height - y).otherwise(b["height"])
    return box(x, y, w, h)


def normalised(b: Column, width: Column | int, height: Column | int) -> Column:
    """(cx, cy, w, h) of a pixel box as fractions of the image."""
    return F.struct(
        ((b["x_min"] + b["width"] / F.lit(2)) / width).alias("cx"), ((b["y_min"] + b["height"] / F.lit(2)) / height).alias("cy"),
        (b["width"] / width).alias("w"), (b["height"] / height).alias("h"),
    )


def rect_of(label: Column, trim: bool = False) -> Column:
    """Corners of a centre box; trim clamps them to 0..1 and gives null if all of it is outside."""
    x1, x2 = label["cx"] - label["w"] / 2, label["cx"] + label["w"] / 2
    y1, y2 = label["cy"] - label["h"] / 2, label["cy"] + label["h"] / 2
    return _rect(x1, y1, x2, y2, trim)


def _rect(x1: Column, y1: Column, x2: Column, y2: Column, trim: bool) -> Column:
    if not trim:
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    def clamp(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))

    inside = (x2 > 0) & (x1 < 1) & (y2 > 0) & (y1 < 1)
    return F.when(inside, F.struct(clamp(x1).alias("x1"), clamp(y1).alias("y1"), clamp(x2).alias("x2"), clamp(y2).alias("y2")))


def label_of(rect: Column, trim: bool = False) -> Column:
    """The centre box of corners."""
    r = _rect(rect["x1"], rect["y1"], rect["x2"], rect["y2"], trim) if trim else rect
    made = F.struct(((r["x1"] + r["x2"]) / 2).alias("cx"), ((r["y1"] + r["y2"]) / 2).alias("cy"), (r["x2"] - r["x1"]).alias("w"), (r["y2"] - r["y1"]).alias("h"))
    return F.when(r.isNotNull(), made)


def parsed_label(line: Column) -> Column:
    """(cls, cx, cy, w, h) of "class cx cy w h"; four parts have class -1; other lines are null."""
    parts = F.split(F.trim(F.regexp_replace(F.replace(line, F.lit(","), F.lit(".")), r"\s+", " ")), " ")
    n = F.size(parts)
    numbers = [F.get(parts, n - 4 + i).try_cast("double") for i in range(4)]
    cls = F.when(n == 4, F.lit(-1)).otherwise(F.get(parts, 0).try_cast("int"))
    good = n.isin(4, 5) & cls.isNotNull()
    for x in numbers:
        good = good & x.isNotNull()
    return F.when(good, F.struct(cls.alias("cls"), *[x.alias(k) for x, k in zip(numbers, ("cx", "cy", "w", "h"))]))


def printed_label(cls: Column, label: Column) -> Column:
    """A label line with 8 decimals."""
    return F.format_string("%d %.8f %.8f %.8f %.8f", cls, label["cx"], label["cy"], label["w"], label["h"])


def screen_box(label: Column, width: Column | int, height: Column | int) -> Column:
    """Whole screen pixels of a label; null where a corner is negative."""
    w, h = whole(label["w"] * width), whole(label["h"] * height)
    x, y = whole((label["cx"] - label["w"] / 2) * width), whole((label["cy"] - label["h"] / 2) * height)
    return F.when((x >= 0) & (y >= 0) & (w >= 0) & (h >= 0), box(x, y, w, h))


def centre(low: Column, size: Column) -> Column:
    """The middle of an extent, rounded down."""
    return (low + F.floor(size / 2)).cast("int")


def point_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees of the line from one point to another."""
    return F.degrees(F.atan2((by - ay).cast("double"), (bx - ax).cast("double")))


def snapped(angle: Column) -> Column:
    """An angle in (-180, 180]; less than 2 degrees from a right angle it is that."""
    around = F.pmod(angle.cast("double"), F.lit(360.0))
    a = F.when(around > 180, around - 360).otherwise(around)
    return F.when(F.abs(a) < 2, 0.0).when(F.abs(a - 90) < 2, 90.0).when(F.abs(a + 90) < 2, -90.0).when(180 - F.abs(a) < 2, 180.0).otherwise(a)


def turn(angle: Column) -> Column:
    """How far to rotate for a pair's angle: its opposite, snapped; less than 2 degrees is none."""
    a = snapped(-angle)
    return F.when(F.abs(a) < 2, 0.0).otherwise(a)


def canvas(width: Column, height: Column, angle: Column) -> Column:
    """The size that holds an image turned by an angle."""
    s, c = F.abs(F.sin(F.radians(angle))), F.abs(F.cos(F.radians(angle)))
    return F.struct(whole(height * s + width * c).alias("width"), whole(height * c + width * s).alias("height"))


def fitted(width: Column, height: Column, bound_w: Column | int, bound_h: Column | int, cover: bool = False) -> Column:
    """The size scaled to bounds, by the smaller ratio, or by the larger one to cover them."""
    rw, rh = bound_w / width, bound_h / height
    r = F.greatest(rw, rh) if cover else F.least(rw, rh)
    return F.struct(whole(width * r).alias("width"), whole(height * r).alias("height"))


def shrunk(width: Column, height: Column, wanted: Column | int) -> Column:
    """The size with at most the wanted width; never larger than it was."""
    r = F.least(F.lit(1.0), wanted / width)
    return F.struct(whole(width * r).alias("width"), whole(height * r).alias("height"))


def united(a: Column, b: Column, full_width: Column | int, full_height: Column | int) -> Column:
    """The rectangle around two crops; the second alone if the first is the whole frame."""
    is_full = (a["x1"] == 0) & (a["y1"] == 0) & (a["x2"] == full_width) & (a["y2"] == full_height)
    both = F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"))
    return F.when(is_full, b).otherwise(both)


def crop(r: Column, width: Column | int, height: Column | int) -> Column:
    """Corners clamped to an image."""
    def inside(v: Column, limit) -> Column:
        return F.least(F.greatest(v, F.lit(0)), limit if isinstance(limit, Column) else F.lit(limit))

    return F.struct(inside(r["x1"], width).alias("x1"), inside(r["y1"], height).alias("y1"), inside(r["x2"], width).alias("x2"), inside(r["y2"], height).alias("y2"))


def padded_face(b: Column) -> Column:
    """A face with 40 % more on either side, a quarter above and 30 % below, not cut to whole pixels."""
    w, h = b["width"], b["height"]
    return box(b["x_min"] - w * 0.4, b["y_min"] - h * 0.25, w + w * 0.8, h + h * 0.55)


def hidden_part(field: Column, b: Column) -> Column:
    """What to cover of a field: all but 0.3 of its height on every side, 0.15 for parents' names; null for photos and outer classes."""
    inset = b["height"] * F.when(field.startswith("filiacao_"), (1 - 0.7) / 2.0).otherwise((1 - 0.4) / 2.0)
    covered = box(whole(b["x_min"] + inset), whole(b["y_min"] + inset), whole(b["width"] - inset * 2.0), whole(b["height"] - inset * 2.0))
    return F.when(~field.startswith("foto_") & ~field.isin("cnh", "cnh_frente", "rg_frente", "rg_verso", "rg2_frente", "rg2_verso"), covered)


#: Of eight lines in a photo-like place name's block, those that are covered beside the field itself.
_EXTRA_LINES = (0, 1, 2, 6, 7)


def hidden_photo(b: Column) -> Column:
    """What to cover of a photo: (rectangle corners, circle) of shoulders and head."""
    def tenth(n: int) -> Column:
        return F.floor(b["width"] / n)

    x, y, w, h = b["x_min"], b["y_min"], b["width"], b["height"]
    low = F.struct(whole(x + tenth(10)).alias("x1"), whole(y + F.floor(h / 2)).alias("y1"), whole(x + w - tenth(10)).alias("x2"), whole(y + h - tenth(10)).alias("y2"))
    head = F.struct(whole(x + tenth(2)).alias("x"), whole(y + F.floor(h / 3)).alias("y"), F.least(F.floor(h / 4), tenth(3)).cast("int").alias("radius"))
    return F.struct(low.alias("body"), head.alias("head"))


def hidden_lines(field: Column, b: Column) -> Column:
    """Boxes to cover beside a place of issue: of eight lines from four above it on, all but the middle three; else none."""
    covered = hidden_part(field, b)
    first, step = covered["y_min"] - 4 * (covered["height"] + 3), covered["height"] + 2
    lines = F.array(*[box(covered["x_min"], first + i * step, covered["width"], covered["height"]) for i in _EXTRA_LINES])
    return F.when(field == "local_emissao_cnh", lines).otherwise(F.slice(lines, 1, 0))


def long_side_angle(corners: Column) -> Column:
    """(width, height, angle) of a rectangle's four corners in order: its longer and shorter side and the slope of the longer.

    The angle lies within 135 degrees either way of level; a rectangle whose sides differ by less than a third has none.
    """
    def side(i: int) -> Column:
        a, c = F.get(corners, i), F.get(corners, (i + 1) % 4)
        rise, run = (a["y"] - c["y"]).cast("double"), (a["x"] - c["x"]).cast("double")
        return F.struct(F.hypot(run, rise).alias("length"), F.lit(-i).alias("order"), rise.alias("rise"), run.alias("run"))

    sides = F.array(*[side(i) for i in range(4)])
    longest, shortest = F.array_max(sides), F.array_min(F.transform(sides, lambda s: s["length"]))
    slope = -F.degrees(F.atan2(longest["rise"], longest["run"]))
    slope = F.when(180 - F.abs(slope) <= 45, slope + F.when(slope < 0, 180.0).otherwise(-180.0)).otherwise(slope)
    angle = F.when(shortest / longest["length"] <= 0.67, slope)
    return F.struct(F.bround(longest["length"]).cast("int").alias("width"), F.bround(shortest).cast("int").alias("height"), angle.alias("angle"))


def colours(bits: int = 8) -> Column:
    """All (r, g, b) with so many bits a channel, in the order of an image that holds each once.

    A number's bits go in turn to red, green and blue, lowest first; each channel is stretched to eight bits.
    """
    n = min(8, max(1, bits))

    def channel(number: Column, which: int) -> Column:
        out = F.lit(0)
        for i in range(n):
            bit = F.shiftright(number, 3 * i + which).bitwiseAND(1)
            out = out + F.shiftleft(bit, i + max(0, 7 * (i + 1) // n - i))
        return out.cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(2 ** (3 * n) - 1)), lambda k: F.struct(*[channel(k, i).alias(c) for i, c in enumerate("rgb")]))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot((bx - ax).cast("double"), (by - ay).cast("double"))


def scaled(b: Column, scale: Column | float) -> Column:
    return box(*[whole(b[c] * scale) for c in ("x_min", "y_min", "width", "height")])


def rgb(packed: Column) -> Column:
    """(r, g, b) of a packed colour, red lowest."""
    return F.struct(*[F.shiftright(packed, s).bitwiseAND(255).alias(c) for s, c in ((0, "r"), (8, "g"), (16, "b"))])


def clamped_sum(a: Column, by: Column, low: Column | float, high: Column | float) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(a + by, lo), hi)


def nudged(label: Column, dx: float = 0.0, dy: float = 0.0, dw: float = 0.0, dh: float = 0.0) -> Column:
    """A label moved or resized by steps; sizes stay 0 or more."""
    return F.struct((label["cx"] + dx).alias("cx"), (label["cy"] + dy).alias("cy"), F.greatest(label["w"] + dw, F.lit(0.0)).alias("w"), F.greatest(label["h"] + dh, F.lit(0.0)).alias("h"))


def percent_band(part: Column, total: Column) -> Column:
    """Two digits of a share in percent: 99 if the part is as large, 00 if there is nothing to compare."""
    share = F.floor(100 * part / F.greatest(total, F.lit(1))).cast("int")
    return F.when(F.least(part, total) <= 0, "00").when(part >= total, "99").otherwise(F.lpad(share.cast("string"), 2, "0"))
