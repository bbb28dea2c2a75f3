"""Boxes and regions of images, and names put together from tokens by their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Regions by their share of the height (top, bottom) and of the width (left, right).
REGIONS = {
    "header": (0.00, 0.18, 0.00, 1.00),
    "footer_left_surgical": (0.88, 0.985, 0.015, 0.50),
    "footer_left": (0.83, 0.985, 0.015, 0.55),
    "footer_right_surgical": (0.88, 0.985, 0.50, 0.985),
    "footer_right": (0.83, 0.985, 0.48, 0.985),
    "footer_wide": (0.86, 0.985, 0.02, 0.98),
    "footer_tight": (0.88, 0.985, 0.015, 0.50),
    "footer": (0.86, 0.985, 0.02, 0.98),
}


def regions(height: Column, width: Column) -> Column:
    """Array of structs (name, y1, y2, x1, x2): the pixels of all regions, cut off to whole numbers."""
    cut = lambda side, share: F.floor(side * F.lit(share)).cast("int")
    return F.array(*[F.struct(F.lit(n).alias("name"), cut(height, a).alias("y1"), cut(height, b).alias("y2"), cut(width, c).alias("x1"), cut(width, d).alias("x2")) for n, (a, b, c, d) in REGIONS.items()])


# The classes of a detector.
CLASSES = ["card", "header_region", "id_region"]


def best_boxes(boxes: DataFrame, least: float = 0.6) -> DataFrame:
    """Rows (image, label, confidence, width, height, x1, y1, x2, y2): the surest box of each class from ``least`` on, of equals the first.

    ``boxes`` has image, ord, label, x1, y1, x2, y2, confidence and the image's image_width and
    image_height; other labels than ``CLASSES`` are ignored. Confidences that agree in four digits are
    equal. width and height are the box's own, not below 0; the coordinates are those of the crop, inside
    the image and null where it is empty.
    """
    four = F.floor(F.col("confidence") * 10000 + 0.5) / F.lit(10000.0)
    able = boxes.where((F.col("confidence") >= least) & F.col("label").isin(CLASSES)).withColumn("confidence", four)
    best = able.groupBy("image", "label").agg(F.max_by(F.struct("x1", "y1", "x2", "y2", "confidence", "image_height", "image_width"), F.struct("confidence", -F.col("ord"))).alias("b")).select("image", "label", "b.*")
    cut = crop(*map(F.col, ("x1", "y1", "x2", "y2", "image_width", "image_height")))
    span = lambda a, b: F.greatest(F.lit(0), F.col(b) - F.col(a))
    return best.select("image", "label", "confidence", span("x1", "x2").alias("width"), span("y1", "y2").alias("height"), cut.alias("c")).select("image", "label", "confidence", "width", "height", "c.x1", "c.y1", "c.x2", "c.y2")


def crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Struct (x1, y1, x2, y2) of a box inside its image, ends excluded; null where nothing is left."""
    inside = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
    box = F.struct(inside(x1, width - 1).alias("x1"), inside(y1, height - 1).alias("y1"), inside(x2, width).alias("x2"), inside(y2, height).alias("y2"))
    return F.when((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)


def left_to_right(boxes: Column) -> Column:
    """An array of boxes (structs with x1) in reading order; boxes that start together keep their order."""
    placed = F.transform(boxes, lambda b, i: F.struct(b["x1"].alias("k"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(placed), lambda p: p["b"])


def line_box(boxes: Column) -> Column:
    """The box around an array of boxes, as a struct; null for none."""
    edge = lambda f, c: f(F.transform(boxes, lambda b: b[c])).alias(c)
    return F.when(F.size(boxes) > 0, F.struct(edge(F.array_min, "x1"), edge(F.array_min, "y1"), edge(F.array_max, "x2"), edge(F.array_max, "y2")))


def corners(points: Column) -> Column:
    """Struct of the corners of four points (structs of x and y): by least and largest sum and difference."""
    pick = lambda key, top: F.element_at(F.array_sort(F.transform(points, lambda p: F.struct(key(p).alias("k"), p.alias("p")))), -1 if top else 1)["p"]
    total, apart = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.struct(pick(total, False).alias("top_left"), pick(apart, False).alias("top_right"), pick(total, True).alias("bottom_right"), pick(apart, True).alias("bottom_left"))


def name_by_size(tokens: DataFrame) -> DataFrame:
    """Rows (scan_id, name): the tallest plausible token and those that belong to it, from left to right.

    ``tokens`` has scan_id, ord, text, x1, x2, y1, y2. From the tallest down, a token joins if the gap to some
    token taken before is at most 2.5 of that one's widths, and it is a suffix, or it has 55 % of the
    tallest's height and its middle within 0.9 of that height.
    """
    clean = text.name_token(F.col("text"))
    kept = tokens.withColumn("word", clean).where(text.names_something(F.col("word")))
    item = F.struct((-(F.col("y2") - F.col("y1"))).alias("k"), "ord", "word", "x1", "x2", ((F.col("y1") + F.col("y2")) / 2).alias("mid"), (F.col("y2") - F.col("y1")).alias("height"))
    grouped = kept.groupBy("scan_id").agg(F.array_sort(F.collect_list(item)).alias("t"))

    def joins(taken, x):
        tallest = F.get(taken, 0)
        near = F.exists(taken, lambda a: F.greatest(x["x1"] - a["x2"], a["x1"] - x["x2"], F.lit(0.0)) / F.greatest(a["x2"] - a["x1"], F.lit(1.0)) <= 2.5)
        alike = (x["height"] >= tallest["height"] * 0.55) & (F.abs(x["mid"] - tallest["mid"]) < tallest["height"] * 0.9)
        return near & (F.lower(x["word"]).isin(text.NAME_SUFFIXES) | alike)

    taken = F.aggregate(F.slice("t", 2, F.size("t")), F.slice("t", 1, 1), lambda acc, x: F.when(joins(acc, x), F.array_append(acc, x)).otherwise(acc))
    by_place = F.array_sort(F.transform(taken, lambda a: F.struct(((a["x1"] + a["x2"]) / 2).alias("m"), a["k"], a["ord"], a["word"])))
    return grouped.select("scan_id", F.array_join(F.transform(by_place, lambda a: a["word"]), " ").alias("name"))
