"""What recognition gives, made usable: geometry of boxes, filters, and characters from time steps.

Images and models are not read here; boxes, scores and class indices come as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def measures(x0: Column, y0: Column, x1: Column, y1: Column, clamped: bool = True) -> Column:
    """width, height, area and centre of a box; clamped, a box turned inside out has no extent."""
    w, h = x1 - x0, y1 - y0
    if clamped:
        w, h = F.greatest(w, F.lit(0.0)), F.greatest(h, F.lit(0.0))
    return F.struct(w.alias("width"), h.alias("height"), (w * h).alias("area"), ((x0 + x1) / 2).alias("center_x"), ((y0 + y1) / 2).alias("center_y"))


def clipped(box: Column, width: Column, height: Column) -> Column:
    """A box (array of x0, y0, x1, y1) within an image of width x height."""
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most - 1))
    return F.array(inside(box[0], width), inside(box[1], height), inside(box[2], width), inside(box[3], height))


def corners(points: Column) -> Column:
    """Four points (structs of x, y) from the upper left clockwise."""
    least = lambda f: F.array_min(F.transform(points, lambda p: F.struct(f(p).alias("v"), p.alias("p"))))["p"]
    return F.array(least(lambda p: p["x"] + p["y"]), least(lambda p: p["y"] - p["x"]), least(lambda p: -(p["x"] + p["y"])), least(lambda p: p["x"] - p["y"]))


def bounds(points: Column) -> Column:
    """x0, y0, x1, y1 around points."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def expanded(points: Column, ratio: float = 1.6) -> Column:
    """Points moved away from their centre."""
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda t, p: t + p[c]) / F.size(points)
    return F.transform(points, lambda p: F.struct(((p["x"] - mean("x")) * ratio + mean("x")).alias("x"), ((p["y"] - mean("y")) * ratio + mean("y")).alias("y")))


def shorter_side(points: Column) -> Column:
    side = lambda a, b: F.sqrt((points[a]["x"] - points[b]["x"]) ** 2 + (points[a]["y"] - points[b]["y"]) ** 2)
    return F.least(side(0, 1), side(1, 2))


def usable_boxes(boxes: DataFrame, score: str = "score", least_score: float = 0.45, least_side: float = 4.0, least_area: float = 16.0) -> DataFrame:
    """Detected boxes with a sufficient score, both sides and area."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxes.filter((F.col(score) >= least_score) & (w >= least_side) & (h >= least_side) & (w * h >= least_area))


def usable_texts(boxes: DataFrame, text: str = "text", score: str = "confidence", least_score: float = 0.45, least_side: float = 6.0, narrow: float = 0.08, wide: float = 40.0) -> DataFrame:
    """Recognised texts that are not empty, score enough, and whose boxes are no specks, rulers or strokes."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ratio = w / F.greatest(h, F.lit(1.0))
    return boxes.filter((w >= least_side) & (h >= least_side) & (ratio <= wide) & (ratio >= narrow) & (F.trim(F.coalesce(text, F.lit(""))) != "") & (F.col(score) >= least_score))


def softmax(scores: Column) -> Column:
    """An array of scores as chances."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(F.greatest(x - top, F.lit(-50.0))))
    return F.transform(powers, lambda x: x / (F.aggregate(powers, F.lit(0.0), lambda t, y: t + y) + F.lit(1e-8)))


def collapsed(steps: DataFrame, group: list[str], order: list[str], symbol: str, chance: str, blank) -> DataFrame:
    """(group, text, emitted, score): the symbols of each group's time steps without blanks and repeats, and their mean chance.

    A symbol is emitted where it differs from the step before; a blank between
    two equal symbols keeps both.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    marked = steps.withColumn("_before", F.lag(symbol).over(w)).withColumn("_n", F.row_number().over(w))
    emitted = (F.col(symbol) != F.lit(blank)) & ~F.col(symbol).eqNullSafe(F.col("_before"))
    kept = F.array_sort(F.collect_list(F.when(emitted, F.struct("_n", F.col(symbol).cast("string").alias("s")))))
    out = marked.groupBy(*group).agg(F.array_join(F.transform(kept, lambda x: x["s"]), "").alias("text"), F.sum(emitted.cast("int")).alias("emitted"), F.avg(F.when(emitted, F.col(chance))).alias("score"))
    return out.withColumn("score", F.coalesce("score", F.lit(0.0)))
