"""Boxes as struct<x1,y1,x2,y2:double>: pure column expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def from_array(a: Column) -> Column:
    """A box from exactly four numbers in order, else null."""
    fine = (F.size(a) == 4) & (F.get(a, F.lit(0)) <= F.get(a, F.lit(2))) & (F.get(a, F.lit(1)) <= F.get(a, F.lit(3)))
    return F.when(fine, box(*(F.get(a, F.lit(i)) for i in range(4))))


def to_array(b: Column) -> Column:
    return F.array(b["x1"], b["y1"], b["x2"], b["y2"])


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def union_all(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null for none."""
    edge = lambda f, k: f(boxes[k])
    return F.when(F.size(boxes) > 0, box(edge(F.array_min, "x1"), edge(F.array_min, "y1"), edge(F.array_max, "x2"), edge(F.array_max, "y2")))


def intersection(a: Column, b: Column) -> Column:
    """Null where the boxes only touch or lie apart."""
    x1, y1, x2, y2 = F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]), F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"])
    return F.when((x1 < x2) & (y1 < y2), box(x1, y1, x2, y2))


def intersection_area(a: Column, b: Column) -> Column:
    return F.coalesce(area(intersection(a, b)), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection_area(a, b)
    whole = area(a) + area(b) - both
    return F.when((both > 0) & (whole > 0), both / whole).otherwise(0.0)


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"])


def contains_box(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"]) & (a["y2"] >= b["y2"])


def horizontal_gap(a: Column, b: Column) -> Column:
    return F.greatest(b["x1"] - a["x2"], a["x1"] - b["x2"], F.lit(0.0))


def vertical_gap(a: Column, b: Column) -> Column:
    return F.greatest(b["y1"] - a["y2"], a["y1"] - b["y2"], F.lit(0.0))


def _overlap_ratio(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    least = F.least(high_a - low_a, high_b - low_b)
    return F.when(least > 0, F.greatest(F.lit(0.0), F.least(high_a, high_b) - F.greatest(low_a, low_b)) / least).otherwise(0.0)


def vertical_overlap_ratio(a: Column, b: Column) -> Column:
    return _overlap_ratio(a["y1"], a["y2"], b["y1"], b["y2"])


def horizontal_overlap_ratio(a: Column, b: Column) -> Column:
    return _overlap_ratio(a["x1"], a["x2"], b["x1"], b["x2"])


def expand(b: Column, horizontal: float, vertical: float) -> Column:
    if horizontal < 0 or vertical < 0:
        raise ValueError("a box can't be expanded by a negative amount")
    return box(b["x1"] - horizontal, b["y1"] - vertical, b["x2"] + horizontal, b["y2"] + vertical)


def pixels(b: Column, width_: int, height_: int) -> Column:
    """Pixel box of a normalised one: clamped to the page, halves rounded to even, at least one pixel wide and high."""
    at = lambda v, n: F.bround(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * n, 0).cast("int")
    x1, y1 = at(b["x1"], width_), at(b["y1"], height_)
    return F.struct(x1.alias("x1"), y1.alias("y1"), F.greatest(at(b["x2"], width_), x1 + 1).alias("x2"), F.greatest(at(b["y2"], height_), y1 + 1).alias("y2"))


def normalised(b: Column, width_: Column, height_: Column) -> Column:
    """Page fractions of a pixel box, to six places."""
    return box(F.round(b["x1"] / width_, 6), F.round(b["y1"] / height_, 6), F.round(b["x2"] / width_, 6), F.round(b["y2"] / height_, 6))
