"""Box arithmetic on x, y, width, height columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """The four columns of a box, by prefix."""

    def __init__(self, prefix: str) -> None:
        self.x, self.y, self.w, self.h = (F.col(f"{prefix}{c}") for c in ("x", "y", "w", "h"))

    @property
    def area(self) -> Column:
        return self.w.cast("long") * self.h


def box_columns(struct: str, prefix: str) -> list[Column]:
    """Columns x, y, w, h of a bbox struct under a prefix."""
    return [F.col(f"{struct}.{f}").alias(f"{prefix}{c}") for f, c in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))]


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection."""
    wide = F.greatest(F.lit(0), F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x))
    high = F.greatest(F.lit(0), F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y))
    return wide.cast("long") * high


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 for boxes without area."""
    shared = overlap(a, b)
    return F.coalesce(F.try_divide(shared.cast("double"), (a.area + b.area - shared).cast("double")), F.lit(0.0))


def gap_squared(a: Box, b: Box) -> Column:
    """Square of the distance between two boxes, 0 where they touch."""
    dx = F.greatest(F.lit(0), F.greatest(a.x, b.x) - F.least(a.x + a.w, b.x + b.w)).cast("long")
    dy = F.greatest(F.lit(0), F.greatest(a.y, b.y) - F.least(a.y + a.h, b.y + b.h)).cast("long")
    return dx * dx + dy * dy


def contains(outer: Box, inner: Box, margin: int = 0) -> Column:
    """Whether the outer box holds the inner one, with a margin."""
    return (inner.x >= outer.x - margin) & (inner.y >= outer.y - margin) & (inner.x + inner.w <= outer.x + outer.w + margin) & (inner.y + inner.h <= outer.y + outer.h + margin)


def orientation(box: Box, ratio: float = 1.25) -> Column:
    """vertical, horizontal or uncertain by the ratio of the sides."""
    return F.when(box.h >= box.w * F.lit(ratio), "vertical").when(box.w >= box.h * F.lit(ratio), "horizontal").otherwise("uncertain")


def polygon_box(polygon: Column) -> Column:
    """The box ``left, top, right, bottom`` around a polygon of (x, y) points; null for none or no points."""
    side = lambda i: F.transform(polygon, lambda p: p[i])
    box = F.struct(F.array_min(side(0)).alias("left"), F.array_min(side(1)).alias("top"), F.array_max(side(0)).alias("right"), F.array_max(side(1)).alias("bottom"))
    return F.when(F.size(polygon) > 0, box)
