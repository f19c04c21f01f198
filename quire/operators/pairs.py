"""Spatial joins on boxes, blocked by page and grid cell so that only neighbours meet.

Cells come in levels, each twice as wide as the one before. A box lies in at most four cells of the first level that is as
wide as it is, and of every wider one that occurs, so the cells of a box are few whatever its size; two boxes meet on the
level of the larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.geometry import Box, contains, gap_squared, iou, overlap
from quire.operators import sequence
from quire.session import cut_lineage

CELL = 64


def _level(prefix: str, grow: int, cell: int) -> Column:
    """The first level whose cells are as wide and high as a grown box; null for a box without a size."""
    b = Box(prefix)
    return F.greatest(F.lit(0), F.ceil(F.log2((F.greatest(b.w, b.h, F.lit(0)) + 2 * grow + 1) / cell))).cast("int")


def _width(cell: int) -> Column:
    return F.expr(f"{cell} * shiftleft(1L, level)")


def _cells(df: DataFrame, prefix: str, grow: int, cell: int, levels: list[int]) -> DataFrame:
    """A row for every cell of the levels in use that a box touches once grown on all sides."""
    b = Box(prefix)
    wide = _width(cell)
    span = lambda at, size: F.sequence(F.floor((at - grow) / wide), F.floor((at + size + grow) / wide))
    own = df.withColumn("own_level", _level(prefix, grow, cell)).where(b.x.isNotNull() & b.y.isNotNull() & b.w.isNotNull() & b.h.isNotNull() & (b.w >= 0) & (b.h >= 0))
    each = own.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("own_level"))))
    return each.withColumn("cx", F.explode(span(b.x, b.w))).withColumn("cy", F.explode(span(b.y, b.h)))


def _levels_in_use(frames: list[DataFrame]) -> list[int]:
    """Distinct levels of boxes; they are as few as the doublings from the smallest box to the largest."""
    found = frames[0]
    for f in frames[1:]:
        found = found.unionByName(f)
    return sorted(r["level"] for r in found.distinct().collect() if r["level"] is not None)


def _meet(left: DataFrame, right: DataFrame, a: str, b: str, grow: int, cell: int) -> DataFrame:
    """Pairs of a page whose boxes share a cell, each pair once: in the first cell, by both axes, that the two share.

    Boxes without a place or size, or of a negative one, meet none.
    """
    one, two = Box(a), Box(b)
    levels = _levels_in_use([left.select(_level(a, grow, cell).alias("level")), right.select(_level(b, 0, cell).alias("level"))]) or [0]
    l_cells = _cells(left, a, grow, cell, levels)
    r_cells = _cells(right, b, 0, cell, levels).withColumnsRenamed({c: f"{c}2" for c in ("cx", "cy", "level", "own_level")})
    wide = _width(cell)
    first_x = F.greatest(F.floor((one.x - grow) / wide), F.floor(two.x / wide))
    first_y = F.greatest(F.floor((one.y - grow) / wide), F.floor(two.y / wide))
    same = (F.col(f"{a}page") == F.col(f"{b}page")) & (F.col("level") == F.col("level2")) & (F.col("cx") == F.col("cx2")) & (F.col("cy") == F.col("cy2"))
    met = l_cells.join(r_cells, same).where(F.col("level") == F.greatest("own_level", "own_level2"))
    return met.where((F.col("cx") == first_x) & (F.col("cy") == first_y)).drop("cx", "cy", "cx2", "cy2", "level", "level2", "own_level", "own_level2")


def _renamed(boxes: DataFrame, prefix: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("page", "id", "x", "y", "w", "h")])


def near_pairs(boxes: DataFrame, gap: int, cell: int = CELL) -> DataFrame:
    """Pairs ``a_id < b_id`` of a page's boxes (page, id, x, y, w, h) at most ``gap`` apart, with gap, overlap, IoU and union box."""
    met = _meet(_renamed(boxes, "a_"), _renamed(boxes, "b_"), "a_", "b_", gap, cell).where("a_id < b_id")
    a, b = Box("a_"), Box("b_")
    far = met.withColumn("gap2", gap_squared(a, b)).where(F.col("gap2") <= gap * gap)
    left, top = F.least(a.x, b.x), F.least(a.y, b.y)
    return far.select(
        F.col("a_page").alias("page"), "a_id", "b_id", "gap2", overlap(a, b).alias("shared"), F.round(iou(a, b), 6).alias("iou"),
        left.alias("x"), top.alias("y"), (F.greatest(a.x + a.w, b.x + b.w) - left).alias("w"), (F.greatest(a.y + a.h, b.y + b.h) - top).alias("h"),
    )


def best_matches(targets: DataFrame, candidates: DataFrame, least_cover: float = 0.5, cell: int = CELL) -> DataFrame:
    """``target, candidate, shared``: per target the candidate covering most of it, ties by id.

    A candidate counts if its centre lies in the target or it covers ``least_cover`` of the target.
    """
    met = _meet(_renamed(targets, "a_"), _renamed(candidates, "b_"), "a_", "b_", 0, cell)
    a, b = Box("a_"), Box("b_")
    cx, cy = b.x * 2 + b.w, b.y * 2 + b.h
    inside = (cx >= a.x * 2) & (cx <= (a.x + a.w) * 2) & (cy >= a.y * 2) & (cy <= (a.y + a.h) * 2)
    fits = met.withColumn("shared", overlap(a, b)).where(inside | (F.col("shared") >= a.area * F.lit(least_cover)))
    best = fits.groupBy("a_id").agg(F.min(F.struct((-F.col("shared")).alias("s"), "b_id")).alias("m"))
    return best.select(F.col("a_id").alias("target"), F.col("m.b_id").alias("candidate"), (-F.col("m.s")).alias("shared"))


def unique_containers(inner: DataFrame, outer: DataFrame, margin: int = 3, cell: int = CELL) -> DataFrame:
    """``inner, container, status``: the one box that holds each box with a margin; ``uncertain`` with several, ``none`` without."""
    met = _meet(_renamed(inner, "a_"), _renamed(outer, "b_"), "a_", "b_", margin, cell).where(contains(Box("b_"), Box("a_"), margin))
    held = met.groupBy(F.col("a_id").alias("held")).agg(F.count("*").alias("n"), F.min("b_id").alias("container"))
    n = F.coalesce("n", F.lit(0))
    joined = inner.join(held, F.col("id") == F.col("held"), "left")
    return joined.select(F.col("id").alias("inner"), F.when(n == 1, F.col("container")).alias("container"), F.when(n == 0, "none").when(n == 1, "unique").otherwise("uncertain").alias("status"))


def nearest_neighbours(boxes: DataFrame, radius: int, cell: int = CELL) -> DataFrame:
    """``id, neighbour, gap2``: the nearest other box of the page within ``radius`` (gap between boxes); ties by id."""
    pairs = near_pairs(boxes, radius, cell)
    both = pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("neighbour"), "gap2").unionByName(pairs.select(F.col("b_id").alias("id"), F.col("a_id").alias("neighbour"), "gap2"))
    return both.groupBy("id").agg(F.min(F.struct("gap2", "neighbour")).alias("m")).select("id", "m.neighbour", "m.gap2")


def mutual_pairs(boxes: DataFrame, radius: int, cell: int = CELL) -> DataFrame:
    """``id, partner``: boxes that are each other's nearest neighbour, by the smaller id; all others alone with a null partner."""
    near = nearest_neighbours(boxes, radius, cell).select("id", "neighbour")
    pair = near.groupBy(F.least("id", "neighbour").alias("lo"), F.greatest("id", "neighbour").alias("hi")).agg(F.count("*").alias("k")).where("k = 2").select("lo", "hi")
    members = pair.select(F.col("lo").alias("paired")).unionByName(pair.select(F.col("hi").alias("paired")))
    alone = boxes.select("id").distinct().join(members, F.col("id") == F.col("paired"), "left_anti").select("id", F.lit(None).cast(boxes.schema["id"].dataType).alias("partner"))
    return pair.select(F.col("lo").alias("id"), F.col("hi").alias("partner")).unionByName(alone)


def top_candidates(boxes: DataFrame, gap: int, n: int = 3, cell: int = CELL) -> DataFrame:
    """``id, candidates``: up to ``n`` nearest boxes of each box within ``gap``, nearest first, joined by commas."""
    pairs = near_pairs(boxes, gap, cell)
    both = pairs.select(F.col("a_id").alias("id"), F.struct("gap2", F.col("b_id").alias("other")).alias("s")).unionByName(pairs.select(F.col("b_id").alias("id"), F.struct("gap2", F.col("a_id").alias("other")).alias("s")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("s"))
    return both.withColumn("place", place).where(F.col("place") <= n).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("s"))["other"], ",").alias("candidates"))


def boxes_kept(boxes: DataFrame, limit: float, cell: int = CELL) -> DataFrame:
    """``page, id`` of the boxes kept in the order of the hashes of their ids when each is dropped that overlaps an earlier
    kept one by an IoU of ``limit``.

    Equal boxes stand under the first of them, which decides for all; only boxes of a common cell are compared, and the
    order is followed in rounds over the pairs, so no page meets in one task. Boxes without area overlap nothing and stay,
    as do those without a place.
    """
    node = F.concat(F.sha2(F.col("id"), 256), F.lit("="), "id")
    real = F.coalesce((F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("page").isNotNull(), F.lit(False))
    classes = boxes.where(real).groupBy("page", "x", "y", "w", "h").agg(F.min(F.struct(node.alias("node"), "id"))["id"].alias("id"))
    classes = cut_lineage(classes.select("page", "id", "x", "y", "w", "h"))
    met = _meet(_renamed(classes, "a_"), _renamed(classes, "b_"), "a_", "b_", 0, cell).where("a_id < b_id")
    near = met.where(iou(Box("a_"), Box("b_")) >= limit)
    key = lambda p: F.concat(F.sha2(F.col(f"{p}_id"), 256), F.lit("="), f"{p}_id", F.lit("@"), f"{p}_page")
    dropped = sequence.greedy_dropped(near.select(F.least(key("a"), key("b")).alias("lo"), F.greatest(key("a"), key("b")).alias("hi")))
    whole = F.concat(node, F.lit("@"), "page")
    kept = classes.withColumn("whole", whole).join(dropped.withColumnRenamed("node", "gone"), F.col("whole") == F.col("gone"), "left_anti").select("page", "id")
    return kept.unionByName(boxes.where(~real).select("page", "id"))
