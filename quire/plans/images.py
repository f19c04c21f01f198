"""Queries over rasters of a page's boxes: the kernels of ``masks`` and ``pixels`` on rows, checked by sets of cells in SQL.

The tables hold no pictures, so a page is drawn from its boxes: cells of 32 pixels or more, at most some 256 a side. The
first region is the instance, the second its neighbour, the third protected; the first reading is the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import graph, masks, pairs, pixels, sequence
from quire.plans.matching import _GAP, _REGIONS, all_readings, regions
from quire.plans.registry import Registry
from quire.sources.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
CELL, SIDE = 32, 256
PAPER, INK, STAIN = 240, 20, 90


class Sheet:
    """Masks of a page's boxes by side (0 regions, 1 readings) and place in the order of ids."""

    def __init__(self, boxes: pd.DataFrame) -> None:
        boxes = boxes.dropna().sort_values(["side", "id"])
        x, y, w, h = (boxes[c].to_numpy("int64") for c in ("x", "y", "w", "h"))
        right, low = (max(0, int(boxes[c].iloc[0])) if len(boxes) else 0 for c in ("right", "low"))
        self.cell = max(CELL, -(-(max(right, low) + 1) // SIDE))
        to = lambda v: np.maximum(v, 0) // self.cell
        self.shape = (low // self.cell + 1, right // self.cell + 1)
        self.sides: dict[int, list[np.ndarray]] = {0: [], 1: []}
        for side, a, b, c, d in zip(boxes["side"], to(x), to(y), to(x + w) + 1, to(y + h) + 1):
            m = np.zeros(self.shape, bool)
            m[b:d, a:c] = True
            self.sides[side].append(m)

    def mask(self, side: int, place: int) -> np.ndarray:
        held = self.sides[side]
        return held[place] if place < len(held) else np.zeros(self.shape, bool)


def sheets(page_regions: DataFrame, page_readings: DataFrame) -> DataFrame:
    """``page, side, id, x, y, w, h`` of the boxes that are asked of a sheet, the first three of each side by id, with ``right``
    and ``low``, the page's extent. Null pages are none; however many boxes a page has, six rows of it meet in a task."""
    both = page_regions.select(F.lit(0).alias("side"), "*").unionByName(page_readings.select(F.lit(1).alias("side"), "*")).where("page is not null")
    extent = both.groupBy(F.col("page").alias("of")).agg(F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("low"))
    place = F.row_number().over(Window.partitionBy("page", "side").orderBy("id"))
    first = both.withColumn("place", place).where(F.col("place") <= 3)
    return first.join(extent, F.col("page") == F.col("of")).select("page", "side", "id", "x", "y", "w", "h", "right", "low")


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    return sheets(regions(spark, d), all_readings(table(spark, d, "fragments")))


# Cells of each drawn box: r1 to r3 the regions, f1 and f2 the readings.
_CELLS = """b AS (SELECT DISTINCT asset_id AS page, 0 AS side, region_id AS id, bbox.x AS x, bbox.y AS y, bbox.width AS w, bbox.height AS h FROM evaluation_regions
  UNION ALL SELECT DISTINCT asset_id, 1, fragment_id, bbox.x, bbox.y, bbox.width, bbox.height FROM fragments),
s AS (SELECT page, greatest(32, (greatest(max(x + w), max(y + h), 0) + 1 + 255) // 256) AS c FROM b GROUP BY 1),
g AS (SELECT page, side, row_number() OVER (PARTITION BY page, side ORDER BY id) AS k, greatest(x, 0) // c AS x1, greatest(y, 0) // c AS y1, greatest(x + w, 0) // c AS x2, greatest(y + h, 0) // c AS y2 FROM b JOIN s USING (page)),
p AS (SELECT page, max(x2) AS xm, max(y2) AS ym FROM g GROUP BY 1),
cells AS (SELECT page, side, k, x, unnest(generate_series(y1, y2)) AS y FROM (SELECT *, unnest(generate_series(x1, x2)) AS x FROM g WHERE k <= 3)),
r1 AS (SELECT page, x, y FROM cells WHERE side = 0 AND k = 1), r2 AS (SELECT page, x, y FROM cells WHERE side = 0 AND k = 2 EXCEPT FROM r1), r12 AS (FROM r1 UNION FROM r2),
f1 AS (SELECT page, x, y FROM cells WHERE side = 1 AND k = 1), f2 AS (SELECT page, x, y FROM cells WHERE side = 1 AND k = 2 EXCEPT FROM f1)"""


def _grown(source: str, steps: int) -> str:
    return f"(SELECT DISTINCT page, x + dx AS x, y + dy AS y FROM {source}, (SELECT unnest(generate_series(-{steps}, {steps})) AS dx), (SELECT unnest(generate_series(-{steps}, {steps})) AS dy))"


@R.query(f"""WITH {_CELLS}, r3 AS (SELECT page, x, y FROM cells WHERE side = 0 AND k = 3 EXCEPT FROM r12),
sep AS (FROM {_grown('r1', 1)} INTERSECT FROM r2), doubt AS (FROM {_grown('sep', 1)} INTERSECT FROM r12), need AS (FROM f1 INTERSECT FROM r12), hard AS (FROM f2 UNION FROM r3),
band AS (FROM sep UNION FROM doubt), corridor AS (FROM {_grown('band', 6)} INTERSECT FROM r12), guarded AS (FROM {_grown('need', 1)} INTERSECT FROM corridor),
blocked AS (SELECT DISTINCT page FROM (FROM guarded INTERSECT FROM hard)), crossed AS (SELECT DISTINCT page FROM (FROM need EXCEPT FROM r1)),
cleared AS (SELECT * FROM (FROM {_grown('guarded', 2)} INTERSECT FROM corridor) WHERE page NOT IN (FROM blocked) AND page NOT IN (FROM crossed)),
sep2 AS (FROM sep EXCEPT FROM cleared), doubt2 AS (FROM doubt EXCEPT FROM cleared), safe AS (FROM r1 EXCEPT (FROM hard UNION FROM sep2 UNION FROM doubt2)), bad AS (FROM need EXCEPT FROM safe),
n AS (SELECT page, (SELECT count(*) FROM sep WHERE sep.page = p.page) - (SELECT count(*) FROM sep2 WHERE sep2.page = p.page) AS n_moved, (SELECT count(*) FROM safe WHERE safe.page = p.page) AS n_safe,
  (SELECT count(*) FROM bad WHERE bad.page = p.page) AS n_unsafe, page IN (FROM blocked) AS b, page IN (FROM crossed) AS c FROM p)
SELECT page, CASE WHEN b OR c OR n_unsafe > 0 THEN 'INCOMPLETE_REVIEW' ELSE 'COMPLETE' END AS status, CASE WHEN b THEN 'guard_conflicts_visible_or_protected' WHEN c THEN 'required_support_crosses_primary_instance'
  WHEN n_unsafe > 0 THEN 'required_text_not_safely_editable' ELSE 'text_aware_virtual_boundary_corrected' END AS reason, n_moved, n_safe, n_unsafe FROM n""")
def separator_correction(spark: SparkSession, d: str) -> DataFrame:
    """The separator between a page's first two regions, moved off the text of its first reading."""

    def body(boxes: pd.DataFrame) -> pd.DataFrame:
        s = Sheet(boxes)
        own = s.mask(0, 0)
        other = s.mask(0, 1) & ~own
        both = own | other
        text = s.mask(1, 0)
        separator = pixels.grow(own, 1) & other
        doubt = pixels.grow(separator, 1) & both
        done = masks.move_separator(own, other, separator, s.mask(1, 1) & ~text, text & both, s.mask(0, 2) & ~both, doubt)
        return pd.DataFrame([(boxes["page"].iloc[0], done.status, done.reason, int((separator & ~done.separator).sum()), int(done.safe.sum()), done.n_unsafe)], columns=["page", "status", "reason", "n_moved", "n_safe", "n_unsafe"])

    return sequence.by_group(_sheets(spark, d), "page", body, "page string, status string, reason string, n_moved long, n_safe long, n_unsafe long")


_COUNTS = ("n_required", "n_changed", "n_outside", "n_protected", "n_doubt", "n_edge", "n_residue", "n_off_background", "n_ring")


@R.query(f"""WITH {_CELLS}, need AS (FROM f1 INTERSECT FROM r1), doubt AS (FROM f2 INTERSECT FROM r1),
nb AS (SELECT page, x, y, x + dx AS nx, y + dy AS ny FROM r1, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
edge AS (SELECT DISTINCT nb.page, nb.x, nb.y FROM nb JOIN p USING (page) LEFT JOIN r1 ON r1.page = nb.page AND r1.x = nx AND r1.y = ny WHERE r1.page IS NULL AND nx BETWEEN 0 AND xm AND ny BETWEEN 0 AND ym),
safe AS (FROM r1 EXCEPT FROM edge), wiped AS (SELECT * FROM need WHERE (x + y) % 5 <> 0), stained AS (SELECT * FROM f2 WHERE (x + y) % 7 = 0), changed AS (FROM wiped UNION FROM stained),
ring AS (SELECT * FROM (FROM {_grown('need', 5)} INTERSECT FROM r1) EXCEPT (FROM {_grown('need', 1)} UNION FROM r2 UNION FROM doubt)),
few AS (SELECT p.page, count(ring.page) < 16 AS few FROM p LEFT JOIN ring USING (page) GROUP BY 1),
kinds AS (SELECT page, 'n_required' AS kind FROM need UNION ALL SELECT page, 'n_changed' FROM changed UNION ALL SELECT page, 'n_outside' FROM (FROM changed EXCEPT FROM safe)
  UNION ALL SELECT page, 'n_protected' FROM (FROM changed INTERSECT FROM r2) UNION ALL SELECT page, 'n_doubt' FROM (FROM changed INTERSECT FROM doubt) UNION ALL SELECT page, 'n_edge' FROM (FROM changed INTERSECT FROM edge)
  UNION ALL SELECT page, 'n_residue' FROM need JOIN few USING (page) WHERE few OR (x + y) % 5 = 0 UNION ALL SELECT page, 'n_off_background' FROM changed JOIN few USING (page) WHERE few OR (page, x, y) IN (FROM stained) UNION ALL SELECT page, 'n_ring' FROM ring)
SELECT page, {', '.join(f"count(*) FILTER (kind = '{c}') AS {c}" for c in _COUNTS)}, any_value(few) AS few_samples FROM few LEFT JOIN kinds USING (page) GROUP BY 1""")
def cleaning_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What a cleaning of the first reading's ink within the first region did: four of five cells wiped, some of the second reading stained."""

    def body(boxes: pd.DataFrame) -> pd.DataFrame:
        s = Sheet(boxes)
        own, text = s.mask(0, 0), s.mask(1, 0)
        more = s.mask(1, 1) & ~text
        at = np.add.outer(np.arange(s.shape[0]), np.arange(s.shape[1]))
        before = np.where(text, INK, PAPER)
        after = np.where(text & own & (at % 5 != 0), PAPER, np.where(more & (at % 7 == 0), STAIN, before))
        before, after = (np.repeat(t[..., None].astype("uint8"), 3, 2) for t in (before, after))
        r = masks.cleaning_report(before, after, text & own, own & ~masks.edge_of(own), own, s.mask(0, 1) & ~own, more & own)
        return pd.DataFrame([(boxes["page"].iloc[0], *[r[c] for c in _COUNTS], r["few_samples"])], columns=["page", *_COUNTS, "few_samples"])

    return sequence.by_group(_sheets(spark, d), "page", body, f"page string, {', '.join(f'{c} long' for c in _COUNTS)}, few_samples boolean")


@R.query(f"""WITH {_CELLS}, u AS (SELECT DISTINCT page, x, y FROM cells WHERE side = 0), last AS (SELECT page, x, y, max(k) AS k FROM cells WHERE side = 0 GROUP BY ALL)
SELECT p.page, count(last.page) AS n_union, count(*) FILTER (k = 1) AS n_first, count(*) FILTER (k = 2) AS n_second, count(*) FILTER (k = 3) AS n_third FROM p LEFT JOIN last USING (page) GROUP BY 1""")
def mask_composition(spark: SparkSession, d: str) -> DataFrame:
    """Cells that each of the first three regions keeps when they are written over each other in the order of their ids."""

    def body(boxes: pd.DataFrame) -> pd.DataFrame:
        s = Sheet(boxes)
        base = np.zeros((*s.shape, 3), "uint8")
        members = [(str(k), s.mask(0, k), np.full_like(base, k + 1)) for k in range(3)]
        out, union, _ = pixels.compose(members, base)
        kept = np.bincount(out[..., 0].ravel(), minlength=4)
        return pd.DataFrame([(boxes["page"].iloc[0], int(union.sum()), *kept[1:4].tolist())], columns=["page", "n_union", "n_first", "n_second", "n_third"])

    return sequence.by_group(_sheets(spark, d), "page", body, "page string, n_union long, n_first long, n_second long, n_third long")


@R.query(f"""WITH {_CELLS}, edge AS (SELECT page, n, (SELECT count(*) FROM (FROM r1 INTERSECT FROM f1) i WHERE i.page = t.page) AS shared,
  (SELECT count(*) FROM (FROM {_grown('r1', 1)} INTERSECT FROM f1) i WHERE i.page = t.page) AS near_truth, (SELECT count(*) FROM (FROM {_grown('f1', 1)} INTERSECT FROM r1) i WHERE i.page = t.page) AS near_found,
  (SELECT count(*) FROM r1 WHERE r1.page = t.page) AS truth, (SELECT count(*) FROM f1 WHERE f1.page = t.page) AS found FROM (SELECT page, 1 AS n FROM p) t)
SELECT page, round(shared::DOUBLE / nullif(truth + found - shared, 0), 6) AS iou, round(near_truth::DOUBLE / nullif(found, 0), 6) AS precision, round(near_found::DOUBLE / nullif(truth, 0), 6) AS recall FROM edge""")
def tolerant_mask_scores(spark: SparkSession, d: str) -> DataFrame:
    """The first reading against the first region as masks: IoU, and precision and recall with a tolerance of a cell."""

    def body(boxes: pd.DataFrame) -> pd.DataFrame:
        s = Sheet(boxes)
        r = pixels.tolerance_scores(s.mask(0, 0), s.mask(1, 0), 1)
        return pd.DataFrame([(boxes["page"].iloc[0], *[None if r[c] is None else round(r[c], 6) for c in ("iou", "precision", "recall")])], columns=["page", "iou", "precision", "recall"])

    return sequence.by_group(_sheets(spark, d), "page", body, "page string, iou double, precision double, recall double")


@R.query(f"""WITH RECURSIVE {_REGIONS}, e AS (SELECT a.id AS u, b.id AS v, 200 - floor(sqrt(({_GAP})::DOUBLE))::BIGINT AS c FROM r a JOIN r b ON a.page = b.page AND a.id <> b.id WHERE {_GAP} <= 14400),
s AS (SELECT DISTINCT min(id) OVER (PARTITION BY page) AS s FROM r),
t(node, source, width) USING KEY (node, source) AS (SELECT s, s, NULL::BIGINT FROM s
  UNION SELECT e.v, t.source, max(least(coalesce(t.width, e.c), e.c)) FROM t JOIN e ON t.node = e.u LEFT JOIN recurring.t old ON old.node = e.v AND old.source = t.source
  WHERE e.v <> t.source AND (old.node IS NULL OR least(coalesce(t.width, e.c), e.c) > old.width) GROUP BY e.v, t.source)
SELECT node, source, width FROM t WHERE node <> source""")
def widest_paths(spark: SparkSession, d: str) -> DataFrame:
    """From each page's first region to those it reaches over gaps of up to 120: the greatest least closeness along a path."""
    boxes = regions(spark, d)
    edges = pairs.near_pairs(boxes, 120).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), (200 - F.floor(F.sqrt(F.col("gap2").cast("double")))).alias("capacity"))
    return graph.widest_paths(edges, boxes.groupBy("page").agg(F.min("id").alias("source")).select("source"))
