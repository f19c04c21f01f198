"""Queries over boxes, near duplicates and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.geometry import Box, orientation
from quire.operators import graph, pairs
from quire.plans.registry import Registry
from quire.sources.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Region boxes: page, id, x, y, w, h."""
    b = F.col("bbox")
    return table(spark, d, "evaluation_regions").select(F.col("asset_id").alias("page"), F.col("region_id").alias("id"), b.x.alias("x"), b.y.alias("y"), b.width.alias("w"), b.height.alias("h")).distinct()


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of readings; equal boxes of a page are one, under its smallest id, so that copies never pair among themselves."""
    b = F.col("bbox")
    rows = table(spark, d, "fragments").select(F.col("asset_id").alias("page"), F.col("fragment_id").alias("id"), b.x.alias("x"), b.y.alias("y"), b.width.alias("w"), b.height.alias("h"))
    return rows.groupBy("page", "x", "y", "w", "h").agg(F.min("id").alias("id"))


def all_readings(fragments: DataFrame) -> DataFrame:
    """Boxes of all distinct readings, those of equal boxes too."""
    b = F.col("bbox")
    return fragments.select(F.col("asset_id").alias("page"), F.col("fragment_id").alias("id"), b.x.alias("x"), b.y.alias("y"), b.width.alias("w"), b.height.alias("h")).distinct()


def box_classes(rows: DataFrame) -> DataFrame:
    """``page, id, representative`` of every box: the smallest id of the page's boxes equal to it (null-safe)."""
    box = ["page", "x", "y", "w", "h"]
    firsts = rows.groupBy(*box).agg(F.min("id").alias("representative")).withColumnsRenamed({c: f"c_{c}" for c in box})
    same = reduce(lambda acc, c: acc & F.col(c).eqNullSafe(F.col(f"c_{c}")), box, F.lit(True))
    return rows.join(firsts, same).select("page", "id", "representative")


def votes(boxes: DataFrame) -> DataFrame:
    """``page, n_vertical, n_horizontal, vote`` of the boxes of each page."""
    way = orientation(Box(""))
    v, z = F.count_if(way == "vertical"), F.count_if(way == "horizontal")
    return boxes.groupBy("page").agg(v.alias("n_vertical"), z.alias("n_horizontal"), F.when(v > z, "vertical").when(z > v, "horizontal").otherwise("uncertain").alias("vote"))


def seeds_of(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node, seed, distance_squared``: the nearest of the page's seeds within 100 of each box."""
    return graph.nearest_seed(nodes.select(F.col("id").alias("node"), "page", "x", "y"), seeds.select(F.col("id").alias("seed"), "page", "x", "y"), "page", "x", "y", 100, 100)


_REGIONS = "r AS (SELECT DISTINCT asset_id AS page, region_id AS id, bbox.x AS x, bbox.y AS y, bbox.width AS w, bbox.height AS h FROM evaluation_regions)"
_READS = "f AS (SELECT asset_id AS page, min(fragment_id) AS id, bbox.x AS x, bbox.y AS y, bbox.width AS w, bbox.height AS h FROM fragments GROUP BY asset_id, bbox.x, bbox.y, bbox.width, bbox.height)"
_ALL_READS = "f AS (SELECT DISTINCT asset_id AS page, fragment_id AS id, bbox.x AS x, bbox.y AS y, bbox.width AS w, bbox.height AS h FROM fragments)"
_SHARED = "CAST(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) AS BIGINT) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_GAP = "pow(greatest(0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)), 2)::BIGINT + pow(greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)), 2)::BIGINT"
_IOU = f"round(coalesce(({_SHARED})::DOUBLE / nullif(a.w * a.h + b.w * b.h - {_SHARED}, 0), 0), 6)"


@R.query(f"""WITH {_REGIONS} SELECT a.page, a.id AS a_id, b.id AS b_id, {_GAP} AS gap2, {_SHARED} AS shared, {_IOU} AS iou, least(a.x, b.x) AS x, least(a.y, b.y) AS y,
  greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) AS w, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS h FROM r a JOIN r b ON a.page = b.page AND a.id < b.id WHERE {_GAP} <= 2500""")
def pairwise_self_join(spark: SparkSession, d: str) -> DataFrame:
    return pairs.near_pairs(regions(spark, d), 50)


@R.query("""SELECT fragment_id, bbox.width * bbox.height AS area, bbox.x * 2 + bbox.width AS center2_x, bbox.y * 2 + bbox.height AS center2_y, CAST(floor(bbox.x / 64.0) AS BIGINT) AS cell_x,
  list_min(list_transform(polygon, lambda p: p[1])) AS polygon_left, list_max(list_transform(polygon, lambda p: p[2])) AS polygon_bottom FROM (SELECT DISTINCT fragment_id, bbox, polygon FROM fragments)""")
def box_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bbox")
    rows = table(spark, d, "fragments").select("fragment_id", "bbox", "polygon").distinct()
    side = lambda i: F.transform("polygon", lambda p: p[i])
    return rows.select(
        "fragment_id", (b.width * b.height).alias("area"), (b.x * 2 + b.width).alias("center2_x"), (b.y * 2 + b.height).alias("center2_y"), F.floor(b.x / 64).alias("cell_x"),
        F.array_min(side(0)).alias("polygon_left"), F.array_max(side(1)).alias("polygon_bottom"),
    )


@R.query("""SELECT region_id, greatest(0, bbox.x - 32) AS left_edge, greatest(0, bbox.y - 32) AS top_edge, (bbox.width + 64) * (bbox.height + 64) AS padded_area, (bbox.width + 64) * (bbox.height + 64) > 40000 AS over_budget FROM evaluation_regions""")
def roi_budget(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bbox")
    area = (b.width + 64) * (b.height + 64)
    return table(spark, d, "evaluation_regions").select("region_id", F.greatest(F.lit(0), b.x - 32).alias("left_edge"), F.greatest(F.lit(0), b.y - 32).alias("top_edge"), area.alias("padded_area"), (area > 40000).alias("over_budget"))


@R.query(f"""WITH {_ALL_READS}, o AS (SELECT page, CASE WHEN h >= w * 1.25 THEN 1 ELSE 0 END AS v, CASE WHEN h < w * 1.25 AND w >= h * 1.25 THEN 1 ELSE 0 END AS z FROM f)
SELECT page, CAST(sum(v) AS BIGINT) AS n_vertical, CAST(sum(z) AS BIGINT) AS n_horizontal, CASE WHEN sum(v) > sum(z) THEN 'vertical' WHEN sum(z) > sum(v) THEN 'horizontal' ELSE 'uncertain' END AS vote FROM o GROUP BY 1""")
def orientation_vote(spark: SparkSession, d: str) -> DataFrame:
    """The direction of most readings of each page; every distinct reading has a vote."""
    return votes(all_readings(table(spark, d, "fragments")))


@R.query(f"""WITH {_REGIONS}, {_READS}, m AS (SELECT a.id AS target, b.id AS candidate, {_SHARED} AS shared, row_number() OVER (PARTITION BY a.id ORDER BY {_SHARED} DESC, b.id) AS rn FROM r a JOIN f b ON a.page = b.page
  WHERE (b.x * 2 + b.w BETWEEN a.x * 2 AND (a.x + a.w) * 2 AND b.y * 2 + b.h BETWEEN a.y * 2 AND (a.y + a.h) * 2) OR {_SHARED} >= a.w * a.h * 0.5) SELECT target, candidate, shared FROM m WHERE rn = 1""")
def theta_best_match(spark: SparkSession, d: str) -> DataFrame:
    return pairs.best_matches(regions(spark, d), readings(spark, d))


@R.query(f"""WITH {_REGIONS}, {_ALL_READS}, m AS (SELECT a.id, b.id AS c FROM f a JOIN r b ON a.page = b.page AND a.x >= b.x - 3 AND a.y >= b.y - 3 AND a.x + a.w <= b.x + b.w + 3 AND a.y + a.h <= b.y + b.h + 3)
SELECT f.id AS inner, CASE WHEN count(c) = 1 THEN min(c) END AS container, CASE count(c) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'uncertain' END AS status FROM f LEFT JOIN m ON f.id = m.id GROUP BY 1""".replace("AS inner", 'AS "inner"'))
def unique_container_join(spark: SparkSession, d: str) -> DataFrame:
    """The one region that holds each distinct reading."""
    return pairs.unique_containers(all_readings(table(spark, d, "fragments")), regions(spark, d))


_NEAR = f"""n AS (SELECT a.id, b.id AS neighbour, {_GAP} AS gap2, row_number() OVER (PARTITION BY a.id ORDER BY {_GAP}, b.id) AS rn FROM r a JOIN r b ON a.page = b.page AND a.id <> b.id WHERE {_GAP} <= 14400)"""


@R.query(f"WITH {_REGIONS}, {_NEAR} SELECT id, neighbour, gap2 FROM n WHERE rn = 1")
def nearest_neighbor(spark: SparkSession, d: str) -> DataFrame:
    return pairs.nearest_neighbours(regions(spark, d), 120)


@R.query(f"""WITH {_REGIONS}, {_NEAR}, m AS (SELECT a.id, a.neighbour FROM n a JOIN n b ON a.neighbour = b.id AND b.neighbour = a.id WHERE a.rn = 1 AND b.rn = 1)
SELECT id, neighbour AS partner FROM m WHERE id < neighbour UNION ALL SELECT id, NULL FROM (SELECT DISTINCT id FROM r) WHERE id NOT IN (SELECT id FROM m)""")
def mutual_nn_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.mutual_pairs(regions(spark, d), 120)


@R.query(f"WITH {_REGIONS}, {_NEAR} SELECT id, string_agg(neighbour, ',' ORDER BY rn) AS candidates FROM n WHERE rn <= 3 GROUP BY 1")
def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    return pairs.top_candidates(regions(spark, d), 120, 3)


@R.query(f"WITH {_READS} SELECT a.page, a.id AS a_id, b.id AS b_id, {_IOU} AS iou FROM f a JOIN f b ON a.page = b.page AND a.id < b.id WHERE {_IOU} >= 0.85")
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between different boxes that overlap by 0.85; equal boxes are one box here."""
    return pairs.near_pairs(readings(spark, d), 0).where("iou >= 0.85").select("page", "a_id", "b_id", "iou")


@R.query(f"WITH {_ALL_READS} SELECT page, id, min(id) OVER (PARTITION BY page, x, y, w, h) AS representative FROM f")
def near_duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every reading and the one under which ``near_duplicate_pairs`` has its box."""
    return box_classes(all_readings(table(spark, d, "fragments")))


@R.query(f"""WITH RECURSIVE {_REGIONS}, e AS (SELECT a.id AS u, b.id AS v FROM r a JOIN r b ON a.page = b.page AND a.id <> b.id WHERE {_GAP} <= 900),
t(node, seen) AS (SELECT u, u FROM e UNION SELECT t.node, e.v FROM t JOIN e ON t.seen = e.u) SELECT node, min(seen) AS component FROM t GROUP BY 1""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(pairs.near_pairs(regions(spark, d), 30), "a_id", "b_id")


@R.query("""SELECT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b, max(l_quantity) AS weight FROM lineitem WHERE l_suppkey <> l_partkey % 100 GROUP BY 1, 2""")
def undirected_edge_max(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100).alias("other"), "l_quantity")
    return graph.undirected_max(edges, "l_suppkey", "other", "l_quantity")


@R.query(f"""WITH {_REGIONS}, {_ALL_READS}, m AS (SELECT a.id AS node, b.id AS seed, pow(a.x - b.x, 2)::BIGINT + pow(a.y - b.y, 2)::BIGINT AS d2 FROM f a JOIN r b ON a.page = b.page)
SELECT node, arg_min(seed, (d2, seed)) AS seed, min(d2) AS distance_squared FROM m WHERE d2 <= 10000 GROUP BY 1""")
def nearest_seed(spark: SparkSession, d: str) -> DataFrame:
    """The region nearest to each distinct reading."""
    return seeds_of(all_readings(table(spark, d, "fragments")), regions(spark, d))


@R.query(f"""WITH RECURSIVE {_REGIONS}, e AS (SELECT a.id AS u, b.id AS v, sqrt(({_GAP})::DOUBLE) AS step FROM r a JOIN r b ON a.page = b.page AND a.id <> b.id WHERE {_GAP} <= 14400),
ends AS (SELECT page, arg_min(id, (y, x, id)) AS lo, arg_max(id, (y, x, id)) AS hi FROM r GROUP BY 1), seeds AS (SELECT lo AS s FROM ends UNION SELECT hi FROM ends),
t(node, owner, cost) USING KEY (node, owner) AS (SELECT s, s, 0.0::DOUBLE FROM seeds
  UNION SELECT e.v, t.owner, min(t.cost + e.step) FROM t JOIN e ON t.node = e.u LEFT JOIN recurring.t old ON old.node = e.v AND old.owner = t.owner WHERE t.cost + e.step <= 400 AND (old.cost IS NULL OR t.cost + e.step < old.cost) GROUP BY e.v, t.owner),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, owner) AS rn FROM t)
SELECT a.node, a.owner, a.cost, coalesce(b.cost - a.cost <= 0.5, false) AS contested FROM (FROM k WHERE rn = 1) a LEFT JOIN (FROM k WHERE rn = 2) b ON a.node = b.node""")
def multi_source_reach(spark: SparkSession, d: str) -> DataFrame:
    """Regions reached from each page's first region and its last over gaps of up to 120, within a path of 400."""
    boxes = regions(spark, d)
    edges = pairs.near_pairs(boxes, 120).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.sqrt(F.col("gap2").cast("double")).alias("cost"))
    ends = boxes.groupBy("page").agg(F.min(F.struct("y", "x", "id")).alias("lo"), F.max(F.struct("y", "x", "id")).alias("hi"))
    seeds = ends.select(F.explode(F.array_distinct(F.array("lo.id", "hi.id"))).alias("node"))
    return graph.multi_source_reach(edges, seeds.withColumn("owner", F.col("node")), 400.0)


def signature_words(vector: str = "embedding") -> list[Column]:
    """The first 64 values against their median as two 32-bit words, ``high`` and ``low``.

    The median is bound once as a lambda's variable; named as a column it would be sorted anew for every bit.
    """
    values = F.transform(F.slice(vector, 1, 64), lambda x: x.cast("double"))
    middle = F.transform(F.array(F.array_sort(values)), lambda s: (s[31] + s[32]) / 2)
    word = lambda start, m: F.aggregate(F.slice(values, start, 32), F.lit(0).cast("long"), lambda acc, x: acc * 2 + (x > m).cast("long"))
    both = F.transform(middle, lambda m: F.struct(word(1, m).alias("high"), word(33, m).alias("low")))[0]
    return [both["high"].alias("high"), both["low"].alias("low")]


_BITS = """s AS (SELECT vec_id, CAST(sum(CASE WHEN i <= 32 AND x > m THEN pow(2, 32 - i) ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN i > 32 AND x > m THEN pow(2, 64 - i) ELSE 0 END) AS BIGINT) AS low FROM (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i, list_median(embedding::DOUBLE[]) AS m FROM embeddings) GROUP BY 1)""".replace("list_median(embedding::DOUBLE[])", "list_aggregate(embedding::DOUBLE[], 'median')")


@R.query(f"WITH {_BITS} SELECT vec_id, high, low FROM s")
def bit_signature(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", *signature_words())


@R.query(f"WITH {_BITS}, c AS (SELECT high, low, min(vec_id) AS id FROM s GROUP BY 1, 2) SELECT a.id AS a_id, b.id AS b_id, bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) AS distance FROM c a JOIN c b ON a.id < b.id WHERE bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) <= 7")
def hamming_near_dup(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different signatures at most 7 bits apart; vectors of one signature stand under their smallest id."""
    return near_signatures(table(spark, d, "embeddings").select("vec_id", *signature_words()))


def near_signatures(rows: DataFrame) -> DataFrame:
    """``a_id, b_id, distance`` of the classes of ``rows(vec_id, high, low)`` whose 64 bits differ in 1 to 7 places.

    Of three bands of 22, 21 and 21 bits one differs in at most 2 places, so both signatures have a word within one bit
    of their own in common there: each is placed under its 23 or 22 nearest words of each band, and only those of one word
    meet. A class is named by its smallest id; rows without a signature pair with none.
    """
    classes = rows.groupBy("high", "low").agg(F.min("vec_id").alias("id"))  # a null signature has null keys, which meet none
    bits = F.shiftleft("high", 32).bitwiseOR(F.col("low"))
    keys = []
    for band, (shift, width) in enumerate(((42, 22), (21, 21), (0, 21))):
        word = F.shiftrightunsigned("bits", shift).bitwiseAND((1 << width) - 1)
        keys += [word.bitwiseXOR(F.lit(x).cast("long")) * 4 + band for x in (0, *[1 << i for i in range(width)])]  # plain expressions: compiled, unlike a lambda
    placed = classes.select("id", bits.alias("bits")).select("id", "bits", F.explode(F.array(*keys)).alias("key"))
    left, right = (placed.select(F.col("id").alias(f"{p}_id"), F.col("bits").alias(f"{p}_bits"), F.col("key").alias(f"{p}_key")) for p in "ab")
    met = left.join(right, (F.col("a_key") == F.col("b_key")) & (F.col("a_id") < F.col("b_id")))
    far = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))).alias("distance")
    close = F.coalesce("distance", F.lit(64)) <= 7  # says nothing of nulls, for which the signatures would be made once more
    return met.select("a_id", "b_id", far).where(close).distinct()


@R.query(f"""WITH RECURSIVE {_REGIONS}, e AS (SELECT a.id AS u, b.id AS v FROM r a JOIN r b ON a.page = b.page AND a.id <> b.id WHERE {_GAP} <= 900),
t(node, seen) AS (SELECT id, id FROM r UNION SELECT t.node, e.v FROM t JOIN e ON t.seen = e.u), c AS (SELECT node, min(seen) AS component FROM t GROUP BY 1),
g AS (SELECT page, component, min(y) AS y, min(x) AS x, min(id) AS id, count(*) AS n_members FROM r JOIN c ON r.id = c.node GROUP BY 1, 2)
SELECT page, component, 'g' || lpad((row_number() OVER (PARTITION BY page ORDER BY y, x, id))::VARCHAR, 3, '0') AS label, n_members FROM g""")
def component_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Components of a page's near regions, alone standing ones included, numbered from the top."""
    boxes = regions(spark, d)
    joined = boxes.join(graph.connected_components(pairs.near_pairs(boxes, 30), "a_id", "b_id"), F.col("id") == F.col("node"), "left")
    groups = joined.groupBy("page", F.coalesce("component", "id").alias("component")).agg(F.min("y").alias("y"), F.min("x").alias("x"), F.min("id").alias("id"), F.count("*").alias("n_members"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("y", "x", "id"))
    return groups.select("page", "component", F.format_string("g%03d", place).alias("label"), "n_members")
