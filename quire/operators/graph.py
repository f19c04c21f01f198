"""Graphs as edge tables: components, reach, nearest seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quire.session import cut_lineage


def undirected_max(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """``a, b, weight`` of unordered pairs, the greatest weight of each; loops are left out."""
    a, b = F.least(src, dst), F.greatest(src, dst)
    return edges.where(F.col(src) != F.col(dst)).groupBy(a.alias("a"), b.alias("b")).agg(F.max(weight).alias("weight"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node with an edge; a component is named by its smallest node.

    Alternating large-star and small-star rounds: each node's neighbours are linked to its smallest neighbour, which
    keeps the number of edges and takes a logarithmic number of rounds. Minima combine map-side; a hub's edges are split
    by adaptive execution. Null ends are no edges. More than ``most_rounds`` rounds raise.
    """
    links = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("u"), F.col(dst).alias("v")).distinct()
    links = cut_lineage(links)
    nodes = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    links = links.where("u <> v")
    before = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("low"))
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("low"))
        joined = down.join(low, F.col("u") == F.col("x"))
        small = joined.select("v", "low").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        seen = Observation()
        step = small.unionByName(low.select(F.col("x").alias("u"), F.col("low").alias("v"))).distinct()
        links = cut_lineage(step.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        state = seen.get
        if state == before:
            return nodes.join(links, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
        before = state
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def multi_source_reach(edges: DataFrame, seeds: DataFrame, bound: float, tie: float = 0.5, most_rounds: int = 10_000) -> DataFrame:
    """``node, owner, cost, contested``: the seed each node is nearest to within ``bound``.

    ``edges``: a, b, cost >= 0, undirected; ``seeds``: node, owner. A node is contested if another owner reaches it within
    ``tie`` of the best. Two owners a node are kept in each round of relaxation, which is enough for both answers. A path
    of k edges takes k rounds; more than ``most_rounds`` rounds raise.
    """
    two = edges.select("a", "b", "cost").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost")).groupBy("a", "b").agg(F.min("cost").alias("step"))
    two = cut_lineage(two)

    def best_two(rows: DataFrame) -> DataFrame:
        per = rows.groupBy("node", "owner").agg(F.min("cost").alias("cost"))
        first = per.groupBy(F.col("node").alias("n1")).agg(F.min(F.struct("cost", "owner")).alias("m"))
        rest = per.join(first, (F.col("node") == F.col("n1")) & (F.col("owner") != F.col("m.owner"))).groupBy(F.col("node").alias("n2")).agg(F.min(F.struct("cost", "owner")).alias("m"))
        return first.select(F.col("n1").alias("node"), "m.owner", "m.cost").unionByName(rest.select(F.col("n2").alias("node"), "m.owner", "m.cost"))

    state = cut_lineage(best_two(seeds.select("node", "owner", F.lit(0.0).alias("cost"))))
    before = None
    for _ in range(most_rounds):
        moved = state.join(two, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "owner", (F.col("cost") + F.col("step")).alias("cost")).where(F.col("cost") <= bound)
        seen = Observation()
        measures = (F.count(F.lit(1)).alias("n"), F.sum("cost").alias("c"), F.sum(F.xxhash64("node", "owner").cast("decimal(38,0)")).alias("h"))
        state = cut_lineage(best_two(state.unionByName(moved)).observe(seen, *measures))
        now = seen.get
        if before is not None and now["n"] == before["n"] and now["h"] == before["h"] and abs((now["c"] or 0) - (before["c"] or 0)) < 1e-9:
            break
        before = now
    else:
        raise RuntimeError(f"costs still fall after {most_rounds} rounds")
    ranked = state.groupBy("node").agg(F.min(F.struct("cost", "owner")).alias("m"), F.max("cost").alias("far"), F.count("*").alias("k"))
    return ranked.select("node", "m.owner", "m.cost", ((F.col("k") > 1) & (F.col("far") - F.col("m.cost") <= tie)).alias("contested"))


def widest_paths(edges: DataFrame, sources: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """``node, source, width``: for every node that a source reaches the greatest least capacity along a path between them.

    ``edges``: a, b, capacity, undirected; ``sources``: source, few to a component (rows grow with sources times the nodes
    they reach). Only widths that grew in a round move on in the next; a path of k edges takes k rounds, more than
    ``most_rounds`` raise. Null ends and capacities are no edges; a source is no row of its own.
    """
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("capacity").isNotNull() & (F.col("a") != F.col("b")))
    both = known.select("a", "b", "capacity").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "capacity"))
    both = cut_lineage(both.groupBy("a", "b").agg(F.max("capacity").alias("capacity")))
    start = sources.where(F.col("source").isNotNull()).select("source").distinct()
    first = start.join(both, F.col("source") == F.col("a")).select(F.col("b").alias("node"), "source", F.col("capacity").alias("width"))
    state = cut_lineage(first.withColumn("grew", F.lit(True)))
    for _ in range(most_rounds):
        moved = state.where("grew").join(both, F.col("node") == F.col("a")).where(F.col("b") != F.col("source"))
        moved = moved.select(F.col("b").alias("node"), "source", F.least("width", "capacity").alias("width"))
        old = state.select("node", "source", "width", F.col("width").alias("was"))
        all_of = old.unionByName(moved.withColumn("was", F.lit(None).cast(state.schema["width"].dataType)))
        best = all_of.groupBy("node", "source").agg(F.max("width").alias("width"), F.max("was").alias("was"))
        grew = F.col("was").isNull() | (F.col("width") > F.col("was"))
        seen = Observation()
        state = cut_lineage(best.select("node", "source", "width", grew.alias("grew")).observe(seen, F.count_if(F.col("grew")).alias("n")))
        if not seen.get["n"]:
            return state.select("node", "source", "width")
    raise RuntimeError(f"widths still grow after {most_rounds} rounds")


def nearest_seed(nodes: DataFrame, seeds: DataFrame, block: str, x: str, y: str, cell: int, radius: int) -> DataFrame:
    """``node, seed, distance_squared`` of the nearest seed within ``radius`` in the same block; ties go to the smaller seed.

    Seeds are put into every grid cell within the radius, so each node meets the seeds near it and no others.
    """
    reach = -(-radius // cell)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    spread = seeds.select(F.col(block).alias("sb"), F.col("seed"), F.col(x).alias("sx"), F.col(y).alias("sy"), F.floor(F.col(x) / cell).alias("gx"), F.floor(F.col(y) / cell).alias("gy"))
    spread = spread.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select("sb", "seed", "sx", "sy", (F.col("gx") + F.col("dx")).alias("cx"), (F.col("gy") + F.col("dy")).alias("cy"))
    at = (F.col(block) == F.col("sb")) & (F.floor(F.col(x) / cell) == F.col("cx")) & (F.floor(F.col(y) / cell) == F.col("cy"))
    far = (F.col(x) - F.col("sx")).cast("long") * (F.col(x) - F.col("sx")) + (F.col(y) - F.col("sy")).cast("long") * (F.col(y) - F.col("sy"))
    met = nodes.join(spread, at).select("node", "seed", far.alias("d2")).where(F.col("d2") <= radius * radius)
    return met.groupBy("node").agg(F.min(F.struct("d2", "seed")).alias("m")).select("node", "m.seed", F.col("m.d2").alias("distance_squared"))
