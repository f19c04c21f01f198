"""Parent-child rows to full hierarchies: path, depth, root, descendants and cycles.

Components come from pointer doubling (a node has at most one parent, so a weak component is one tree or one cycle with
trees hanging on it): log2(depth) joins whatever the depth. Each component is then co-located and walked depth-first with
node colouring, as long as a task can hold its nodes and write its paths; a larger one never enters one task, its paths
and counts are doubled by joins in the same way and give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quire.session import cut_lineage, parallelism, shipped

#: Nodes of a component that one task holds (some 400 bytes each), and path entries of a component that one task writes.
MAX_COMPONENT = 500_000
MAX_PATH_NODES = 20_000_000
SLICE_ENTRIES = 200_000
CYCLE_PREFIX = "cycle:"
TREE_SCHEMA = (
    "node_id string, parent_id string, root_id string, depth int, path array<string>, n_descendants long, node_state string"
)
NARROW_SCHEMA = TREE_SCHEMA.replace(" path array<string>,", "")


def parent_links(rows: DataFrame, node: str, parent: str, latest_by: list[str]) -> DataFrame:
    """One row per node: ``node_id``, ``parent_id`` (null for none), ``dangling`` (named parent has no row).

    Of several rows of one node the latest by ``latest_by`` counts (ties: the larger parent id). Null node ids are no
    nodes; null and empty parents are none.
    """
    named = F.when(F.col(parent) != "", F.col(parent))
    order = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(latest_by)], named.alias("named"))
    nodes = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node_id")).agg(F.max(order)["named"].alias("named"))
    known = nodes.select(F.col("node_id").alias("known_id"))
    return nodes.join(known, F.col("named") == F.col("known_id"), "left").select(
        "node_id",
        F.col("known_id").alias("parent_id"),
        F.col("named").alias("named_parent"),
        (F.col("named").isNotNull() & F.col("known_id").isNull()).alias("dangling"),
    )


def label_components(links: DataFrame) -> DataFrame:
    """``node_id, parent_id, label, on_cycle, hops``: label is the root's id, or ``cycle:`` and the smallest id on the cycle;
    hops is the distance to the root, null where the way up ends in a cycle."""
    state = cut_lineage(
        links.select(
            "node_id", "parent_id", F.col("parent_id").alias("hop"), F.col("node_id").alias("low"),
            F.when(F.col("parent_id").isNull(), F.col("node_id")).alias("label"),
            F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("hops"),
        )
    )
    # Trees hold nodes of every depth up to their greatest, so a round that settles no node leaves only nodes that run into
    # cycles. Doubling a step that maps its own image one to one moves along cycles alone, and windows that no doubling
    # lowers cover them.
    is_open = F.col("label").isNull()
    before, image = -1, None
    while True:
        ahead = state.select(F.col("node_id").alias("at"), F.col("hop").alias("hop2"), F.col("low").alias("low2"), F.col("label").alias("label2"), F.col("hops").alias("hops2"))
        moved = (
            state.where(is_open)
            .join(ahead, F.col("hop") == F.col("at"))
            .select(
                "node_id", "parent_id", F.col("hop2").alias("hop"), F.least("low", "low2").alias("low"), F.col("label2").alias("label"),
                (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("low2") < F.col("low")).alias("lowered"),
            )
        )
        seen = Observation()
        # Settled rows stay where they are; without the coalesce every round would add its partitions to theirs.
        step = state.where(~is_open).withColumn("lowered", F.lit(False)).unionByName(moved).coalesce(parallelism(links.sparkSession))
        step = cut_lineage(step.observe(seen, F.count_if(is_open).alias("n_open"), F.count_if(is_open & F.col("lowered")).alias("n_lowered"))).drop("lowered")
        active, lowered = seen.get["n_open"], seen.get["n_lowered"]
        if not active:
            return step.select("node_id", "parent_id", "label", F.lit(False).alias("on_cycle"), "hops")
        if active == before and not lowered:
            was = image if image is not None else state.where(is_open).select("hop").distinct().count()
            image = step.where(is_open).select("hop").distinct().count()
            if image == was:
                state = step
                break
        else:
            image = None
        state, before = step, active
    open_rows = state.where(is_open)
    ends = open_rows.select(F.col("hop").alias("end_id")).distinct()
    lows = open_rows.select(F.col("node_id").alias("at"), F.col("low").alias("cycle_low"))
    cyclic = (
        open_rows.join(lows, F.col("hop") == F.col("at"))
        .join(ends, F.col("node_id") == F.col("end_id"), "left")
        .select("node_id", "parent_id", F.concat(F.lit(CYCLE_PREFIX), "cycle_low").alias("label"), F.col("end_id").isNotNull().alias("on_cycle"), F.lit(None).cast("long").alias("hops"))
    )
    done = state.where(~is_open).select("node_id", "parent_id", "label", F.lit(False).alias("on_cycle"), "hops")
    return cut_lineage(done.unionByName(cyclic))


def _walk(ids: list[str], parents: list[str | None], paths: bool, most: int = SLICE_ENTRIES) -> Iterator[list[tuple]]:
    """Rows of one or more whole components in slices, by iterative depth-first traversal with colours (white 0, grey 1, black 2).

    Without ``paths`` rows have none. A slice ends at ``most`` path entries, so what is held grows with the nodes alone.
    """
    at = {x: i for i, x in enumerate(ids)}
    up = [at.get(p, -1) if p is not None else -1 for p in parents]
    n = len(ids)
    del at
    colour, ring = bytearray(n), {}
    for start in range(n):
        trail, v = [], start
        while v >= 0 and colour[v] == 0:
            colour[v] = 1
            trail.append(v)
            v = up[v]
        if v >= 0 and colour[v] == 1:  # a back edge closes a cycle
            members = trail[trail.index(v) :]
            low = min(ids[m] for m in members)
            for m in members:
                ring[m] = low
        for v in trail:
            colour[v] = 2
    below: dict[int, list[int]] = {}
    tops = []
    for v in range(n):
        if up[v] < 0 or v in ring:
            tops.append(v)
        else:
            below.setdefault(up[v], []).append(v)
    order, stack = [], tops[::-1]
    while stack:
        v = stack.pop()
        order.append(v)
        stack.extend(below.get(v, ()))
    size = [1] * n
    in_ring: dict[str, int] = {}
    for v in reversed(order):
        if v in ring:
            in_ring[ring[v]] = in_ring.get(ring[v], 0) + size[v]
        elif up[v] >= 0:
            size[up[v]] += size[v]
    path: list[str] = []
    depth = [0] * n
    out, held, root = [], 0, ""
    for v in order:  # a node follows its parent, so the path above it is a stack
        if up[v] < 0 or v in ring:
            top, root = v, CYCLE_PREFIX + ring[v] if v in ring else ids[v]
        else:
            depth[v] = depth[up[v]] + 1
        kind = "cycle" if v in ring else "into_cycle" if top in ring else "root" if depth[v] == 0 else "tree"
        below_it = (in_ring[ring[v]] if v in ring else size[v]) - 1
        if paths:
            del path[depth[v] :]
            path.append(ids[v])
            out.append((ids[v], parents[v], root, depth[v], path.copy(), below_it, kind))
            held += len(path)
        else:
            out.append((ids[v], parents[v], root, depth[v], below_it, kind))
            held += 1
        if held >= most:
            yield out
            out, held = [], 0
    if out:
        yield out


def _walk_partition(paths: bool):
    """Components arrive one after another; the last of a batch may go on in the next and is held back."""
    columns = [c.split()[0] for c in (TREE_SCHEMA if paths else NARROW_SCHEMA).split(", ")]

    def rows(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = [x for p in parts for x in p["node_id"].tolist()]
        parents = [None if x is None or x != x else x for p in parts for x in p["parent_id"].tolist()]
        for piece in _walk(ids, parents, paths):
            yield pd.DataFrame(piece, columns=columns)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            last = batch["label"].iloc[-1]
            whole = batch["label"].to_numpy() != last
            if whole.any() or (held and held[-1]["label"].iloc[-1] != last):
                yield from rows([*held, batch[whole]])
                held = []
            held.append(batch[~whole])
        if held:
            yield from rows(held)

    return walk


def _double(labelled: DataFrame, paths: bool) -> DataFrame:
    """The same rows for components of any size, by joins alone: after k rounds a node knows the path of its 2^k nearest
    ancestors and the number of nodes fewer than 2^k steps below it."""
    start = labelled.select(
        "node_id", "parent_id", "label", "on_cycle", F.when(~F.col("on_cycle"), F.col("parent_id")).alias("hop"),
        F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("n_near"), F.array("node_id").alias("rising"),
    )
    state = cut_lineage(start if paths else start.drop("rising"))
    rising = [F.when(F.col("at").isNull(), F.col("rising")).otherwise(F.concat("rising", "rising2")).alias("rising")] if paths else []
    span = 1
    while True:
        ahead = state.select(F.col("node_id").alias("at"), F.col("hop").alias("hop2"), F.col("depth").alias("depth2"), *([F.col("rising").alias("rising2")] if paths else []))
        gain = state.where(F.col("hop").isNotNull()).groupBy(F.col("hop").alias("into")).agg(F.sum("n_near").alias("gain"))
        seen = Observation()
        step = (
            state.join(ahead, F.col("hop") == F.col("at"), "left")
            .join(gain, F.col("node_id") == F.col("into"), "left")
            .select(
                "node_id", "parent_id", "label", "on_cycle", F.col("hop2").alias("hop"),
                F.when(F.col("at").isNull(), F.col("depth")).otherwise(F.lit(span) + F.col("depth2")).alias("depth"),
                (F.col("n_near") + F.coalesce("gain", F.lit(0))).alias("n_near"), *rising,
            )
        )
        state = cut_lineage(step.observe(seen, F.count("hop").alias("n_open")))
        span *= 2
        if not seen.get["n_open"]:
            break
    ring = state.groupBy(F.col("label").alias("of")).agg((F.count("*") - 1).alias("n_ring"))
    cyclic = F.col("label").startswith(CYCLE_PREFIX)
    state_name = (
        F.when(F.col("on_cycle"), "cycle").when(cyclic, "into_cycle").when(F.col("parent_id").isNull(), "root").otherwise("tree")
    )
    return state.join(ring, F.col("label") == F.col("of")).select(
        "node_id", "parent_id", F.col("label").alias("root_id"), F.col("depth").cast("int"), *([F.reverse("rising").alias("path")] if paths else []),
        F.when(F.col("on_cycle"), F.col("n_ring")).otherwise(F.col("n_near") - 1).alias("n_descendants"), state_name.alias("node_state"),
    )


def resolve_hierarchy(links: DataFrame, max_component: int = MAX_COMPONENT, max_path_nodes: int = MAX_PATH_NODES, paths: bool = True) -> DataFrame:
    """Full hierarchy of ``parent_links`` rows, columns of ``TREE_SCHEMA``, or of ``NARROW_SCHEMA`` without ``paths``.

    ``path`` runs from the root (or the node where a cycle is entered) to the node, ``depth`` is its length less one; all
    paths together have as many entries as the sum of depths. On a cycle every node has depth 0 and all nodes of its
    component as descendants; ``node_state`` is root, tree, cycle or into_cycle. ``max_component`` bounds the nodes that
    one task holds and ``max_path_nodes`` the path entries that it writes; components beyond take another way to the
    same rows. An empty table gives no rows.
    """
    labelled = label_components(links)
    n = F.count("*")
    entries = F.coalesce(F.sum("hops"), n * n)  # where a cycle is entered is unknown yet: at most n entries a node
    sizes = labelled.groupBy("label").agg(n.alias("n_nodes"), entries.alias("n_entries"))
    too_big = F.col("n_nodes") > max_component
    if paths:
        too_big = too_big | (F.col("n_entries") > max_path_nodes)
    has_big = bool(sizes.agg(F.max(too_big).alias("any")).first()["any"])
    big = cut_lineage(sizes.where(too_big).select("label")) if has_big else None
    small = labelled.join(big, "label", "left_anti") if has_big else labelled
    placed = small.select("label", "node_id", "parent_id").repartition("label").sortWithinPartitions("label")
    walked = shipped(placed).mapInPandas(_walk_partition(paths), TREE_SCHEMA if paths else NARROW_SCHEMA)
    return walked.unionByName(_double(labelled.join(big, "label", "left_semi"), paths)) if has_big else walked


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """``ancestor_id, descendant_id, distance`` for every proper ancestor; a whole cycle is one ancestor, its ``root_id``.

    Rows grow with the sum of depths, never with the square of a component; members of a cycle are listed once, under it.
    """
    steps = F.posexplode(F.slice("path", 1, F.size("path") - 1))
    plain = tree.where(F.col("depth") > 0).select("node_id", "depth", "root_id", "node_state", steps.alias("step", "above"))
    in_cycle: Column = (F.col("node_state") == "into_cycle") & (F.col("step") == 0)
    pairs = plain.select(
        F.when(in_cycle, F.col("root_id")).otherwise(F.col("above")).alias("ancestor_id"),
        F.col("node_id").alias("descendant_id"),
        (F.col("depth") - F.col("step")).alias("distance"),
    )
    members = tree.where(F.col("node_state") == "cycle").select(F.col("root_id").alias("ancestor_id"), F.col("node_id").alias("descendant_id"), F.lit(0).alias("distance"))
    return pairs.unionByName(members)
