"""Best-fit packing of texts into containers of fixed capacity, under conflicts.

Items are taken by falling size. Open containers lie in buckets by residual capacity; a bit per residual makes the
successor search (the least residual that still holds the item) a shift and a lowest-bit test. Each container carries a
bitmap of the sources in it and one of the duplicate clusters in it: a container that holds a copy of the item is no
place for it, and the search goes on to the next residual until the tightest compatible container is found. Among
containers equally tight one without the item's source is preferred; with ``separate_sources`` it is required.

Packing is done in shards of bounded size, each full of containers, so the loss against one packing is a few
containers a shard.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import shipped

ITEMS_PER_SHARD = 25_000
MAX_BUDGETS = 1_000
PLACE_SCHEMA = "budget_id int, item_id long, piece int, container_id long, container_offset long, item_offset long, n_tokens long"


def duplicate_cluster(text: Column | str) -> Column:
    """Cluster of copies: equal after dropping case and everything but letters and digits. Null where nothing remains."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", F.xxhash64(bare))


class _Bins:
    """Containers of one shard and capacity."""

    def __init__(self, capacity: int, separate_sources: bool) -> None:
        self.capacity, self.separate = capacity, separate_sources
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.buckets: dict[int, dict[int, list[int]]] = {}  # residual -> source bitmap -> containers
        self.occupied = 0

    def _open(self) -> int:
        self.residual.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        return len(self.residual) - 1

    def _shelve(self, b: int) -> None:
        r = self.residual[b]
        self.buckets.setdefault(r, {}).setdefault(self.sources[b], []).append(b)
        self.occupied |= 1 << r

    def _take(self, size: int, source: int, cluster: int) -> int | None:
        """Tightest compatible container, taken off its shelf."""
        left = self.occupied >> size
        r = size
        while left:
            step = (left & -left).bit_length() - 1
            r += step
            shelf = self.buckets[r]
            masks = [m for m in shelf if not m & source]
            if not self.separate:
                masks += [m for m in shelf if m & source]
            for mask in masks:
                row = shelf[mask]
                for i in range(len(row) - 1, -1, -1):
                    b = row[i]
                    if not self.clusters[b] & cluster:
                        row[i] = row[-1]
                        row.pop()
                        if not row:
                            del shelf[mask]
                            if not shelf:
                                del self.buckets[r]
                                self.occupied &= ~(1 << r)
                        return b
            left >>= step + 1
            r += 1
        return None

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Container and offset of an item that fits one."""
        b = self._take(size, source, cluster)
        if b is None:
            b = self._open()
        offset = self.capacity - self.residual[b]
        self.residual[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self._shelve(b)
        return b, offset


def pack(items: pd.DataFrame, capacity: int, separate_sources: bool = False) -> list[tuple[int, int, int, int, int, int]]:
    """(item, piece, container, offset in container, offset in item, tokens) of ``item_id, n_tokens, source, cluster`` rows.

    An item above the capacity fills containers of its own; what remains of it is packed as the others are.
    """
    rows = list(zip(items["item_id"].tolist(), items["n_tokens"].tolist(), items["source"].tolist(), items["cluster"].tolist()))
    many = Counter(c for _, _, _, c in rows if not pd.isna(c))
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(c for c, n in many.items() if n > 1))}
    source_bit = {s: 1 << i for i, s in enumerate(sorted({s for _, _, s, _ in rows if not pd.isna(s)}))}
    out, open_items, bins = [], [], _Bins(capacity, separate_sources)
    for item, size, source, cluster in rows:
        piece = offset = 0
        while size - offset > capacity:
            b = bins._open()
            bins.residual[b] = 0
            out.append((item, piece, b, 0, offset, capacity))
            piece, offset = piece + 1, offset + capacity
        open_items.append((size - offset, item, piece, offset, 0 if pd.isna(source) else source_bit[source], cluster_bit.get(cluster, 0)))
    open_items.sort(key=lambda x: (-x[0], x[1]))
    for size, item, piece, offset, source, cluster in open_items:
        b, at = bins.place(size, source, cluster)
        out.append((item, piece, b, at, offset, size))
    return out


def pack_items(items: DataFrame, budgets: DataFrame, items_per_shard: int = ITEMS_PER_SHARD, separate_sources: bool = False, n_items: int | None = None) -> DataFrame:
    """The place of every item in containers of every budget, columns of ``PLACE_SCHEMA``.

    ``items``: item_id, n_tokens, source, cluster (null: no known source, no copies). ``budgets``: budget_id,
    capacity_tokens; few by nature, more than ``MAX_BUDGETS`` are refused. Items delivered twice are placed once; items
    of no tokens take a place of no length; ``n_items``, where the caller knows it, saves counting the items, which may
    cost as much as making them; null ids and capacities below 1 are left out. Empty tables give no rows.
    """
    capacities = budgets.where((F.col("capacity_tokens") > 0) & F.col("budget_id").isNotNull()).select("budget_id", "capacity_tokens").distinct().limit(MAX_BUDGETS + 1).collect()
    if len(capacities) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets")
    spark = items.sparkSession
    if not capacities:
        return spark.createDataFrame([], PLACE_SCHEMA)
    shards = max(1, -(-(items.count() if n_items is None else n_items) // items_per_shard))
    known = F.array(*[F.struct(F.lit(r["budget_id"]).cast("int").alias("budget_id"), F.lit(r["capacity_tokens"]).cast("long").alias("capacity")) for r in capacities])
    spread = (
        items.where(F.col("item_id").isNotNull())
        .select("item_id", "n_tokens", "source", "cluster", F.pmod(F.xxhash64("item_id"), F.lit(shards)).alias("shard"), F.explode(known).alias("b"))
        .select("item_id", "n_tokens", "source", "cluster", "shard", "b.budget_id", "b.capacity")
    )

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        budget, capacity, shard = int(frame["budget_id"].iloc[0]), int(frame["capacity"].iloc[0]), int(frame["shard"].iloc[0])
        once = frame.sort_values(["item_id", "n_tokens"]).drop_duplicates("item_id")
        placed = pd.DataFrame(pack(once, capacity, separate_sources), columns=["item_id", "piece", "bin", "container_offset", "item_offset", "n_tokens"])
        placed["budget_id"], placed["container_id"] = budget, placed["bin"] + (shard << 32)
        return placed[[c.split()[0] for c in PLACE_SCHEMA.split(", ")]]

    return shipped(spread).groupBy("budget_id", "shard").applyInPandas(one, PLACE_SCHEMA)


def fill_report(places: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: containers, tokens, share of space unused, and the fewest containers that could hold the tokens."""
    per = places.groupBy(F.col("budget_id").alias("b")).agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    joined = budgets.select("budget_id", "budget_name", "capacity_tokens").distinct().join(F.broadcast(per), F.col("budget_id") == F.col("b"))  # a row a budget
    room = F.col("n_containers") * F.col("capacity_tokens")
    return joined.select(
        "budget_id", "budget_name", "n_containers", "n_tokens",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(1 - F.col("n_tokens") / room, 6).alias("unused_share"),
    )
