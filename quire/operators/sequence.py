"""Ordered data: islands, runs, sessions, segments, alignment and greedy selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import cut_lineage, parallelism, shipped


HOT_ROWS = 5_000_000


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``q_hot``: keys with more than ``hot_rows`` rows, null if there are none. Counts combine before they are shuffled."""
    hot = rows.groupBy(F.col(key).alias("q_hot")).agg(F.count("*").alias("q_n")).where(F.col("q_n") > hot_rows).select("q_hot")
    return hot if hot.limit(1).count() else None


def _split(rows: DataFrame, key: str, order: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and those of hot ones in chunks that follow each other in order (cut, so that they stay as they are)."""
    same = F.col(key).eqNullSafe(F.col("q_hot"))
    ranged = rows.join(hot, same, "left_semi").repartitionByRange(parallelism(rows.sparkSession), key, *order)
    return rows.join(hot, same, "left_anti"), cut_lineage(ranged.withColumn("q_chunk", F.spark_partition_id()))


def with_previous(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], hot: DataFrame | None = None) -> DataFrame:
    """Rows with ``before``, a struct of ``columns`` of the row before in the key, null for the first.

    A hot key is no single window: each of its chunks looks back within itself and its first row takes the last row of
    the chunk before.
    """
    look = F.lag(F.struct(*columns))
    plain = lambda df: df.withColumn("before", look.over(Window.partitionBy(key).orderBy(*order)))
    if hot is None:
        return plain(rows)
    ordinary, chunks = _split(rows, key, order, hot)
    ends = chunks.groupBy(F.col(key).alias("q_end_key"), F.col("q_chunk").alias("q_end_chunk")).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("q_last"))
    carried = ends.withColumn("q_carried", F.lag("q_last").over(Window.partitionBy("q_end_key").orderBy("q_end_chunk"))).drop("q_last")
    local = chunks.withColumn("before", look.over(Window.partitionBy(key, "q_chunk").orderBy(*order)))
    joined = local.join(carried, F.col(key).eqNullSafe(F.col("q_end_key")) & (F.col("q_chunk") == F.col("q_end_chunk")))
    return plain(ordinary).unionByName(joined.select(*rows.columns, F.coalesce("before", "q_carried").alias("before")))


def running_sum(rows: DataFrame, key: str, order: Sequence[str], value: F.Column, name: str, hot: DataFrame | None = None) -> DataFrame:
    """Rows with the sum of ``value`` up to and with each row of its key; chunks of a hot key add the totals before them."""
    frame = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if hot is None:
        return rows.withColumn(name, F.sum(value).over(frame(key)))
    ordinary, chunks = _split(rows, key, order, hot)
    totals = chunks.groupBy(F.col(key).alias("q_end_key"), F.col("q_chunk").alias("q_end_chunk")).agg(F.sum(value).alias("q_total"))
    upto = Window.partitionBy("q_end_key").orderBy("q_end_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("q_carried", F.coalesce(F.sum("q_total").over(upto), F.lit(0)))
    joined = chunks.withColumn(name, F.sum(value).over(frame(key, "q_chunk"))).join(carried, F.col(key).eqNullSafe(F.col("q_end_key")) & (F.col("q_chunk") == F.col("q_end_chunk")))
    summed = joined.select(*rows.columns, (F.col(name) + F.col("q_carried")).alias(name))
    return ordinary.withColumn(name, F.sum(value).over(frame(key))).unionByName(summed)


def islands(rows: DataFrame, key: str, order: Sequence[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Runs of equal values (null-safe) per key: ``key, run, value, length``; runs are numbered from 1. ``order`` must settle ties."""
    hot = hot_keys(rows, key, hot_rows)
    looked = with_previous(rows, key, order, [value], hot)
    starts = (F.col("before").isNull() | ~F.col(value).eqNullSafe(F.col("before")[value])).cast("int")
    numbered = running_sum(looked.withColumn("is_start", starts).drop("before"), key, order, F.col("is_start"), "run", hot)
    return numbered.groupBy(key, "run", value).agg(F.count("*").alias("length"))


def expand_runs(runs: DataFrame, start: str, length: str, name: str) -> DataFrame:
    """One row per position of each run; runs of no length give none."""
    return runs.where(F.col(length) > 0).withColumn(name, F.explode(F.sequence(F.col(start), F.col(start) + F.col(length) - 1)))


def sessions(rows: DataFrame, key: str, time: str, gap_seconds: int, order: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with ``session``, which goes up where more than ``gap_seconds`` pass since the row before. ``order`` settles ties of time."""
    hot = hot_keys(rows, key, hot_rows)
    looked = with_previous(rows, key, [time, *order], [time], hot)
    waited = F.unix_micros(F.col(time).cast("timestamp_ltz")) - F.unix_micros(F.col("before")[time].cast("timestamp_ltz"))
    opens = (F.coalesce(waited, F.lit(gap_seconds * 1_000_000 + 1)) > gap_seconds * 1_000_000).cast("int")
    return running_sum(looked.withColumn("opens", opens).drop("before"), key, [time, *order], F.col("opens"), "session", hot).drop("opens")


def first_where(rows: DataFrame, key: str, order: Sequence[str], condition: F.Column, value: str, otherwise: str) -> DataFrame:
    """``key, first``: the value of the first row for which the condition holds, ``otherwise`` where none does."""
    hit = F.min_by(F.when(condition, F.col(value)), F.when(condition, F.struct(*order)))
    return rows.groupBy(key).agg(F.coalesce(hit, F.lit(otherwise)).alias("first"))


def by_group(rows: DataFrame, key: str, body, schema: str) -> DataFrame:
    """Rows of each key as one frame for an algorithm that needs them in sequence; keys stream past sorted, so small groups
    cost no call of their own. The caller's keys must bound the group (a page, a grid cell, a block)."""

    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            last = batch[key].iloc[-1]
            tail = batch[key].eq(last) if last is not None and last == last else batch[key].isna()
            head = batch[~tail]
            if held and (len(head) or not _same(held[-1][key].iloc[-1], last)):
                for _, g in pd.concat([*held, head]).groupby(key, dropna=False, sort=False):
                    yield body(g)
                held = []
            elif len(head):
                for _, g in head.groupby(key, dropna=False, sort=False):
                    yield body(g)
            held.append(batch[tail])
        if held:
            for _, g in pd.concat(held).groupby(key, dropna=False, sort=False):
                yield body(g)

    return shipped(rows.repartition(key).sortWithinPartitions(key)).mapInPandas(partition, schema)


def _same(a: object, b: object) -> bool:
    return a == b or pd.isna(a) and pd.isna(b)


def jump_segments(tops: Sequence[float], heights: Sequence[float], least: float = 48, share: float = 0.65) -> list[int]:
    """Segment numbers of positions in order: a new segment begins where a position lies further from the median of the
    segment so far than ``least`` and ``share`` of the median height."""
    out: list[int] = []
    segment, anchors, sizes = 0, [], []
    for top, height in zip(tops, heights):
        if anchors and abs(top - float(np.median(anchors))) > max(least, share * float(np.median(sizes))):
            segment, anchors, sizes = segment + 1, [], []
        anchors.append(top)
        sizes.append(height)
        out.append(segment)
    return out


def monotonic_alignment(scores: np.ndarray, gap: float = -0.22) -> list[tuple[int | None, int | None]]:
    """Order-preserving pairing of rows with columns of greatest total score, unpaired ones at a price.

    Ties prefer a pair, then leaving out a row, then a column.
    """
    n, m = scores.shape
    best = np.zeros((n + 1, m + 1))
    best[:, 0], best[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j - 1] + scores[i - 1, j - 1], best[i - 1, j] + gap, best[i, j - 1] + gap)
    out: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        if i and j and best[i, j] == best[i - 1, j - 1] + scores[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and (not j or best[i, j] == best[i - 1, j] + gap):
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def greedy_keep(boxes: np.ndarray, limit: float) -> np.ndarray:
    """Which boxes (x, y, w, h in order) stay when each is dropped that overlaps an earlier kept one by an IoU of ``limit``."""
    kept: list[int] = []
    keep = np.zeros(len(boxes), bool)
    area = boxes[:, 2] * boxes[:, 3]
    for i, (x, y, w, h) in enumerate(boxes):
        k = np.array(kept, int)
        wide = np.minimum(boxes[k, 0] + boxes[k, 2], x + w) - np.maximum(boxes[k, 0], x)
        high = np.minimum(boxes[k, 1] + boxes[k, 3], y + h) - np.maximum(boxes[k, 1], y)
        shared = np.clip(wide, 0, None) * np.clip(high, 0, None)
        union = area[k] + area[i] - shared
        if not (np.divide(shared, union, out=np.zeros(len(k)), where=union > 0) >= limit).any():
            kept.append(i)
            keep[i] = True
    return keep


def greedy_distinct(signatures: Sequence[int], limit: int) -> list[int]:
    """Places of the signatures kept when each is dropped that differs from an earlier kept one in at most ``limit`` bits."""
    kept: list[int] = []
    for i, s in enumerate(signatures):
        if all((s ^ signatures[k]).bit_count() > limit for k in kept):
            kept.append(i)
    return kept


CHUNK_ROWS = 16_384


def _near_in_chunks(g: pd.DataFrame, limit: int, slice_rows: int = 256) -> Iterator[pd.DataFrame]:
    """``lo, hi``: nodes of a pair of chunks (one with itself, or one with the other) whose bits differ in at most ``limit`` places."""
    g = g.sort_values("node")
    a, b = (g[g["chunk"] == g[side].iloc[0]] for side in ("first", "second"))
    one, two = (x["bits"].to_numpy("int64").view("uint64") for x in (a, b))
    left, right = a["node"].to_numpy(), b["node"].to_numpy()
    for at in range(0, len(one), slice_rows):
        i, j = np.nonzero(np.bitwise_count(one[at : at + slice_rows, None] ^ two[None, :]) <= limit)
        x, y = left[at + i], right[j]
        keep = x < y if g["first"].iloc[0] == g["second"].iloc[0] else np.ones(len(x), bool)
        x, y = x[keep], y[keep]
        if len(x):
            swap = x > y
            yield pd.DataFrame({"lo": np.where(swap, y, x), "hi": np.where(swap, x, y)})


def hamming_pairs(nodes: DataFrame, key: str, limit: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``lo, hi`` (``lo < hi``) of all ``nodes(node string, key, bits long)`` of a key whose bits differ in at most ``limit`` of 64 places.

    Exact for any limit: a key's nodes are cut into chunks and every two chunks are compared in a task of their own, so a
    hot key is no single task. With a limit of a quarter of the bits, bands that must agree have 3 or 4 bits and would
    spare nothing. A null key is a key; nodes without bits pair with none.
    """
    rows = nodes.where(F.col("bits").isNotNull()).select("node", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k"), "bits")
    sizes = rows.groupBy(F.col("k").alias("k2")).agg(F.ceil(F.count("*") / F.lit(chunk_rows)).cast("int").alias("n"))
    chunks = rows.join(sizes, F.col("k") == F.col("k2")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    met = chunks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select("node", "bits", "chunk", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"), "k")
    met = met.withColumn("pair", F.concat_ws(":", "first", "second", "k"))

    def body(g: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"lo": [], "hi": []}, dtype="object"), *_near_in_chunks(g, limit)])

    return by_group(met, "pair", body, "lo string, hi string")


def greedy_dropped(pairs: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``node``: those dropped when nodes are taken in ascending order and each is dropped that pairs with an earlier kept one.

    A round keeps the nodes with no undecided earlier partner and drops their later partners; in hash order the rounds
    are logarithmic in number. More than ``most_rounds`` rounds raise.
    """
    left = cut_lineage(pairs.select("lo", "hi").distinct())
    parts = []
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        later = left.select(F.col("hi").alias("x")).distinct()
        dropped = cut_lineage(left.join(later, F.col("lo") == F.col("x"), "left_anti").select(F.col("hi").alias("node")).distinct())
        parts.append(dropped)
        for side in ("lo", "hi"):
            left = left.join(dropped, F.col(side) == F.col("node"), "left_anti")
        left = cut_lineage(left)
    else:
        raise RuntimeError(f"undecided pairs after {most_rounds} rounds")
    out = left.select(F.col("lo").alias("node"))
    for p in parts:
        out = out.unionByName(p)
    return out
