"""Percentiles of very large numeric columns with a known rank error, from summaries that merge.

A summary is a sorted list of tuples (value, lowest rank, highest rank) after Greenwald and Khanna. Every partition
summarises its own rows of a group, so no group ever gathers in one task; summaries are merged with a fixed fan-in,
level by level, adding the neighbours' ranks, and compressed to ``size`` tuples after each merge. Everything is
deterministic, and the error that the rank intervals really leave is part of every result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import parallelism, shipped

FAN_IN = 64
ERROR = 0.001
CHUNK_ROWS = 4_000_000
#: Tuples that a task holds before it writes what it has (24 bytes each).
HELD_TUPLES = 6_000_000
BODY = "n long, values array<double>, low array<long>, high array<long>"


def summary_size(levels: int, error: float) -> int:
    """Tuples that keep the rank error within ``error`` of n after the first selection and ``levels`` compressions."""
    return int(np.ceil((levels + 1) / error)) + 1


def summarise(values: np.ndarray, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Summary of sorted values: all of them, or ``size`` at even ranks with both ends; ranks are exact."""
    n = len(values)
    ranks = np.arange(1, n + 1) if n <= size else np.unique(np.ceil(np.linspace(1, n, size)).astype("int64"))
    return n, values[ranks - 1].astype("float64"), ranks.astype("int64"), ranks.astype("int64")


def _gain(values: np.ndarray, side: str, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """What another summary adds to the lowest and highest rank of ``values``; ``side`` puts ties after or before it."""
    n, theirs, low, high = other
    at = np.searchsorted(theirs, values, side)
    lowest = np.where(at > 0, low[np.maximum(at - 1, 0)], 0)
    highest = np.where(at < len(theirs), high[np.minimum(at, len(theirs) - 1)] - 1, n)
    return lowest, highest


def merge(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """One summary of two; its rank gaps are at most the sum of theirs."""
    if a[0] == 0 or b[0] == 0:
        return a if b[0] == 0 else b
    low_a, high_a = _gain(a[1], "left", b)
    low_b, high_b = _gain(b[1], "right", a)
    values = np.concatenate([a[1], b[1]])
    order = np.argsort(values, kind="stable")
    low = np.concatenate([a[2] + low_a, b[2] + low_b])[order]
    high = np.concatenate([a[3] + high_a, b[3] + high_b])[order]
    return a[0] + b[0], values[order], low, high


def compress(s: tuple, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """At most ``size`` tuples of a summary: those nearest to even ranks, both ends among them."""
    n, values, low, high = s
    if len(values) <= size:
        return s
    middle = np.maximum.accumulate((low + high) / 2)
    wanted = np.linspace(1, n, size)
    right = np.clip(np.searchsorted(middle, wanted), 1, len(values) - 1)
    nearest = np.where(wanted - middle[right - 1] <= middle[right] - wanted, right - 1, right)
    keep = np.unique(np.concatenate([[0], nearest, [len(values) - 1]]))
    return n, values[keep], low[keep], high[keep]


def rank_error(s: tuple) -> float:
    """Ranks by which an answer can be off: half the widest gap between the intervals of neighbours, none between exact neighbours."""
    _, _, low, high = s
    if not len(low):
        return 0.0
    gaps = np.concatenate([high[1:] - low[:-1], [1]])
    return float(max(np.max(np.where(gaps > 1, gaps / 2, 0)), np.max((high - low) / 2)))


def answer(s: tuple, share: float) -> float | None:
    """The value whose rank interval lies nearest to rank ceil(share * n)."""
    n, values, low, high = s
    if not n:
        return None
    rank = max(1, int(np.ceil(share * n)))
    return float(values[np.argmin(np.maximum(rank - low, high - rank))])


def _merged(parts: list[tuple], size: int) -> tuple:
    while len(parts) > 1:  # as a tree, so that every tuple moves log(parts) times
        parts = [merge(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return compress(parts[0], size)


class Pile:
    """Summaries of one key as they arrive: as soon as ``fan_in`` of a level are there they become one of the next level,
    so that few are held however many come, and a value is compressed once a level."""

    def __init__(self, size: int, fan_in: int = FAN_IN) -> None:
        self.size, self.fan_in, self.levels = size, fan_in, [[]]

    def add(self, s: tuple) -> int:
        """Put a summary on the pile; by how many tuples it grew."""
        grown, level = len(s[1]), 0
        self.levels[0].append(s)
        while len(self.levels[level]) >= self.fan_in:
            full = self.levels[level]
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            one = _merged(full, self.size)
            self.levels[level + 1].append(one)
            grown += len(one[1]) - sum(len(x[1]) for x in full)
            level += 1
        return grown

    def held(self) -> int:
        """Summaries on the pile."""
        return sum(map(len, self.levels))

    def whole(self) -> tuple:
        """One summary of all."""
        return _merged([x for level in self.levels for x in level], self.size)


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _body(batch: pa.RecordBatch) -> list[tuple]:
    """Summaries of a batch's rows, as views of its buffers."""
    lists = [batch.column(c) for c in ("values", "low", "high")]
    flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
    ends = [x.offsets.to_numpy() for x in lists]
    return [(n, *[f[e[i] : e[i + 1]] for f, e in zip(flat, ends)]) for i, n in enumerate(batch.column("n").to_pylist())]


def _rows(keys: list[list], kinds: list[pa.DataType], summaries: list[tuple], names: list[str]) -> pa.RecordBatch:
    """A batch of summaries with their key columns."""
    columns = [pa.array(k, kind) for k, kind in zip(keys, kinds)]
    columns.append(pa.array([s[0] for s in summaries], pa.int64()))
    ends = np.concatenate([[0], np.cumsum([len(s[1]) for s in summaries])]).astype("int32")
    for i, kind in ((1, "float64"), (2, "int64"), (3, "int64")):
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s[i] for s in summaries]).astype(kind))))
    return pa.RecordBatch.from_arrays(columns, names)


def merge_groups(parts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """One summary per key of rows ``keys + BODY``.

    Rows are placed and sorted by key and merged as they stream past, so small groups cost no call of their own and a key
    with many summaries holds fewer than ``FAN_IN`` a level.
    """
    names = [*keys, "n", "values", "low", "high"]

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pile, done_keys, done = None, None, [], []
        kinds: list[pa.DataType] = []

        def out() -> pa.RecordBatch:
            return _rows([list(c) for c in zip(*done_keys)], kinds, done, names)

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for key, s in zip(zip(*[batch.column(k).to_pylist() for k in keys]), _body(batch)):
                if key != now and pile is not None:
                    done_keys.append(now)
                    done.append(pile.whole())
                    pile = None
                if pile is None:
                    now, pile = key, Pile(size)
                pile.add(tuple(x if i == 0 else x.copy() for i, x in enumerate(s)))  # views would keep whole batches
            if len(done) > 200:
                yield out()
                done_keys, done = [], []
        if pile is not None:
            done_keys.append(now)
            done.append(pile.whole())
        if done:
            yield out()

    placed = parts.select(*names).repartition(*keys).sortWithinPartitions(*keys)
    return shipped(placed).mapInArrow(partition, f"{_key_schema(parts, keys)}, {BODY}")


def merge_levels(parts: DataFrame, keys: list[str], slot: str, slots: int, size: int, fan_in: int = FAN_IN) -> DataFrame:
    """Hierarchical merge of rows ``keys + slot + BODY`` with slot numbers below ``slots``: at most ``fan_in`` slots meet in a task."""
    while slots > 1:
        slots = -(-slots // fan_in)
        moved = parts.withColumn(slot, F.pmod(F.col(slot), F.lit(slots)).cast("int"))
        parts = merge_groups(moved, [*keys, slot], size)
    return parts.drop(slot)


def levels_of(slots: int, fan_in: int = FAN_IN) -> int:
    """How many merge levels ``merge_levels`` takes."""
    levels = 0
    while slots > 1:
        slots, levels = -(-slots // fan_in), levels + 1
    return levels


def summarise_groups(rows: DataFrame, keys: list[str], value: str, size: int, slots: int, chunk_rows: int = CHUNK_ROWS, held_tuples: int = HELD_TUPLES) -> DataFrame:
    """Summaries of each partition's rows by key: ``keys, slot, BODY``. Null values are left out; nan counts as null.

    Rows are summarised ``chunk_rows`` at a time and a key's summaries merged within the task, so a task gives one a key,
    however many rows it reads; only keys so many that their summaries exceed ``held_tuples`` are given more often.
    """
    schema = f"{_key_schema(rows, keys)}, slot int, {BODY}"
    narrow = rows.select(*keys, F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    names = [*keys, "slot", "n", "values", "low", "high"]

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, count = TaskContext.get().partitionId() % slots, [], 0
        piles: dict[tuple, Pile] = {}
        kinds: list[pa.DataType] = []
        tuples = 0

        def digest() -> None:
            nonlocal kinds, tuples
            rows = pa.Table.from_batches(held).combine_chunks()
            code, coded = np.zeros(rows.num_rows, "int64"), []
            for k in keys:
                column = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
                column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
                code = np.unique(code * len(column.dictionary) + column.indices.to_numpy(), return_inverse=True)[1]  # stays below the rows
                coded.append(column)
            values = rows.column("value").to_numpy()
            order = np.lexsort((values, code))
            starts = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
            firsts = pa.array(order[starts])
            kinds = [c.type.value_type for c in coded]
            found = zip(*[c.take(firsts).cast(kind).to_pylist() for c, kind in zip(coded, kinds)]) if keys else [()]
            for key, i, j in zip(found, starts, [*starts[1:], len(order)]):
                tuples += piles.setdefault(key, Pile(size)).add(summarise(values[order[i:j]], size))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal tuples
            every = list(piles.items())
            piles.clear()
            tuples = 0
            for lo in range(0, len(every), 200):
                part = every[lo : lo + 200]
                columns = [list(c) for c in zip(*[k for k, _ in part])] if keys else []
                yield _rows([*columns, [slot] * len(part)], [*kinds, pa.int32()], [p.whole() for _, p in part], names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= chunk_rows:
                digest()
                held, count = [], 0
                if tuples > held_tuples:
                    yield from flush()
        if held:
            digest()
        if piles:
            yield from flush()

    return shipped(narrow).mapInArrow(partition, schema)


def percentile_rows(summaries: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """``keys, n``, one column per share and ``rank_error``, the ranks by which each of them can be off."""
    columns = [*keys, "n", *shares, "rank_error"]
    schema = f"{_key_schema(summaries, keys)}, n long, {', '.join(f'{c} double' for c in shares)}, rank_error double"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = _body(batch)
            answers = [pa.array([answer(s, q) for s in body], pa.float64()) for q in shares.values()]
            errors = pa.array([rank_error(s) for s in body], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("n"), *answers, errors], columns)

    return shipped(summaries).mapInArrow(ask, schema)


def group_summaries(rows: DataFrame, keys: list[str], value: str, error: float = ERROR, spare_levels: int = 2) -> DataFrame:
    """One summary per key with a rank error of at most ``error * n``, also after ``spare_levels`` more merges of whole summaries.

    Groups of any size and skew: what a task holds of a key is fewer than ``FAN_IN`` summaries a level, whatever the number
    of partitions. Slots are as many as the session's shuffle partitions; where a table has more partitions, a slot's
    summaries stream into one. Null keys are a group of their own. An empty table gives no rows. Extra columns, whatever
    their names, are not read; key columns may not be named as the columns of a summary are.
    """
    slots = parallelism(rows.sparkSession)
    size = size_for(slots, error, spare_levels)
    return merge_levels(summarise_groups(rows, keys, value, size, slots), keys, "slot", slots, size)


def size_for(slots: int, error: float = ERROR, spare_levels: int = 2) -> int:
    """Tuples of a summary for ``group_summaries``: levels between slots, one within tasks, and the spare ones."""
    return summary_size(levels_of(slots) + 1 + spare_levels, error)
