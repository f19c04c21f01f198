"""References to records that are missing, deleted or arrive later.

Keys are range-partitioned in the order of a 64-bit hash (so ranges hold equal shares of distinct keys whatever the keys
look like), the parents of a range become sorted arrays, and references stream past them in Arrow batches that are
probed by binary search. Equal hashes are told apart by the keys themselves. A range with more references than its share
(a hot key) is split by salt, its parents repeated for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import parallelism, shipped

PARENTS_PER_RANGE = 200_000
MAX_RANGES = 100_000
REFS_PER_TASK = 2_000_000
NO_TIME = -(2**63)
MISS_SCHEMA = "ref_table string, record_id string, ref_key string, period string, orphan_kind string"


def reference_rows(rows: DataFrame, ref_table: str, record: str, key: str, at: str) -> DataFrame:
    """References in one shape. Null and empty keys are no references."""
    return rows.where((F.col(key) != "") & F.col(record).isNotNull()).select(
        F.lit(ref_table).alias("ref_table"), F.col(record).cast("string").alias("record_id"), F.col(key).alias("ref_key"), F.col(at).alias("at")
    )


def parent_rows(rows: DataFrame, key: str, state: str, created: str, updated: str) -> DataFrame:
    """The latest state and first creation of each parent key; ties of ``updated`` go to the larger state, null is earliest."""
    latest = F.max(F.struct(F.col(updated).alias("u"), F.col(state).alias("s")))["s"]
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("ref_key")).agg(latest.alias("state"), F.min(created).alias("created"))


class _Range:
    """Sorted parent arrays of one range."""

    def __init__(self) -> None:
        self.parts: list[pd.DataFrame] = []
        self.hashes: np.ndarray | None = None

    def add(self, part: pd.DataFrame) -> None:
        self.parts.append(part)

    def close(self) -> None:
        if self.hashes is not None:
            return
        whole = pd.concat(self.parts, ignore_index=True) if self.parts else pd.DataFrame({"kh": [], "ref_key": [], "gone": [], "moment": []})
        order = np.argsort(whole["kh"].to_numpy("int64"), kind="stable")
        self.hashes = whole["kh"].to_numpy("int64")[order]
        self.keys = whole["ref_key"].to_numpy(object)[order]
        self.gone = whole["gone"].to_numpy(bool)[order]
        self.born = whole["moment"].to_numpy("int64")[order]

    def probe(self, refs: pd.DataFrame) -> pd.DataFrame:
        self.close()
        kh, keys, moment = refs["kh"].to_numpy("int64"), refs["ref_key"].to_numpy(object), refs["moment"].to_numpy("int64")
        n = len(self.hashes)
        found = np.searchsorted(self.hashes, kh, "left")
        clipped = np.minimum(found, max(n - 1, 0))
        same = (found < n) & (self.hashes[clipped] == kh) if n else np.zeros(len(kh), bool)
        hit = same.copy()
        hit[same] = self.keys[clipped[same]] == keys[same]
        for i in np.flatnonzero(same & ~hit):  # two keys of one hash lie side by side
            j = found[i] + 1
            while j < n and self.hashes[j] == kh[i]:
                if self.keys[j] == keys[i]:
                    hit[i], clipped[i] = True, j
                    break
                j += 1
        kind = np.full(len(kh), "missing", object)
        at = clipped[hit]
        late = (self.born[at] != NO_TIME) & (moment[hit] != NO_TIME) & (self.born[at] > moment[hit])
        kind[hit] = np.where(self.gone[at], "deleted", np.where(late, "late", None))
        bad = np.array([k is not None for k in kind], bool)
        out = refs.loc[bad, ["ref_table", "record_id", "ref_key", "period"]].copy()
        out["orphan_kind"] = kind[bad]
        return out


def _probe_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    place, current = None, _Range()
    for batch in batches:
        if batch.empty:
            continue
        ranges, salts = batch["range_id"].to_numpy(), batch["salt"].to_numpy()
        edges = np.flatnonzero((ranges[1:] != ranges[:-1]) | (salts[1:] != salts[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, len(batch)]):
            run = batch.iloc[lo:hi]
            if (ranges[lo], salts[lo]) != place:
                place, current = (ranges[lo], salts[lo]), _Range()
            is_ref = run["is_ref"].to_numpy(bool)
            if not is_ref.all():
                current.add(run.loc[~is_ref, ["kh", "ref_key", "gone", "moment"]])
            if is_ref.any():
                yield current.probe(run[is_ref])


def find_orphans(
    refs: DataFrame,
    parents: DataFrame,
    gone_states: tuple[str, ...] = ("deleted",),
    parents_per_range: int = PARENTS_PER_RANGE,
    refs_per_task: int = REFS_PER_TASK,
    n_parents: int | None = None,
) -> DataFrame:
    """Distinct bad references (``MISS_SCHEMA``): ``missing``, else ``deleted``, else ``late`` (parent created after the reference).

    ``refs`` as from ``reference_rows``, ``parents`` as from ``parent_rows``. A reference or parent without a time is never
    late. ``n_parents``, a bound on the number of parents that the caller knows cheaply, saves counting them. ``period`` is the month of the reference, null without a time. Empty tables: no parents makes every reference
    missing, no references gives no rows.
    """
    spark = refs.sparkSession
    n_parents = parents.count() if n_parents is None else n_parents
    n_ranges = min(MAX_RANGES, max(parallelism(spark), -(-n_parents // parents_per_range)))
    hashed = F.xxhash64("ref_key")
    range_of = F.shiftright(F.shiftrightunsigned("kh", 33) * F.lit(n_ranges), 31).cast("int")
    micros = F.coalesce(F.unix_micros(F.col("at").cast("timestamp_ltz")), F.lit(NO_TIME))
    ref = refs.withColumn("kh", hashed).select(
        range_of.alias("range_id"), F.lit(True).alias("is_ref"), "kh", "ref_key", F.lit(False).alias("gone"), micros.alias("moment"),
        "ref_table", "record_id", F.date_format("at", "yyyy-MM").alias("period"),
    )
    held = parents.withColumn("kh", hashed).withColumn("at", F.col("created")).select(
        range_of.alias("range_id"), F.lit(False).alias("is_ref"), "kh", "ref_key", F.coalesce(F.col("state").isin(*gone_states), F.lit(False)).alias("gone"),
        micros.alias("moment"), F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("string").alias("record_id"), F.lit(None).cast("string").alias("period"),
    )
    crowded = ref.groupBy("range_id").count().where(F.col("count") > refs_per_task).collect()  # at most one row a range, and ranges are bounded
    if crowded:
        parts = F.broadcast(spark.createDataFrame([(r["range_id"], -(-r["count"] // refs_per_task)) for r in crowded], "range_id int, parts int"))
        ref = ref.join(parts, "range_id", "left").withColumn("salt", F.expr("cast(pmod(xxhash64(record_id), coalesce(parts, 1)) as int)")).drop("parts")
        held = held.join(parts, "range_id", "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")
    else:
        ref, held = ref.withColumn("salt", F.lit(0)), held.withColumn("salt", F.lit(0))
    placed = held.unionByName(ref).repartition(n_ranges, "range_id", "salt").sortWithinPartitions("range_id", "salt", "is_ref")
    return shipped(placed).mapInPandas(_probe_partition, MISS_SCHEMA).distinct()


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per table and month: distinct references and orphans of each kind, months without orphans included."""
    total = refs.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("period")).agg(F.countDistinct("record_id").alias("n_references"))
    kinds = [F.count_if(F.col("orphan_kind") == k).alias(f"n_{k}") for k in ("missing", "deleted", "late")]
    bad = orphans.groupBy("ref_table", "period").agg(*kinds).withColumnsRenamed({"ref_table": "t", "period": "p"})
    joined = total.join(bad, (F.col("ref_table") == F.col("t")) & F.col("period").eqNullSafe(F.col("p")), "left")
    return joined.select("ref_table", "period", "n_references", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("missing", "deleted", "late")])
