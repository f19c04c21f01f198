"""Deterministic selection: stable hash order, round robin, quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(key: Column, seed: str) -> Column:
    """A stable pseudo-random order."""
    return F.sha2(F.concat(key.cast("string"), F.lit(f":{seed}")), 256)


def hash_order_sample(rows: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """The first ``n`` rows of each group in stable hash order, with their place. Only ``n`` a group and task are shuffled."""
    order = Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), key)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def round_robin(rows: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows, one of each group in turn, groups in their order; each group gives its rows in stable hash order."""
    taken = hash_order_sample(rows, group, key, n, seed).withColumnRenamed("place", "turn")
    return taken.orderBy("turn", group).limit(n)


def quota_waterfall(rows: DataFrame, key: str, buckets: Sequence[tuple[str, Column, int]], seed: str) -> DataFrame:
    """``key, bucket``: each bucket takes its quota of the rows that fit it and that no earlier bucket took, in stable hash order.

    A bucket can only be short of rows that earlier ones took, so the candidates kept per bucket are its quota and those
    before it: a bounded list, from which the buckets draw in turn.
    """
    total = 0
    parts: list[DataFrame] = []
    for i, (name, fits, quota) in enumerate(buckets):
        total += quota
        candidates = rows.where(fits).select(F.col(key), hash_order(F.col(key), seed).alias("h")).distinct().orderBy("h", key).limit(total)
        parts.append(candidates.select(key, "h", F.lit(i).alias("i")))
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    taken: set = set()
    out = []
    held = pool.orderBy("i", "h", key).collect()  # bounded by the quotas
    for i, (name, _, quota) in enumerate(buckets):
        own = [r[key] for r in held if r["i"] == i and r[key] not in taken][:quota]
        taken.update(own)
        out += [(k, name) for k in own]
    return rows.sparkSession.createDataFrame(out, f"`{key}` {rows.schema[key].dataType.simpleString()}, bucket string")


def dominant_and_median(rows: DataFrame, group: str, key: str, size: str) -> DataFrame:
    """Per group the largest row and, of the others, the one nearest to the group's median size; ties go to the smaller key."""
    middle = rows.groupBy(F.col(group).alias("g")).agg(F.percentile(size, 0.5).alias("median"), F.max_by(key, F.struct(F.col(size), -F.col(key))).alias("dominant"))
    joined = rows.join(middle, F.col(group) == F.col("g"))
    others = joined.where(F.col(key) != F.col("dominant"))
    near = others.groupBy(F.col(group).alias("g2")).agg(F.min_by(key, F.struct(F.abs(F.col(size) - F.col("median")), F.col(key))).alias("near_median"))
    return middle.join(near, F.col("g") == F.col("g2"), "left").select(F.col("g").alias(group), "dominant", "near_median")
