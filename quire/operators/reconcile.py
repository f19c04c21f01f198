"""Integrity: sets against sets, references, duplicates, covers, fingerprints and findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys with ``status`` missing (expected only), extra (actual only) or matched; null keys match null ones.

    One aggregation of the tagged union instead of a join of the two sides.
    """
    tagged = expected.select(*keys, F.lit(1).alias("side")).unionByName(actual.select(*keys, F.lit(2).alias("side")))
    sides = tagged.groupBy(*keys).agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return sides.select(*keys, F.when(F.col("hi") == 1, "missing").when(F.col("lo") == 2, "extra").otherwise("matched").alias("status"))


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def dangling(rows: DataFrame, reference: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose non-null reference has no target."""
    known = targets.select(F.col(target).alias("known_target"))
    return rows.where(F.col(reference).isNotNull()).join(known, F.col(reference) == F.col("known_target"), "left_anti")


def exact_cover(items: DataFrame, assignments: DataFrame, item: str, assigned: str) -> DataFrame:
    """Per item ``n_assigned`` and ``cover``: once, missing or repeated; assignments of no item come as ``foreign``."""
    counts = assignments.groupBy(F.col(assigned).alias("assigned_item")).agg(F.count("*").alias("n"))
    joined = items.select(item).distinct().join(counts, F.col(item) == F.col("assigned_item"), "full_outer")
    n = F.coalesce("n", F.lit(0))
    cover = F.when(F.col(item).isNull(), "foreign").when(n == 0, "missing").when(n == 1, "once").otherwise("repeated")
    return joined.select(F.coalesce(item, "assigned_item").alias(item), n.alias("n_assigned"), cover.alias("cover"))


def findings(rules: Sequence[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """Rows ``rule_id, severity, affected_id, finding_id`` of rules ``(rule, severity, violations, affected id)``, without repeats."""
    parts = [v.select(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), i.cast("string").alias("affected_id")) for r, s, v, i in rules]
    whole = reduce(DataFrame.unionByName, parts).distinct()
    return whole.withColumn("finding_id", F.sha2(F.concat_ws("|", "rule_id", "affected_id"), 256))


def group_fingerprint(rows: DataFrame, keys: Sequence[str], line: Column, words: int = 4) -> DataFrame:
    """A sha256 per key over the multiset of the key's lines, whatever their order.

    Lines are hashed and ``words`` 32-bit words of the hashes summed, so partial sums combine and no group is gathered.
    """
    hashed = rows.select(*keys, F.sha2(line, 256).alias("leaf"))
    sums = [F.sum(F.conv(F.substring("leaf", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(words)]
    return hashed.groupBy(*keys).agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("fingerprint"))


def disposition_findings(rows: DataFrame, disposition: str, unresolved: Column, unproven: Column, evidence: Column) -> DataFrame:
    """Rows with ``finding``, null where a result's disposition fits its state.

    ``PRODUCED`` may leave nothing unresolved or without provenance, ``INCOMPLETE`` needs something unresolved with evidence
    for it, and there is no other disposition. Null conditions do not hold.
    """
    holds = lambda c: F.coalesce(c, F.lit(False))
    d = F.col(disposition)
    finding = (
        F.when(~holds(d.isin("PRODUCED", "INCOMPLETE")), "invalid_disposition")
        .when((d == "PRODUCED") & (holds(unresolved) | holds(unproven)), "produced_with_unresolved_blocker")
        .when((d == "INCOMPLETE") & ~(holds(unresolved) & holds(evidence)), "incomplete_without_evidence")
    )
    return rows.withColumn("finding", finding)


def fingerprint_drift(rows: DataFrame, key: str, fields: Sequence[str], at: str) -> DataFrame:
    """Per key the fingerprint of its first delivery, deliveries, and how many of them give another one when it is computed again."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in fields])
    hashed = rows.select(F.col(key).alias(key), F.sha2(text, 256).alias("print"), F.struct(F.col(at).alias("t"), F.sha2(text, 256).alias("p")).alias("order"))
    first = hashed.groupBy(F.col(key).alias("of")).agg(F.min("order")["p"].alias("stored"))
    joined = hashed.join(first, F.col(key) == F.col("of"))
    return joined.groupBy(key, "stored").agg(F.count("*").alias("n_deliveries"), F.count_if(F.col("print") != F.col("stored")).alias("n_drifted"))
