"""Versioned ledgers: pointers, versions, batches of commands and what they leave behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.sequence import HOT_ROWS, hot_keys, running_sum, with_previous


def _side(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Key columns renamed, so that joins never meet a clashing name."""
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by ``order``; null keys form a group, ties are settled by listing more columns.

    One shuffle with map-side combination, where a window would move and sort every row.
    """
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in others])


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is first by ``order``."""
    others = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in others])


def pointer_join(owners: DataFrame, versions: DataFrame, pointers: dict[str, str], prefix: str) -> DataFrame:
    """Owners with the version their pointers name (``pointers``: owner column -> version column), null where there is none."""
    right = versions.withColumnsRenamed({c: f"{prefix}{c}" for c in versions.columns})
    condition = [F.col(a) == F.col(f"{prefix}{b}") for a, b in pointers.items()]
    return owners.join(right, condition, "left")


def next_versions(owners: DataFrame, versions: DataFrame, key: str, version: Column) -> DataFrame:
    """``key, next_version``: one past the greatest version of every owner, 1 for those without."""
    last = versions.groupBy(F.col(key).alias("versioned")).agg(F.max(version).alias("last"))
    joined = owners.select(key).distinct().join(last, F.col(key) == F.col("versioned"), "left")
    return joined.select(key, (F.coalesce("last", F.lit(0)) + 1).alias("next_version"))


def counted(owners: DataFrame, children: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Owners with the number of their children under ``name``."""
    n = children.groupBy(F.col(parent).alias("counted_parent")).agg(F.count("*").alias("counted_n"))
    return owners.join(n, F.col(key) == F.col("counted_parent"), "left").select(*owners.columns, F.coalesce("counted_n", F.lit(0)).alias(name))


def all_or_nothing(rows: DataFrame, parent: str, passes: Column) -> DataFrame:
    """Parents all of whose rows pass (a null counts as failing), with their number of rows."""
    return rows.groupBy(parent).agg(F.count("*").alias("n_rows"), F.bool_and(F.coalesce(passes, F.lit(False))).alias("ok")).where("ok").drop("ok")


def compare_and_set(commands: DataFrame, state: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """Commands with a verdict: ``accepted`` where the state is as expected (null-safe), else ``conflict``; ``unknown`` keys apart."""
    held = state.select(F.col(key).alias("held_key"), F.col(actual).alias("held_value"))
    joined = commands.join(held, F.col(key) == F.col("held_key"), "left")
    verdict = F.when(F.col("held_key").isNull(), "unknown").when(F.col(expected).eqNullSafe(F.col("held_value")), "accepted").otherwise("conflict")
    return joined.select(*commands.columns, verdict.alias("verdict"))


def upsert_latest(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Base rows replaced or joined by the last change of each key; base rows count as older than every change."""
    tagged = base.withColumn("is_change", F.lit(0)).unionByName(changes.withColumn("is_change", F.lit(1)))
    return latest_per_key(tagged, keys, ["is_change", order]).drop("is_change")


def insert_or_verify(base: DataFrame, incoming: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """``key, outcome`` of incoming rows: ``inserted``, ``same`` or ``mismatch`` against the stored payload."""
    held = base.select(F.col(key).alias("held_key"), *[F.col(c).alias(f"held_{c}") for c in payload])
    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"held_{c}"))
    joined = incoming.select(key, *payload).distinct().join(held, F.col(key) == F.col("held_key"), "left")
    return joined.select(key, F.when(F.col("held_key").isNull(), "inserted").when(same, "same").otherwise("mismatch").alias("outcome"))


def idempotent_replay(log: DataFrame, key: str, payload: Column, order: Sequence[str]) -> DataFrame:
    """Per key: the first payload, how often it came, and whether another payload came under the same key."""
    return log.groupBy(key).agg(
        F.min_by(payload, F.struct(*order)).alias("first_payload"), F.count("*").alias("n_deliveries"), (F.min(payload) != F.max(payload)).alias("conflicting")
    )


def current_facts(facts: DataFrame, fact: str, supersedes: str) -> DataFrame:
    """Facts that no other fact supersedes."""
    gone = facts.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("superseded"))
    return facts.join(gone, F.col(fact) == F.col("superseded"), "left_anti")


def stale_dependents(current: DataFrame, recorded: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, status``: ``current`` where the recorded digest is still that of the source, else ``stale`` or ``gone``."""
    now = current.select(F.col(key).alias("now_key"), F.col(digest).alias("now_digest"))
    joined = recorded.join(now, F.col(key) == F.col("now_key"), "left")
    return joined.select(key, F.when(F.col("now_key").isNull(), "gone").when(F.col(digest).eqNullSafe(F.col("now_digest")), "current").otherwise("stale").alias("status"))


def unseen(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key hasn't been done: what a resumed run still has to do."""
    known = _side(done.select(*keys), keys, "done_")
    return rows.join(known, [F.col(k) == F.col(f"done_{k}") for k in keys], "left_anti")


def transitions(events: DataFrame, key: str, state: str, order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events with the state before them as ``previous``, null for the first."""
    looked = with_previous(events, key, order, [state], hot_keys(events, key, hot_rows))
    return looked.withColumn("previous", F.col("before")[state]).drop("before")


def bad_transitions(events: DataFrame, key: str, state: str, order: Sequence[str], allowed: DataFrame) -> DataFrame:
    """Transitions not among ``allowed(from_state, to_state)``, a set of states squared in size."""
    return transitions(events, key, state, order).where(F.col("previous").isNotNull()).join(
        F.broadcast(allowed), (F.col("previous") == F.col("from_state")) & (F.col(state) == F.col("to_state")), "left_anti"
    )


def attempts(rows: DataFrame, key: str, order: Sequence[str], budget: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with their attempt number and whether it is past the budget."""
    numbered = running_sum(rows, key, order, F.lit(1), "attempt_number", hot_keys(rows, key, hot_rows))
    return numbered.withColumn("over_budget", F.col("attempt_number") > budget)
