"""Queries of the general problems: hierarchies (2) and references (3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.hierarchy import descendant_pairs, parent_links, resolve_hierarchy
from quire.operators.references import find_orphans, orphan_report, parent_rows, reference_rows
from quire.sources.tables import table

QUERIES, SQL = {}, {}


def _tree(spark: SparkSession, d: str, paths: bool = True) -> tuple[DataFrame, DataFrame]:
    runs = table(spark, d, "page_cleaning_runs").select("page_cleaning_run_id", "supersedes_run_id", "loaded_at")
    links = parent_links(runs, "page_cleaning_run_id", "supersedes_run_id", ["loaded_at"])
    return links, resolve_hierarchy(links, paths=paths)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Root of every run that names a run it supersedes."""
    links, tree = _tree(spark, d, paths=False)
    lone = links.where("dangling").select(F.col("node_id").alias("lone_id"))  # roots all the same, though they name a run
    named = tree.join(lone, F.col("node_id") == F.col("lone_id"), "left").where(F.col("parent_id").isNotNull() | F.col("lone_id").isNotNull())
    return named.select(F.col("node_id").alias("page_cleaning_run_id"), F.col("root_id").alias("root_run_id"))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root, number of descendants and state of every run."""
    _, tree = _tree(spark, d)
    return tree.select(
        F.col("node_id").alias("page_cleaning_run_id"), F.col("root_id").alias("root_run_id"), "depth", F.array_join("path", ">").alias("path"), "n_descendants", "node_state"
    )


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every run below every run, with the distance; a cycle is one ancestor."""
    _, tree = _tree(spark, d)
    return descendant_pairs(tree).select(F.col("ancestor_id").alias("ancestor_run_id"), F.col("descendant_id").alias("descendant_run_id"), "distance")


_NODES = """
WITH RECURSIVE nodes AS (
  SELECT page_cleaning_run_id AS id, nullif(arg_max(coalesce(supersedes_run_id, ''), loaded_at), '') AS named
  FROM page_cleaning_runs WHERE page_cleaning_run_id IS NOT NULL GROUP BY 1
), linked AS (
  SELECT n.id, n.named, k.id AS up FROM nodes n LEFT JOIN nodes k ON n.named = k.id
), reach(id, cur) AS (
  SELECT id, up FROM linked WHERE up IS NOT NULL
  UNION
  SELECT r.id, l.up FROM reach r JOIN linked l ON r.cur = l.id WHERE l.up IS NOT NULL
), ring AS (
  SELECT id FROM reach WHERE id = cur
), reach0 AS (
  SELECT id, cur FROM reach UNION SELECT id, id FROM linked
), low AS (
  SELECT r.id, min(r.cur) AS low FROM reach0 r JOIN ring g ON r.cur = g.id GROUP BY 1
), top AS (
  SELECT r.id, r.cur AS top FROM reach0 r JOIN linked l ON r.cur = l.id WHERE l.up IS NULL
), rooted AS (
  SELECT l.id, l.named, coalesce('cycle:' || low.low, top.top) AS root
  FROM linked l LEFT JOIN low USING (id) LEFT JOIN top USING (id)
)"""
SQL["p2_found"] = _NODES + "\nSELECT id AS page_cleaning_run_id, root AS root_run_id FROM rooted WHERE named IS NOT NULL"
SQL["p2_hierarchy"] = (
    _NODES
    + """, cut AS (
  SELECT l.id, l.up, g.id IS NOT NULL AS on_cycle, CASE WHEN g.id IS NULL THEN l.up END AS above FROM linked l LEFT JOIN ring g ON l.id = g.id
), trail(id, cur, depth, path) AS (
  SELECT id, above, 0, id FROM cut
  UNION ALL
  SELECT t.id, c.above, t.depth + 1, c.id || '>' || t.path FROM trail t JOIN cut c ON t.cur = c.id
), whole AS (
  SELECT id, max(depth) AS depth, arg_max(path, depth) AS path FROM trail GROUP BY 1
), below AS (
  SELECT cur AS id, count(*) AS n FROM (SELECT DISTINCT id, cur FROM reach0) GROUP BY 1
), family AS (
  SELECT root, count(*) AS n FROM rooted GROUP BY 1
)
SELECT c.id AS page_cleaning_run_id, r.root AS root_run_id, CAST(w.depth AS INTEGER) AS depth, w.path, CASE WHEN c.on_cycle THEN f.n ELSE b.n END - 1 AS n_descendants,
  CASE WHEN c.on_cycle THEN 'cycle' WHEN r.root LIKE 'cycle:%' THEN 'into_cycle' WHEN c.up IS NULL THEN 'root' ELSE 'tree' END AS node_state
FROM cut c JOIN rooted r ON c.id = r.id JOIN whole w ON c.id = w.id JOIN below b ON c.id = b.id JOIN family f ON r.root = f.root"""
)
SQL["p2_descendants"] = (
    _NODES
    + """, cut AS (
  SELECT l.id, CASE WHEN g.id IS NULL THEN l.up END AS up FROM linked l LEFT JOIN ring g ON l.id = g.id
), steps(id, cur, distance) AS (
  SELECT id, up, 1 FROM cut WHERE up IS NOT NULL
  UNION ALL
  SELECT s.id, c.up, s.distance + 1 FROM steps s JOIN cut c ON s.cur = c.id WHERE c.up IS NOT NULL
)
SELECT coalesce('cycle:' || low.low, s.cur) AS ancestor_run_id, s.id AS descendant_run_id, s.distance
FROM steps s LEFT JOIN ring g ON s.cur = g.id LEFT JOIN low ON g.id = low.id
UNION ALL
SELECT 'cycle:' || low.low, g.id, 0 FROM ring g JOIN low ON g.id = low.id"""
)


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    checks = reference_rows(table(spark, d, "grouping_check_results"), "grouping_check_results", "check_result_id", "evidence_artifact_id", "completed_at")
    sets = reference_rows(
        table(spark, d, "accepted_detection_evidence_sets"), "accepted_detection_evidence_sets", "detection_dependency_id", "manifest_artifact_id", "created_at"
    )
    artifacts = table(spark, d, "processing_artifacts")
    parents = parent_rows(artifacts, "artifact_id", "storage_state", "created_at", "updated_at")
    refs = checks.unionByName(sets)
    return refs, find_orphans(refs, parents, n_parents=artifacts.count())  # rows, which the files' footers tell


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference without a usable artifact, with its kind."""
    return _references(spark, d)[1].select("ref_table", "period", "record_id", "orphan_kind").distinct()


def p3_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans by table and month."""
    return orphan_report(*_references(spark, d))


_ORPHANS = """
WITH refs AS (
  SELECT DISTINCT 'grouping_check_results' AS ref_table, check_result_id AS record_id, evidence_artifact_id AS k, completed_at AS t FROM grouping_check_results WHERE evidence_artifact_id <> ''
  UNION ALL
  SELECT DISTINCT 'accepted_detection_evidence_sets', detection_dependency_id, manifest_artifact_id, created_at FROM accepted_detection_evidence_sets WHERE manifest_artifact_id <> ''
), arts AS (
  SELECT artifact_id, arg_max(storage_state, updated_at) AS state, min(created_at) AS born FROM processing_artifacts GROUP BY 1
), judged AS (
  SELECT ref_table, record_id, strftime(t, '%Y-%m') AS period,
    CASE WHEN a.artifact_id IS NULL THEN 'missing' WHEN a.state = 'deleted' THEN 'deleted' WHEN a.born > r.t THEN 'late' END AS orphan_kind
  FROM refs r LEFT JOIN arts a ON r.k = a.artifact_id
)"""
SQL["p3_found"] = _ORPHANS + "\nSELECT DISTINCT ref_table, period, record_id, orphan_kind FROM judged WHERE orphan_kind IS NOT NULL"
SQL["p3_orphan_report"] = (
    _ORPHANS
    + """
SELECT ref_table, period, count(DISTINCT record_id) AS n_references, count(CASE WHEN orphan_kind = 'missing' THEN 1 END) AS n_missing,
  count(CASE WHEN orphan_kind = 'deleted' THEN 1 END) AS n_deleted, count(CASE WHEN orphan_kind = 'late' THEN 1 END) AS n_late
FROM judged GROUP BY ALL"""
)

QUERIES |= {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p3_found, p3_orphan_report)}
