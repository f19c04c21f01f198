"""Queries over texts, JSON and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import exprs, geometry, text
from quire.operators import reconcile
from quire.plans.registry import Registry
from quire.sources.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("SELECT DISTINCT fragment_id, regexp_replace(ocr_text, '[\\s\\x{3000}\\x{00a0}]+', '', 'g') AS normalized FROM fragments WHERE ocr_text IS NOT NULL")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fragments").where("ocr_text is not null").select("fragment_id", text.without_blanks(F.col("ocr_text")).alias("normalized")).distinct()


def error_rates(fragments: DataFrame, regions: DataFrame) -> DataFrame:
    """``fragment_id, cer`` of every reading of a page against the page's first region with an expected text.

    Lengths and distances count code points. A reading without text counts as empty; pages without an expected text give
    no rows; rows delivered again count once.
    """
    first = F.min(F.struct("region_id", "expected"))
    expected = regions.where(F.col("expected").isNotNull()).groupBy(F.col("asset_id").alias("page")).agg(first["expected"].alias("expected"))
    reads = fragments.select("fragment_id", "asset_id", "ocr_text").distinct()
    return reads.join(expected, F.col("asset_id") == F.col("page")).select("fragment_id", F.round(text.error_rate(F.col("expected"), F.col("ocr_text")), 6).alias("cer")).distinct()


# DuckDB's distance counts bytes, so the SQL first writes the characters of each pair of texts as one byte each.
@R.query("""WITH r AS (SELECT asset_id, arg_min(expected, region_id) AS e FROM evaluation_regions WHERE expected IS NOT NULL GROUP BY 1),
p AS (SELECT DISTINCT fragment_id, e, coalesce(ocr_text, '') AS t, list_sort(list_distinct(string_split(e || coalesce(ocr_text, ''), ''))) AS u FROM fragments f JOIN r ON f.asset_id = r.asset_id),
b AS (SELECT fragment_id, length(e) AS n, length(t) AS m, translate(e, array_to_string(u, ''), c) AS e, translate(t, array_to_string(u, ''), c) AS t
  FROM (SELECT *, array_to_string(list_transform(range(1, len(u) + 1), lambda i: chr(CASE WHEN i < 127 THEN i ELSE error('too many characters') END)), '') AS c FROM p))
SELECT DISTINCT fragment_id, round(CASE WHEN n = 0 THEN CASE WHEN m = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(e, t)::DOUBLE / n END, 6) AS cer FROM b""".replace("chr(CASE WHEN i < 127 THEN i ELSE error('too many characters') END)", "chr(CASE WHEN i < 127 THEN i::INTEGER ELSE error('too many characters')::INTEGER END)"))
def cer(spark: SparkSession, d: str) -> DataFrame:
    """Character error rate of every reading against its page's first region, in every script."""
    return error_rates(table(spark, d, "fragments"), table(spark, d, "evaluation_regions"))


@R.query("""SELECT DISTINCT translation_id, CASE WHEN regexp_matches(content, '^\\s*```(json)?\\s*(.*?)\\s*```\\s*$', 'si') THEN length(regexp_extract(content, '^\\s*```(json)?\\s*(.*?)\\s*```\\s*$', 2, 'si')) ELSE length(content) END AS n_inside FROM translations""")
def fence_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations").select("translation_id", F.length(text.unfenced(F.col("content"))).alias("n_inside")).distinct()


@R.query("""SELECT DISTINCT translation_id, round(len(list_intersect(list_distinct(string_split(source_text, '')), list_distinct(string_split(translation_text, ''))))::DOUBLE / nullif(len(list_distinct(string_split(source_text, ''))), 0), 6) AS overlap
FROM translations WHERE translation_text IS NOT NULL""")
def charset_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translations").where("translation_text is not null")
    return rows.select("translation_id", F.round(text.charset_overlap(F.col("source_text"), F.col("translation_text")), 6).alias("overlap")).distinct()


@R.query("""SELECT DISTINCT artifact_id, CASE WHEN lower(relative_path) LIKE 'grouping%' THEN 'grouping' WHEN regexp_matches(lower(relative_path), '^(detection|ocr)/') THEN 'reading' WHEN relative_path IS NULL THEN 'unknown' ELSE 'other' END AS marker FROM processing_artifacts""")
def marker_classify(spark: SparkSession, d: str) -> DataFrame:
    path = F.lower("relative_path")
    marker = exprs.first_rule([(path.startswith("grouping"), "grouping"), (path.rlike("^(detection|ocr)/"), "reading"), (F.col("relative_path").isNull(), "unknown")], "other")
    return table(spark, d, "processing_artifacts").select("artifact_id", marker.alias("marker")).distinct()


@R.query("""SELECT p_partkey, CASE WHEN p_name = f THEN 1.0 WHEN contains(p_name, f) OR contains(f, p_name) THEN 0.55 ELSE 0.0 END::DOUBLE AS likeness, round(exp(-abs(ln(p_size::DOUBLE / s))), 6) AS size_score
FROM (SELECT p_partkey, p_size, lower(replace(p_name, ' ', '')) AS p_name, first_value(lower(replace(p_name, ' ', ''))) OVER w AS f, first_value(p_size) OVER w AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))""")
def pair_score(spark: SparkSession, d: str) -> DataFrame:
    """Each part scored against the first of its brand."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    first = parts.groupBy(F.col("p_brand").alias("b")).agg(F.min_by(F.struct("p_name", "p_size"), "p_partkey").alias("f"))
    joined = parts.join(first, F.col("p_brand") == F.col("b"))
    size = F.exp(-F.abs(F.log(F.col("p_size").cast("double") / F.col("f.p_size"))))
    return joined.select("p_partkey", text.name_likeness(F.col("p_name"), F.col("f.p_name")).alias("likeness"), F.round(size, 6).alias("size_score"))


@R.query("""SELECT c_custkey, 'customer-v1:' || sha256('{"name":"' || c_name || '","nation":"' || c_nationkey || '","segment":' || coalesce('"' || nullif(c_mktsegment, 'MACHINERY') || '"', 'null') || '}') AS content_id FROM customer""")
def canonical_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    fields = [("segment", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))), ("name", F.col("c_name")), ("nation", F.col("c_nationkey"))]
    return table(spark, d, "customer").select("c_custkey", exprs.content_id("customer", exprs.canonical_text(fields)).alias("content_id"))


@R.query("SELECT DISTINCT page_cleaning_run_id, sha256(concat_ws('|', page_id, source_hash, coalesce(profile_snapshot_id, '-'), config_hash)) AS input_hash FROM page_cleaning_runs")
def stage_input_hash(spark: SparkSession, d: str) -> DataFrame:
    parts = F.concat_ws("|", "page_id", "source_hash", F.coalesce("profile_snapshot_id", F.lit("-")), "config_hash")
    return table(spark, d, "page_cleaning_runs").select("page_cleaning_run_id", F.sha2(parts, 256).alias("input_hash")).distinct()


@R.query("""SELECT DISTINCT translation_id, CASE WHEN error_classification = 'provider_refusal' THEN 'refusal' WHEN http_status IS NULL THEN 'timeout' WHEN http_status >= 500 THEN 'server_error' WHEN NOT api_ok THEN 'runtime_failure'
  WHEN coalesce(trim(content), '') = '' THEN 'empty' WHEN translation_text IS NULL THEN 'structure_failure' ELSE 'ok' END AS outcome FROM translations""")
def response_classify(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        (F.col("error_classification") == "provider_refusal", "refusal"), (F.col("http_status").isNull(), "timeout"), (F.col("http_status") >= 500, "server_error"), (~F.col("api_ok"), "runtime_failure"),
        (F.coalesce(F.trim("content"), F.lit("")) == "", "empty"), (F.col("translation_text").isNull(), "structure_failure"),
    ]
    return table(spark, d, "translations").select("translation_id", exprs.first_rule(rules, "ok").alias("outcome")).distinct()


@R.query("""SELECT DISTINCT check_result_id, CASE WHEN metrics_json IS NULL THEN 'missing' WHEN NOT json_valid(metrics_json) THEN 'bad' WHEN json_extract(metrics_json, '$.fragment_count') IS NULL THEN 'incomplete' ELSE 'ok' END AS validity FROM grouping_check_results""")
def json_validate(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.try_parse_json("metrics_json")
    rules = [(F.col("metrics_json").isNull(), "missing"), (parsed.isNull(), "bad"), (F.try_variant_get(parsed, "$.fragment_count", "long").isNull(), "incomplete")]
    return table(spark, d, "grouping_check_results").select("check_result_id", exprs.first_rule(rules, "ok").alias("validity")).distinct()


@R.query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k, count(*) AS n_events FROM events GROUP BY 1")
def json_extract_rollup(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return parsed.groupBy("event_type").agg(F.sum("p.k").alias("total_k"), F.count("*").alias("n_events"))


_SECRETS = (r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]{2,}", r"sk-[A-Za-z0-9]{8,}", r"\b[0-9]{3}-[0-9]{4}-[0-9]{4}\b", r"mask_px=[0-9]{5}")


@R.query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in _SECRETS))
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold text of a forbidden shape: an address, a key, a telephone number, a leaked pixel count."""
    return table(spark, d, "documents").where(text.any_pattern(F.col("text"), _SECRETS)).select("doc_id")


_FORBIDDEN = ("unresolved_relation_count", "score", "confidence")


@R.query(f"SELECT DISTINCT check_result_id, t.key AS path FROM grouping_check_results, json_tree(metrics_json) t WHERE metrics_json IS NOT NULL AND t.key IN {_FORBIDDEN}")
def prohibited_key_scan(spark: SparkSession, d: str) -> DataFrame:
    """Results whose metrics hold a forbidden key at any depth, with the key."""
    rows = table(spark, d, "grouping_check_results").select("check_result_id", F.explode(text.json_keys(F.col("metrics_json"))).alias("path"))
    return rows.where(F.col("path").isin(*_FORBIDDEN)).distinct()


@R.query("SELECT DISTINCT check_result_id FROM grouping_check_results WHERE NOT regexp_full_match(candidate_manifest_sha256, '[0-9a-f]{64}') OR substr(input_fingerprint, 1, 8) <> substr(split_part(check_result_id, ':', 2), 1, 8)")
def binding_violations(spark: SparkSession, d: str) -> DataFrame:
    """Results whose hashes are malformed or whose id is not that of their input."""
    bad = ~F.col("candidate_manifest_sha256").rlike("^[0-9a-f]{64}$") | (F.substring("input_fingerprint", 1, 8) != F.substring(F.split_part("check_result_id", F.lit(":"), F.lit(2)), 1, 8))
    return table(spark, d, "grouping_check_results").where(bad).select("check_result_id").distinct()


@R.query("""SELECT asset_id, fragment_id, rule FROM (SELECT DISTINCT asset_id, fragment_id, 'missing_provenance' AS rule FROM fragments WHERE score IS NULL AND ocr_error IS NULL
  UNION ALL SELECT DISTINCT asset_id, fragment_id, 'coordinate_mismatch' FROM fragments WHERE polygon IS NULL OR len(polygon) = 0 OR list_min(list_transform(polygon, lambda p: p[1])) IS DISTINCT FROM bbox.x OR list_min(list_transform(polygon, lambda p: p[2])) IS DISTINCT FROM bbox.y
    OR list_max(list_transform(polygon, lambda p: p[1])) IS DISTINCT FROM bbox.x + bbox.width OR list_max(list_transform(polygon, lambda p: p[2])) IS DISTINCT FROM bbox.y + bbox.height)""")
def fragment_findings(spark: SparkSession, d: str) -> DataFrame:
    """Readings without provenance (neither a score nor an error), and those whose polygon lies in other coordinates than their box."""
    b, around = F.col("bbox"), geometry.polygon_box(F.col("polygon"))
    same = around.left.eqNullSafe(b.x) & around.top.eqNullSafe(b.y) & around.right.eqNullSafe(b.x + b.width) & around.bottom.eqNullSafe(b.y + b.height)
    rules = [(F.col("score").isNull() & F.col("ocr_error").isNull(), "missing_provenance"), (around.isNull() | ~same, "coordinate_mismatch")]
    return table(spark, d, "fragments").select("asset_id", "fragment_id", F.explode(exprs.all_rules(rules)).alias("rule")).distinct()


@R.query("""WITH c AS (SELECT DISTINCT check_result_id, CASE WHEN finding_codes_json = '[]' THEN 'PRODUCED' WHEN starts_with(finding_codes_json, '[') THEN 'INCOMPLETE' ELSE 'OTHER' END AS disposition,
  coalesce(CAST(json_extract(metrics_json, '$.unresolved_relation_count') AS BIGINT), 0) > 0 AS unresolved, contains(finding_codes_json, 'MISSING_FRAGMENT') AS unproven, contains(finding_codes_json, 'RELATION') AS evidence FROM grouping_check_results)
SELECT check_result_id, disposition, CASE WHEN disposition = 'OTHER' THEN 'invalid_disposition' WHEN disposition = 'PRODUCED' AND (unresolved OR coalesce(unproven, false)) THEN 'produced_with_unresolved_blocker'
  WHEN disposition = 'INCOMPLETE' AND NOT (unresolved AND evidence) THEN 'incomplete_without_evidence' END AS finding FROM c""")
def disposition_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each result's disposition, as its finding codes imply it, fits what is unresolved and what there is evidence for."""
    codes = F.col("finding_codes_json")
    disposition = exprs.first_rule([(codes == "[]", "PRODUCED"), (codes.startswith("["), "INCOMPLETE")], "OTHER")
    unresolved = F.get_json_object("metrics_json", "$.unresolved_relation_count").cast("long") > 0
    rows = table(spark, d, "grouping_check_results").select("check_result_id", codes, unresolved.alias("unresolved"), disposition.alias("disposition")).distinct()
    found = reconcile.disposition_findings(rows, "disposition", F.col("unresolved"), codes.contains("MISSING_FRAGMENT"), codes.contains("RELATION"))
    return found.select("check_result_id", "disposition", "finding").distinct()


@R.query("""WITH h AS (SELECT page_cleaning_run_id, loaded_at, sha256(concat_ws('|', coalesce(source_hash, '-'), coalesce(config_hash, '-'), coalesce(status, '-'))) AS p FROM page_cleaning_runs),
f AS (SELECT page_cleaning_run_id, arg_min(p, (loaded_at, p)) AS stored FROM h GROUP BY 1)
SELECT page_cleaning_run_id, stored, count(*) AS n_deliveries, count(*) FILTER (p <> stored) AS n_drifted FROM h JOIN f USING (page_cleaning_run_id) GROUP BY ALL""")
def fingerprint_check(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose fingerprint, computed again from a later delivery, is not that of the first."""
    return reconcile.fingerprint_drift(table(spark, d, "page_cleaning_runs"), "page_cleaning_run_id", ["source_hash", "config_hash", "status"], "loaded_at")


@R.query("SELECT DISTINCT artifact_id, regexp_replace(relative_path, '[^\\p{L}\\p{N}_-]', '_', 'g') AS file_name FROM processing_artifacts")
def safe_file_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processing_artifacts").select("artifact_id", exprs.safe_name(F.col("relative_path")).alias("file_name")).distinct()


@R.query("SELECT DISTINCT fragment_id, CAST(printf('%.3f', score) AS DOUBLE) AS score_3, CAST(printf('%.1f', score * 100) AS DOUBLE) AS percent, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS created_text FROM fragments")
def rounded_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores rounded half to even by their exact binary values, with the time of the reading as UTC text."""
    score = F.col("score")
    return table(spark, d, "fragments").select("fragment_id", exprs.half_even(score, 3).alias("score_3"), exprs.half_even(score * 100, 1).alias("percent"), exprs.utc_text(F.col("created_at")).alias("created_text")).distinct()


@R.query("""SELECT DISTINCT region_id, split FROM evaluation_regions WHERE bbox IS NOT NULL AND (split = 'core' OR (split = 'evaluation' AND expected IS NOT NULL AND direction = 'vertical'))""")
def scored_subset(spark: SparkSession, d: str) -> DataFrame:
    """Regions that count in a score: those of the core split, and of the evaluation split those with a text and of the main direction; none without a box."""
    counts = (F.col("split") == "core") | ((F.col("split") == "evaluation") & F.col("expected").isNotNull() & (F.col("direction") == "vertical"))
    return table(spark, d, "evaluation_regions").where(F.col("bbox").isNotNull() & counts).select("region_id", "split").distinct()
