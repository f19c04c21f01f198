"""Queries over aggregates, roll-ups, evaluation and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import exprs
from quire.operators import evaluate, ledger, reconcile, selection
from quire.plans.registry import Registry
from quire.plans.relational import money
from quire.sources.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@R.query("""SELECT g AS group_name, count(t.translation_id) AS n_pairs, count(CASE WHEN api_ok THEN 1 END) AS n_ok, count(CASE WHEN t.translation_id IS NOT NULL AND translation_text IS NULL THEN 1 END) AS n_unparsed, count(CASE WHEN http_status = 200 THEN 1 END) AS n_http_ok,
  CAST(coalesce(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)), 0) AS BIGINT) AS tokens, coalesce(round(count(CASE WHEN api_ok THEN 1 END)::DOUBLE / nullif(count(t.translation_id), 0), 6), 0) AS ok_rate
FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS g) LEFT JOIN (SELECT DISTINCT * EXCLUDE (uncertainty_flags, loaded_at) FROM translations) t ON g = group_name GROUP BY 1""")
def experiment_rollup(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in "ABCDE"])).alias("g"))
    pairs = ledger.latest_per_key(table(spark, d, "translations").select("translation_id", "group_name", "api_ok", "translation_text", "http_status", "input_tokens", "output_tokens", "loaded_at"), ["translation_id"], ["loaded_at"])
    sums = pairs.groupBy("group_name").agg(
        F.count("*").alias("n_pairs"), F.count_if("api_ok").alias("n_ok"), F.count_if(F.col("translation_text").isNull()).alias("n_unparsed"), F.count_if(F.col("http_status") == 200).alias("n_http_ok"),
        F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"),
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pairs", "n_ok", "n_unparsed", "n_http_ok", "tokens")]
    return groups.join(sums, F.col("g") == F.col("group_name"), "left").select(F.col("g").alias("group_name"), *counts, F.round(exprs.safe_rate(F.col("n_ok"), F.col("n_pairs")), 6).alias("ok_rate"))


@R.query("SELECT DISTINCT translation_id, CASE WHEN input_tokens IS NULL AND output_tokens IS NULL THEN NULL ELSE coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END AS tokens FROM translations")
def optional_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations").select("translation_id", exprs.optional_sum(F.col("input_tokens"), F.col("output_tokens")).alias("tokens")).distinct()


@R.query("SELECT project_id, string_agg(stage || ':' || n, ';' ORDER BY stage) AS counter FROM (SELECT project_id, stage, count(*) AS n FROM stage_timings WHERE stage IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def counter_text(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "stage_timings").where("stage is not null").groupBy("project_id", "stage").agg(F.count("*").alias("n"))
    return counts.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage", "n"))), lambda x: F.concat(x.stage, F.lit(":"), x.n)), ";").alias("counter"))


@R.query("""SELECT asset_id, min(bbox.width) || 'x' || min(bbox.height) || '..' || max(bbox.width) || 'x' || max(bbox.height) AS sizes FROM evaluation_regions GROUP BY 1""")
def range_text(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("bbox.width"), F.col("bbox.height")
    return table(spark, d, "evaluation_regions").groupBy("asset_id").agg(F.format_string("%dx%d..%dx%d", F.min(w), F.min(h), F.max(w), F.max(h)).alias("sizes"))


@R.query("SELECT asset_id, coalesce(string_agg(DISTINCT ocr_error, ',' ORDER BY ocr_error), '') AS errors FROM fragments GROUP BY 1")
def sorted_distinct_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fragments").groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_set("ocr_error")), ",").alias("errors"))


@R.query("SELECT check_version, count(*) FILTER (finding_codes_json = '[]') || '/' || count(*) AS passed FROM grouping_check_results GROUP BY 1")
def check_ratio_text(spark: SparkSession, d: str) -> DataFrame:
    passed = F.concat(F.count_if(F.col("finding_codes_json") == "[]").cast("string"), F.lit("/"), F.count("*").cast("string"))
    return table(spark, d, "grouping_check_results").groupBy("check_version").agg(passed.alias("passed"))


@R.query("""SELECT l_returnflag, median(l_quantity) AS median_quantity, CAST(trunc(median(l_extendedprice)) AS BIGINT) AS whole_median, max(l_quantity) AS max_quantity, round(avg(l_quantity), 6) AS mean_quantity
FROM lineitem GROUP BY 1""")
def median_max_mean(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    quantity, price = (evaluate.exact_medians(lines, ["l_returnflag"], c).withColumnsRenamed({"l_returnflag": f"{c}_of", "median": f"{c}_median"}) for c in ("l_quantity", "l_extendedprice"))
    rest = lines.groupBy("l_returnflag").agg(F.max("l_quantity").alias("max_quantity"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    joined = rest.join(quantity, F.col("l_returnflag").eqNullSafe(F.col("l_quantity_of"))).join(price, F.col("l_returnflag").eqNullSafe(F.col("l_extendedprice_of")))
    return joined.select("l_returnflag", F.col("l_quantity_median").alias("median_quantity"), F.col("l_extendedprice_median").cast("long").alias("whole_median"), "max_quantity", "mean_quantity")


@R.query("SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY ALL")
def p95_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.exact_percentiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p95": 0.95})


@R.query("""SELECT asset_id, string_agg(expected, chr(10) ORDER BY CASE WHEN direction = 'vertical' THEN -bbox.x ELSE bbox.y END, CASE WHEN direction = 'vertical' THEN bbox.y ELSE bbox.x END, region_id) AS assembled
FROM evaluation_regions WHERE expected IS NOT NULL GROUP BY 1""")
def ordered_text_assembly(spark: SparkSession, d: str) -> DataFrame:
    vertical = F.col("direction") == "vertical"
    first, then = F.when(vertical, -F.col("bbox.x")).otherwise(F.col("bbox.y")), F.when(vertical, F.col("bbox.y")).otherwise(F.col("bbox.x"))
    rows = table(spark, d, "evaluation_regions").where("expected is not null").select("asset_id", F.struct(first.alias("a"), then.alias("b"), "region_id", "expected").alias("s"))
    return rows.groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_list("s"))["expected"], "\n").alias("assembled"))


@R.query("SELECT o_custkey, min(o_orderpriority) AS worst_priority FROM orders GROUP BY 1")
def worst_of_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(exprs.worst_of(F.col("o_orderpriority"), PRIORITIES).alias("worst_priority"))


@R.query("""SELECT user_id, CASE WHEN bool_and(event_type <> 'error') THEN 'GO' WHEN count(*) FILTER (event_type = 'error') * 4 < count(*) THEN 'CONDITIONAL' ELSE 'NO_GO' END AS verdict FROM events GROUP BY 1""")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    decision = F.when(F.bool_and(~bad), "GO").when(F.count_if(bad) * 4 < F.count("*"), "CONDITIONAL").otherwise("NO_GO")
    return table(spark, d, "events").groupBy("user_id").agg(decision.alias("verdict"))


@R.query("SELECT user_id, count(*) FILTER (event_type = 'signup') AS n_signup, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'signup') > 0 AND count(*) FILTER (event_type = 'error') > 0 AS mixed FROM events GROUP BY 1")
def mixed_outcome(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.count_if(F.col("event_type") == "signup"), F.count_if(F.col("event_type") == "error")
    return table(spark, d, "events").groupBy("user_id").agg(a.alias("n_signup"), b.alias("n_error"), ((a > 0) & (b > 0)).alias("mixed"))


@R.query("""SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS n_high, count(DISTINCT o_orderstatus) AS n_statuses, bool_or(o_orderstatus = 'F') AS any_failed,
  string_agg(DISTINCT o_orderstatus || left(o_orderpriority, 1), ',' ORDER BY o_orderstatus || left(o_orderpriority, 1)) AS dedupe_keys FROM orders GROUP BY 1""")
def issue_summary(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count_if(p == "1-URGENT").alias("n_urgent"), F.count_if(p == "2-HIGH").alias("n_high"), F.count_distinct(s).alias("n_statuses"), F.bool_or(s == "F").alias("any_failed"),
        F.array_join(F.array_sort(F.collect_set(F.concat(s, F.substring(p, 1, 1)))), ",").alias("dedupe_keys"),
    )


@R.query("""SELECT direction, count(*) AS n_rows, count(DISTINCT asset_id) AS n_assets, count(*) >= 8 AND count(DISTINCT asset_id)::DOUBLE / count(*) >= 0.2 AS gate FROM evaluation_regions GROUP BY 1""")
def manual_gate(spark: SparkSession, d: str) -> DataFrame:
    n, assets = F.count("*"), F.count_distinct("asset_id")
    return table(spark, d, "evaluation_regions").groupBy("direction").agg(n.alias("n_rows"), assets.alias("n_assets"), ((n >= 8) & (exprs.safe_rate(assets, n) >= 0.2)).alias("gate"))


@R.query("""SELECT o_custkey, CASE WHEN count(DISTINCT coalesce(o_orderstatus, '')) = 1 THEN min(o_orderstatus) ELSE 'REVIEW' END AS agreed FROM orders GROUP BY 1""")
def consensus_or_default(spark: SparkSession, d: str) -> DataFrame:
    same = F.min(F.coalesce("o_orderstatus", F.lit(""))) == F.max(F.coalesce("o_orderstatus", F.lit("")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(same, F.min("o_orderstatus")).otherwise("REVIEW").alias("agreed"))


@R.query("""SELECT o_orderkey, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS failures, count(code) = 0 AS passed FROM orders LEFT JOIN (
  SELECT l_orderkey, 'DISCOUNT' AS code FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT l_orderkey, 'QUANTITY' FROM lineitem WHERE l_quantity >= 50 UNION ALL SELECT l_orderkey, 'TAX' FROM lineitem WHERE l_tax >= 0.08) ON o_orderkey = l_orderkey GROUP BY 1""")
def failure_code_set(spark: SparkSession, d: str) -> DataFrame:
    """The three rules are read off one scan of the lines."""
    rules = [(F.col("l_discount") > 0.09, "DISCOUNT"), (F.col("l_quantity") >= 50, "QUANTITY"), (F.col("l_tax") >= 0.08, "TAX")]
    codes = table(spark, d, "lineitem").select("l_orderkey", F.explode(exprs.all_rules(rules)).alias("code")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    joined = table(spark, d, "orders").select("o_orderkey").join(codes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce(F.array_join("codes", ","), F.lit("")).alias("failures"), F.col("codes").isNull().alias("passed"))


@R.query("""SELECT s.scenario, count(t.doc_id) AS n_documents, count(CASE WHEN n_chars > 0 THEN 1 END) AS n_with_text, count(CASE WHEN n_chars > 0 THEN 1 END) = 0 AS systematic_failure FROM (SELECT unnest(['cjk', 'long', 'unplaced', 'unknown_source', 'never']) AS scenario) s
LEFT JOIN (SELECT doc_id, n_chars, unnest(list_filter([CASE WHEN lang IN ('ja', 'zh') THEN 'cjk' END, CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN chapter_index IS NULL THEN 'unplaced' END, CASE WHEN source IS NULL THEN 'unknown_source' END], lambda x: x IS NOT NULL)) AS scenario FROM documents) t
ON s.scenario = t.scenario GROUP BY 1""")
def scenario_slices(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("lang").isin("ja", "zh"), "cjk"), (F.col("n_chars") > 2000, "long"), (F.col("chapter_index").isNull(), "unplaced"), (F.col("source").isNull(), "unknown_source")]
    slices = table(spark, d, "documents").select("n_chars", F.explode(exprs.all_rules(rules)).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 0).alias("ok"))
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("cjk", "long", "unplaced", "unknown_source", "never")])).alias("scenario"))
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("ok", F.lit(0))
    return listed.join(slices, F.col("scenario") == F.col("slice"), "left").select("scenario", n.alias("n_documents"), ok.alias("n_with_text"), (ok == 0).alias("systematic_failure"))


@R.query("SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n_documents, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents WHERE lang IS NOT NULL GROUP BY ROLLUP (lang)")
def split_and_overall(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "documents").where("lang is not null").rollup("lang").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"))
    return sums.withColumn("lang", F.coalesce("lang", F.lit("ALL")))


@R.query("""SELECT work_id, count(*) AS n_documents, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 6) AS english_share,
  CASE WHEN count(*) FILTER (lang = 'en') * 10 >= count(*) * 8 THEN 'english' WHEN count(*) FILTER (lang = 'en') * 10 >= count(*) * 4 THEN 'mixed' ELSE 'other' END AS class FROM documents WHERE work_id IS NOT NULL GROUP BY 1""")
def work_classification(spark: SparkSession, d: str) -> DataFrame:
    n, en = F.count("*"), F.count_if(F.col("lang") == "en")
    share = F.round(F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)), 6)
    kind = F.when(en * 10 >= n * 8, "english").when(en * 10 >= n * 4, "mixed").otherwise("other")
    return table(spark, d, "documents").where("work_id is not null").groupBy("work_id").agg(n.alias("n_documents"), share.alias("english_share"), kind.alias("class"))


_STATES = ("completed", "failed", "reused", "completed_prior_attempt")


@R.query("""WITH s AS (SELECT unnest(['completed', 'failed', 'reused', 'completed_prior_attempt']) AS l), pairs AS (SELECT status AS a, CASE WHEN duration_ms = 0 THEN 'reused' WHEN duration_ms < 0 THEN 'failed' ELSE 'completed' END AS p FROM stage_timings)
SELECT a.l AS actual, b.l AS predicted, (SELECT count(*) FROM pairs WHERE pairs.a = a.l AND pairs.p = b.l) AS n FROM s a, s b""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    guess = exprs.first_rule([(F.col("duration_ms") == 0, "reused"), (F.col("duration_ms") < 0, "failed")], "completed")
    return evaluate.confusion_matrix(table(spark, d, "stage_timings"), F.col("status"), guess, _STATES)


@R.query("""WITH c AS (SELECT stage, count(*) FILTER (status = 'reused' AND duration_ms = 0) AS tp, count(*) FILTER (status <> 'reused' AND duration_ms = 0) AS fp, count(*) FILTER (status = 'reused' AND duration_ms <> 0) AS fn FROM stage_timings GROUP BY 1)
SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(tp::DOUBLE / nullif(tp + fp + fn, 0), 6) AS iou FROM c""")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "stage_timings").groupBy("stage").agg(*evaluate.binary_counts(F.col("status") == "reused", F.col("duration_ms") == 0))
    return evaluate.with_metrics(counts)


@R.query("""WITH m AS (SELECT lang, level, method, n_chars, reading_level >= 4 AS truth FROM (SELECT d.lang, d.n_chars, r.reading_level, d.n_chars >= 2000 AS by_length, d.source IN ('criticism_essay', 'translator_note', 'lettering_guide', 'cleaning_report') AS by_source
  FROM documents d JOIN level_ratings r ON d.doc_id = r.doc_id WHERE r.reading_level IS NOT NULL AND d.lang IS NOT NULL AND d.source IS NOT NULL) UNPIVOT (level FOR method IN (by_length, by_source)))
SELECT lang, method, CAST(sum(CASE WHEN truth AND level THEN n_chars ELSE 0 END) AS BIGINT) AS hit_chars, CAST(sum(CASE WHEN level THEN n_chars ELSE 0 END) AS BIGINT) AS predicted_chars, CAST(sum(CASE WHEN truth THEN n_chars ELSE 0 END) AS BIGINT) AS true_chars FROM m GROUP BY ALL""")
def stratified_pr(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang is not null and source is not null").select("doc_id", "lang", "n_chars", "source")
    ratings = table(spark, d, "level_ratings").where("reading_level is not null").select(F.col("doc_id").alias("rated"), "reading_level")
    hard = F.col("source").isin("criticism_essay", "translator_note", "lettering_guide", "cleaning_report")
    wide = docs.join(ratings, F.col("doc_id") == F.col("rated")).select("lang", "n_chars", (F.col("reading_level") >= 4).alias("truth"), (F.col("n_chars") >= 2000).alias("by_length"), hard.alias("by_source"))
    rows = wide.unpivot(["lang", "n_chars", "truth"], ["by_length", "by_source"], "method", "level")
    weight = lambda c: F.sum(F.when(c, F.col("n_chars")).otherwise(0))
    return rows.groupBy("lang", "method").agg(weight(F.col("truth") & F.col("level")).alias("hit_chars"), weight(F.col("level")).alias("predicted_chars"), weight(F.col("truth")).alias("true_chars"))


_GRID = tuple(range(0, 5000, 250))


@R.query(f"""WITH e AS (SELECT n_chars, reading_level >= 4 AS truth FROM documents d JOIN level_ratings r ON d.doc_id = r.doc_id WHERE reading_level IS NOT NULL), t AS (SELECT unnest({list(map(float, _GRID))}::DOUBLE[]) AS threshold),
c AS (SELECT threshold, CAST(count(*) FILTER (truth AND n_chars >= threshold) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT truth AND n_chars >= threshold) AS BIGINT) AS fp, CAST(count(*) FILTER (truth AND n_chars < threshold) AS BIGINT) AS fn FROM t, e GROUP BY 1)
SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(tp::DOUBLE / nullif(tp + fp + fn, 0), 6) AS iou FROM c""")
def threshold_calibration(spark: SparkSession, d: str) -> DataFrame:
    ratings = table(spark, d, "level_ratings").where("reading_level is not null").select(F.col("doc_id").alias("rated"), (F.col("reading_level") >= 4).alias("truth"))
    examples = table(spark, d, "documents").select("doc_id", "n_chars").join(ratings, F.col("doc_id") == F.col("rated"))
    return evaluate.calibrate(examples, "n_chars", "truth", _GRID)


@R.query("SELECT lang, n_total - n_known AS uncovered FROM (SELECT lang, count(*) AS n_total, count(*) FILTER (source IS NOT NULL) + count(*) FILTER (source IS NULL) AS n_known FROM documents GROUP BY 1) WHERE n_total <> n_known")
def coverage_invariant(spark: SparkSession, d: str) -> DataFrame:
    """An assertion: rows come out only where the counts by source don't add up."""
    sums = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_total"), (F.count_if(F.col("source").isNotNull()) + F.count_if(F.col("source").isNull())).alias("n_known"))
    return sums.where("n_total <> n_known").select("lang", (F.col("n_total") - F.col("n_known")).alias("uncovered"))


@R.query("""SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, coalesce(n, 0) AS n_assigned, CASE WHEN o_orderkey IS NULL THEN 'foreign' WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'once' ELSE 'repeated' END AS cover
FROM (SELECT DISTINCT o_orderkey FROM orders) o FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey""")
def exact_cover_check(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.exact_cover(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@R.query("""WITH h AS (SELECT l_returnflag, CAST(floor(l_quantity * 5) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT l_returnflag, bin, sum(n) OVER a AS w0, sum(bin * n) OVER a AS s0, sum(n) OVER w AS w, sum(bin * n) OVER w AS s FROM h WINDOW a AS (PARTITION BY l_returnflag ORDER BY bin), w AS (PARTITION BY l_returnflag))
SELECT l_returnflag, arg_max(bin, (pow(s::DOUBLE * w0 - s0::DOUBLE * w, 2) / (w0::DOUBLE * (w - w0)), -bin)) AS threshold_bin FROM c WHERE w0 < w GROUP BY 1""")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.otsu_threshold(table(spark, d, "lineitem"), F.floor(F.col("l_quantity") * 5).cast("int"), ["l_returnflag"])


_H = "sha256(doc_id::VARCHAR || ':s1')"


@R.query(f"SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_H}, doc_id) AS place FROM documents) WHERE place <= 5")
def hash_order_sample(spark: SparkSession, d: str) -> DataFrame:
    return selection.hash_order_sample(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 5, "s1")


@R.query(f"SELECT source, doc_id, turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_H}, doc_id) AS turn FROM documents WHERE source IS NOT NULL) ORDER BY turn, source LIMIT 30")
def round_robin_select(spark: SparkSession, d: str) -> DataFrame:
    return selection.round_robin(table(spark, d, "documents").where("source is not null").select("source", "doc_id"), "source", "doc_id", 30, "s1")


@R.query(f"""WITH b1 AS (SELECT doc_id FROM documents WHERE n_chars > 3000 ORDER BY {_H} LIMIT 6), b2 AS (SELECT doc_id FROM documents WHERE lang = 'ja' AND doc_id NOT IN (FROM b1) ORDER BY {_H} LIMIT 5),
b3 AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (FROM b1) AND doc_id NOT IN (FROM b2) ORDER BY {_H} LIMIT 4)
SELECT doc_id, 'long' AS bucket FROM b1 UNION ALL SELECT doc_id, 'japanese' FROM b2 UNION ALL SELECT doc_id, 'rest' FROM b3""")
def quota_waterfall(spark: SparkSession, d: str) -> DataFrame:
    buckets = [("long", F.col("n_chars") > 3000, 6), ("japanese", F.col("lang") == "ja", 5), ("rest", F.lit(True), 4)]
    return selection.quota_waterfall(table(spark, d, "documents"), "doc_id", buckets, "s1")


@R.query("""WITH m AS (SELECT source, median(n_chars) AS med, arg_max(doc_id, (n_chars, -doc_id)) AS dominant FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT m.source, any_value(dominant) AS dominant, arg_min(doc_id, (abs(n_chars - med), doc_id)) AS near_median FROM m JOIN documents d ON m.source = d.source AND doc_id <> dominant GROUP BY 1""")
def dominant_and_median_pick(spark: SparkSession, d: str) -> DataFrame:
    return selection.dominant_and_median(table(spark, d, "documents").where("source is not null").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars")


_PARTS = """x AS (SELECT DISTINCT region_id AS item, asset_id AS e FROM evaluation_regions), y AS (SELECT DISTINCT region_id AS item, asset_id || direction AS a FROM evaluation_regions),
o AS (SELECT e, a, count(*) AS n_shared FROM x FULL JOIN y ON x.item = y.item GROUP BY ALL)"""


def whole_overlaps(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Overlaps of an asset's regions, expected together, with those of one direction, over all regions of both sides."""
    a = expected.select("region_id", F.col("asset_id").alias("g"))
    return evaluate.partition_overlaps(a, actual.select("region_id", F.concat("asset_id", "direction").alias("g")), "region_id", "g")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evaluation_regions").select("region_id", "asset_id", "direction")
    return whole_overlaps(rows, rows)


def merges_and_extras(overlaps: DataFrame) -> DataFrame:
    """``actual_group, n_expected, merges, has_extra`` of each actual group."""
    held = overlaps.where("actual_group is not null")
    return held.groupBy("actual_group").agg(F.count("expected_group").alias("n_expected"), (F.count("expected_group") > 1).alias("merges"), F.bool_or(F.col("expected_group").isNull()).alias("has_extra"))


@R.query(f"WITH {_PARTS} SELECT e AS expected_group, a AS actual_group, n_shared FROM o")
def group_region_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d)


@R.query(f"""WITH {_PARTS}, met AS (SELECT e, CAST(sum(n_shared) AS BIGINT) AS n_members, count(a) AS n_actual FROM o WHERE e IS NOT NULL GROUP BY 1), mg AS (SELECT a, count(*) AS k FROM o WHERE a IS NOT NULL GROUP BY 1),
sh AS (SELECT e, max(k) AS k FROM o JOIN mg ON o.a = mg.a WHERE e IS NOT NULL GROUP BY 1)
SELECT met.e AS expected_group, n_members, n_actual, CASE WHEN n_actual = 0 THEN 'miss' WHEN n_actual > 1 AND k > 1 THEN 'split_merge' WHEN n_actual > 1 THEN 'split' WHEN k > 1 THEN 'merge' ELSE 'hit' END AS outcome FROM met LEFT JOIN sh ON met.e = sh.e""")
def cluster_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.judge_groups(_overlaps(spark, d))


@R.query(f"WITH {_PARTS} SELECT a AS actual_group, count(e) AS n_expected, count(e) > 1 AS merges, bool_or(e IS NULL) AS has_extra FROM o WHERE a IS NOT NULL GROUP BY 1")
def merge_split_check(spark: SparkSession, d: str) -> DataFrame:
    return merges_and_extras(_overlaps(spark, d))


@R.query("""SELECT asset_id, count(DISTINCT direction) = 1 AS same, min(direction) AS direction FROM evaluation_regions GROUP BY 1""")
def topology_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evaluation_regions").groupBy("asset_id").agg((F.count_distinct("direction") == 1).alias("same"), F.min("direction").alias("direction"))


@R.query("""WITH a AS (SELECT asset_id, direction, string_agg(region_id, ',' ORDER BY region_id) AS members FROM evaluation_regions GROUP BY 1, 2), b AS (SELECT asset_id, string_agg(region_id, ',' ORDER BY region_id) AS members FROM evaluation_regions GROUP BY 1)
SELECT b.asset_id, bool_and(a.members IS NOT NULL) AS equal_partitions FROM b LEFT JOIN a ON a.asset_id = b.asset_id AND a.members = b.members GROUP BY 1""")
def partition_equality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evaluation_regions")
    line = F.col("region_id")
    fine = reconcile.group_fingerprint(rows, ["asset_id", "direction"], line).select(F.col("asset_id").alias("fine_asset"), F.col("fingerprint").alias("fine"))
    coarse = reconcile.group_fingerprint(rows, ["asset_id"], line)
    joined = coarse.join(fine, (F.col("asset_id") == F.col("fine_asset")) & (F.col("fingerprint") == F.col("fine")), "left")
    return joined.select("asset_id", F.col("fine").isNotNull().alias("equal_partitions"))


@R.query("""SELECT rule_id, severity, affected_id, sha256(rule_id || '|' || affected_id) AS finding_id FROM (
  SELECT DISTINCT 'empty_text' AS rule_id, 'error' AS severity, doc_id::VARCHAR AS affected_id FROM documents WHERE n_chars = 0
  UNION SELECT DISTINCT 'length_mismatch', 'error', doc_id::VARCHAR FROM documents WHERE n_chars <> length(text)
  UNION SELECT DISTINCT 'late_arrival', 'warning', doc_id::VARCHAR FROM documents WHERE loaded_at > written_at + INTERVAL 1 DAY)""")
def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rules = [
        ("empty_text", "error", docs.where("n_chars = 0"), F.col("doc_id")),
        ("length_mismatch", "error", docs.where(F.col("n_chars") != F.length("text")), F.col("doc_id")),
        ("late_arrival", "warning", docs.where("loaded_at > written_at + interval 1 day"), F.col("doc_id")),
    ]
    return reconcile.findings(rules)


@R.query("""SELECT asset_id, region_id, row_number() OVER (PARTITION BY asset_id ORDER BY region_id) AS place, 'g' || lpad((row_number() OVER (PARTITION BY asset_id ORDER BY bbox.y, bbox.x, region_id))::VARCHAR, 3, '0') AS group_label FROM evaluation_regions""")
def running_index(spark: SparkSession, d: str) -> DataFrame:
    by_id, by_place = (Window.partitionBy("asset_id").orderBy(*o) for o in (["region_id"], ["bbox.y", "bbox.x", "region_id"]))
    return table(spark, d, "evaluation_regions").select("asset_id", "region_id", F.row_number().over(by_id).alias("place"), F.format_string("g%03d", F.row_number().over(by_place)).alias("group_label"))
