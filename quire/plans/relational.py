"""Queries over scans, filters, joins and versioned ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import exprs
from quire.operators import ledger, reconcile
from quire.plans.registry import Registry
from quire.sources.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def money(c: str) -> F.Column:
    """A column of two decimals in whole hundredths, so sums are exact in any order."""
    return F.round(F.col(c) * 100).cast("long")


@R.query("SELECT doc_id, work_id, n_chars, chapter_index + 1 AS chapter FROM documents WHERE lang = 'ja' AND source = 'scene_transcript'")
def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where((F.col("lang") == "ja") & (F.col("source") == "scene_transcript"))
    return docs.select("doc_id", "work_id", "n_chars", (F.col("chapter_index") + 1).alias("chapter"))


@R.query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')""")
def in_not_in_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
    return table(spark, d, "orders").where(kept).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@R.query("""SELECT artifact_id, count(*) AS n_rows FROM processing_artifacts
WHERE (batch_id = 'batch-000001' OR batch_id IS NULL) AND source_stage <> 'ocr' GROUP BY artifact_id""")
def scoped_or_global_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processing_artifacts").where(((F.col("batch_id") == "batch-000001") | F.col("batch_id").isNull()) & (F.col("source_stage") != "ocr"))
    return rows.groupBy("artifact_id").agg(F.count("*").alias("n_rows"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines of each order with their ``place`` among all of its lines."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", place.alias("place"))


@R.query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem""")
def ordered_children(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every order with their places."""
    return numbered_lines(table(spark, d, "lineitem"))


@R.query("""SELECT n_regionkey, sha256(concat_ws(':', count(*)::VARCHAR, sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR,
  sum(('0x' || substr(h, 17, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 25, 8))::BIGINT)::VARCHAR)) AS fingerprint
FROM (SELECT n_regionkey, sha256(n_nationkey::VARCHAR || '=' || n_name) AS h FROM nation) GROUP BY n_regionkey""")
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit("="), "n_name")
    return reconcile.group_fingerprint(table(spark, d, "nation"), ["n_regionkey"], line)


@R.query("""WITH recent AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1)
SELECT c_custkey, c_name, coalesce(p, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN recent ON c_custkey = o_custkey""")
def subset_update_merge(spark: SparkSession, d: str) -> DataFrame:
    recent = ledger.latest_per_key(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    joined = table(spark, d, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", F.coalesce("o_orderpriority", "c_mktsegment").alias("c_mktsegment"))


def label_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, label, n_value`` of every ``Label: value`` line; only a line feed ends a line. A null text has no lines."""
    pattern = r"(?d)^([A-Za-z][A-Za-z-]{1,20}): (.+)$"
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).where(F.col("l").rlike(pattern))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), F.regexp_extract("l", pattern, 1).alias("label"), F.length(F.regexp_extract("l", pattern, 2)).alias("n_value"))


@R.query("""SELECT doc_id, i AS line_no, regexp_extract(l, '^([A-Za-z][A-Za-z-]{1,20}): (.+)$', 1) AS label, length(regexp_extract(l, '^([A-Za-z][A-Za-z-]{1,20}): (.+)$', 2)) AS n_value
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(l, '^([A-Za-z][A-Za-z-]{1,20}): (.+)$')""")
def regex_form_parse(spark: SparkSession, d: str) -> DataFrame:
    """The labelled lines of every document."""
    return label_lines(table(spark, d, "documents"))


@R.query("""WITH latest AS (SELECT artifact_id, arg_max(file_hash, updated_at) AS h, arg_max(storage_state, updated_at) AS s FROM processing_artifacts GROUP BY 1)
SELECT DISTINCT check_result_id, CASE WHEN evidence_artifact_id IS NULL OR evidence_artifact_id = '' THEN 'unreferenced' WHEN a.artifact_id IS NULL THEN 'missing'
  WHEN s <> 'present' THEN 'not_present' WHEN h IS DISTINCT FROM evidence_artifact_sha256 THEN 'hash_mismatch' ELSE 'valid' END AS integrity
FROM grouping_check_results g LEFT JOIN latest a ON g.evidence_artifact_id = a.artifact_id""")
def integrity_status(spark: SparkSession, d: str) -> DataFrame:
    stored = ledger.latest_per_key(table(spark, d, "processing_artifacts").select("artifact_id", "updated_at", "file_hash", "storage_state"), ["artifact_id"], ["updated_at"])
    checks = table(spark, d, "grouping_check_results").select("check_result_id", "evidence_artifact_id", "evidence_artifact_sha256")
    joined = ledger.pointer_join(checks, stored, {"evidence_artifact_id": "artifact_id"}, "a_")
    verdict = exprs.first_rule(
        [
            (F.col("evidence_artifact_id").isNull() | (F.col("evidence_artifact_id") == ""), "unreferenced"),
            (F.col("a_artifact_id").isNull(), "missing"),
            (F.col("a_storage_state") != "present", "not_present"),
            (~F.col("a_file_hash").eqNullSafe(F.col("evidence_artifact_sha256")), "hash_mismatch"),
        ],
        "valid",
    )
    return joined.select("check_result_id", verdict.alias("integrity")).distinct()


@R.query("""SELECT member, count(*) AS n_rows FROM (SELECT c_name AS member FROM customer WHERE c_custkey < 1000 UNION ALL SELECT c_name FROM customer WHERE c_custkey >= 500 UNION ALL SELECT s_name FROM supplier)
GROUP BY member HAVING count(*) > 1""")
def union_unique_check(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(F.col("c_name").alias("member"), "c_custkey")
    both = names.where("c_custkey < 1000").unionByName(names.where("c_custkey >= 500")).unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("member")), allowMissingColumns=True)
    return reconcile.duplicate_keys(both, ["member"])


@R.query("SELECT timing_id, count(*) AS n_rows FROM stage_timings GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.duplicate_keys(table(spark, d, "stage_timings"), ["timing_id"])


@R.query("""SELECT o_orderkey, count(DISTINCT l_linenumber) = max(l_linenumber) AND min(l_linenumber) = 1 AS complete, count(*) AS n_lines
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def exact_set_gate(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"))
    whole = (F.count_distinct("l_linenumber") == F.max("l_linenumber")) & (F.min("l_linenumber") == 1)
    return joined.groupBy("o_orderkey").agg(whole.alias("complete"), F.count("*").alias("n_lines"))


@R.query("""SELECT coalesce(d.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'matched' END AS status
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM level_ratings) r ON d.doc_id = r.doc_id""")
def set_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.set_reconcile(table(spark, d, "documents"), table(spark, d, "level_ratings"), ["doc_id"])


@R.query("""SELECT c_custkey, count(o_orderkey) AS n_orders, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS n_blocking,
  CASE WHEN count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') > 0 THEN 'blocked' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 OR count(o_orderkey) = 0 THEN 'with_warnings' ELSE 'ready' END AS readiness
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def readiness_rollup(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).alias("b")
    )
    joined = table(spark, d, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    n, o, b = (F.coalesce(c, F.lit(0)) for c in ("n", "o", "b"))
    readiness = exprs.first_rule([(b > 0, "blocked"), ((o > 0) | (n == 0), "with_warnings")], "ready")
    return joined.select("c_custkey", n.alias("n_orders"), o.alias("n_open"), b.alias("n_blocking"), readiness.alias("readiness"))


@R.query("SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R' AND l_discount <= 0.08)")
def all_or_nothing_gate(spark: SparkSession, d: str) -> DataFrame:
    return ledger.all_or_nothing(table(spark, d, "lineitem"), "l_orderkey", (F.col("l_returnflag") != "R") & (F.col("l_discount") <= 0.08))


_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)"""


@R.query(f"""WITH {_RANKED} SELECT a.o_custkey, concat_ws(',', CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'status' END,
  CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'priority' END, CASE WHEN a.o_orderdate IS DISTINCT FROM b.o_orderdate THEN 'date' END) AS differing
FROM ranked a LEFT JOIN ranked b ON a.o_custkey = b.o_custkey AND b.rn = 2 WHERE a.rn = 1""")
def field_mismatch_list(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    lag = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    fields = {"status": "o_orderstatus", "priority": "o_orderpriority", "date": "o_orderdate"}
    latest = ledger.latest_per_key(orders.select("o_custkey", "o_orderdate", "o_orderkey", *[F.lag(c).over(lag).alias(f"p_{c}") for c in fields.values()], "o_orderstatus", "o_orderpriority"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return latest.select("o_custkey", F.array_join(exprs.mismatches([(n, F.col(c), F.col(f"p_{c}")) for n, c in fields.items()]), ",").alias("differing"))


@R.query("""SELECT fragment_id, CASE WHEN ocr_error IS NOT NULL THEN 'failed' WHEN ocr_text IS NULL THEN 'absent' WHEN ocr_text = '' THEN 'empty' WHEN score IS NULL THEN 'unscored' WHEN score < 0.5 THEN 'doubtful' ELSE 'usable' END AS outcome,
  count(*) AS n_rows FROM fragments GROUP BY ALL""")
def decision_chain(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("ocr_error").isNotNull(), "failed"), (F.col("ocr_text").isNull(), "absent"), (F.col("ocr_text") == "", "empty"), (F.col("score").isNull(), "unscored"), (F.col("score") < 0.5, "doubtful")]
    return table(spark, d, "fragments").groupBy("fragment_id", exprs.first_rule(rules, "usable").alias("outcome")).agg(F.count("*").alias("n_rows"))


@R.query("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'same' WHEN o_totalprice >= 100000 THEN 'uncertain' WHEN o_totalprice < 100000 THEN 'different' END AS class FROM orders")
def tri_state_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", exprs.bands(F.col("o_totalprice"), 100000, 300000, ("different", "uncertain", "same")).alias("class"))


@R.query("""SELECT doc_id, concat_ws(';', CASE WHEN lang IN ('ja', 'zh') THEN 'cjk' END, CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN n_chars < 100 THEN 'short' END,
  CASE WHEN chapter_index IS NULL THEN 'unplaced' END, CASE WHEN work_id IS NULL THEN 'without_work' END) AS tags FROM documents""")
def multi_tag_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [(F.col("lang").isin("ja", "zh"), "cjk"), (F.col("n_chars") > 2000, "long"), (F.col("n_chars") < 100, "short"), (F.col("chapter_index").isNull(), "unplaced"), (F.col("work_id").isNull(), "without_work")]
    return table(spark, d, "documents").select("doc_id", F.array_join(exprs.all_rules(rules), ";").alias("tags"))


@R.query("""SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey
LEFT JOIN orders o ON o.o_orderkey = k""")
def active_pointer_join(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    pointers = orders.groupBy(F.col("o_custkey").alias("owner")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("active"))
    owners = table(spark, d, "customer").select("c_custkey").join(pointers, F.col("c_custkey") == F.col("owner"), "left")
    joined = ledger.pointer_join(owners, orders.select("o_orderkey", "o_orderstatus"), {"active": "o_orderkey"}, "v_")
    return joined.select("c_custkey", F.col("v_o_orderkey").alias("o_orderkey"), F.col("v_o_orderstatus").alias("o_orderstatus"))


@R.query("""WITH last AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1), line AS (SELECT l_orderkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1)
SELECT c_custkey, k AS o_orderkey, first_line FROM customer LEFT JOIN last ON c_custkey = o_custkey LEFT JOIN line ON k = l_orderkey""")
def two_hop_left_join(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.max("o_orderkey").alias("o_orderkey"))
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("lined")).agg(F.min("l_linenumber").alias("first_line"))
    joined = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("owner"), "left").join(line, F.col("o_orderkey") == F.col("lined"), "left")
    return joined.select("c_custkey", "o_orderkey", "first_line")


@R.query("SELECT artifact_id, arg_max(storage_state, (updated_at, storage_state)) AS storage_state, max(updated_at)::VARCHAR[1:19] AS updated_at FROM processing_artifacts GROUP BY 1".replace("max(updated_at)::VARCHAR[1:19]", "strftime(max(updated_at), '%Y-%m-%d %H:%M:%S')"))
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processing_artifacts").select("artifact_id", "updated_at", "storage_state")
    return ledger.latest_per_key(rows, ["artifact_id"], ["updated_at", "storage_state"]).select("artifact_id", "storage_state", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@R.query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return ledger.first_per_key(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@R.query("SELECT c_custkey, coalesce(max(month(o_orderdate)), 0) + 1 AS next_version FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return ledger.next_versions(table(spark, d, "customer"), orders, "c_custkey", F.month("o_orderdate"))


@R.query("""SELECT p_brand, count(*) AS n_lines, count(DISTINCT o_custkey) AS n_customers FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
WHERE o_orderstatus = 'F' GROUP BY 1""")
def relation_inner_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.count("*").alias("n_lines"), F.count_distinct("o_custkey").alias("n_customers"))


@R.query("""SELECT n_name, o_orderstatus, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def three_way_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", money("l_extendedprice").alias("cents"))
    joined = lines.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "o_orderstatus").agg(F.sum("cents").alias("cents"))


@R.query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')")
def semi_join_blockers(spark: SparkSession, d: str) -> DataFrame:
    open_urgent = table(spark, d, "orders").where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(open_urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@R.query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def anti_join_violations(spark: SparkSession, d: str) -> DataFrame:
    accepted = table(spark, d, "lineitem").where("l_returnflag = 'N'").select("l_orderkey")
    return table(spark, d, "orders").join(accepted, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@R.query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)
OR c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 49)""")
def or_of_semi_joins(spark: SparkSession, d: str) -> DataFrame:
    """A disjunction of memberships cannot be one hash join: each is a semi join, and the ids are united."""
    customers, orders = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    large = orders.join(table(spark, d, "lineitem").where("l_quantity >= 49").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    nations = customers.join(table(spark, d, "supplier").where("s_acctbal < 0"), F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select("c_custkey")
    ids = urgent.unionByName(large).unionByName(nations).distinct().withColumnRenamed("c_custkey", "hit")
    return customers.join(ids, F.col("c_custkey") == F.col("hit"), "left_semi").select("c_custkey")


@R.query("""SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1) THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def update_via_semi_join(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").where("p_size = 1").select("p_partkey")
    hit = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey").distinct()
    joined = table(spark, d, "orders").join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.when(F.col("l_orderkey").isNotNull(), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@R.query("SELECT c_custkey, c_name, count(o_orderkey) AS order_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def denormalized_count(spark: SparkSession, d: str) -> DataFrame:
    return ledger.counted(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders"), "c_custkey", "o_custkey", "order_count")


@R.query("""SELECT s_suppkey, coalesce(n_name, '{}') AS nation, coalesce(r_name, '{}') AS region FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def dict_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Look-ups in fixed tables of 25 and 5 rows; their statistics make the planner broadcast them."""
    nations = table(spark, d, "nation").where("n_nationkey < 20")
    joined = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", F.coalesce("n_name", F.lit("{}")).alias("nation"), F.coalesce("r_name", F.lit("{}")).alias("region"))


@R.query("""WITH keys AS (SELECT p_partkey, p_name AS k FROM part UNION SELECT p_partkey, p_brand FROM part UNION SELECT p_partkey, p_type FROM part)
SELECT k, count(*) AS n_parts, min(p_partkey) AS first_part FROM keys WHERE k IN ('Brand#2', 'ECONOMY', 'red widget', 'small ring') GROUP BY 1""")
def multi_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(F.array("p_name", "p_brand", "p_type"))).alias("k"))
    return keyed.where(F.col("k").isin("Brand#2", "ECONOMY", "red widget", "small ring")).groupBy("k").agg(F.count("*").alias("n_parts"), F.min("p_partkey").alias("first_part"))


@R.query("""SELECT DISTINCT detection_dependency_id, source_artifact_id FROM accepted_detection_evidence_sets WHERE source_artifact_id IS NOT NULL AND source_artifact_id NOT IN (SELECT artifact_id FROM processing_artifacts)""")
def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "accepted_detection_evidence_sets").select("detection_dependency_id", "source_artifact_id").distinct()
    return reconcile.dangling(sets, "source_artifact_id", table(spark, d, "processing_artifacts"), "artifact_id")


@R.query("""WITH codes AS (SELECT DISTINCT check_result_id, finding_codes_json FROM grouping_check_results)
SELECT code, count(*) AS n_results FROM (SELECT check_result_id, unnest(CAST(finding_codes_json AS VARCHAR[])) AS code FROM codes) GROUP BY 1""")
def nested_code_counts(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "grouping_check_results").select("check_result_id", "finding_codes_json").distinct()
    return codes.select(F.explode(F.from_json("finding_codes_json", "array<string>")).alias("code")).groupBy("code").agg(F.count("*").alias("n_results"))


@R.query("""SELECT n_name, c_mktsegment, trial FROM nation, (SELECT DISTINCT c_mktsegment FROM customer), (SELECT unnest([1, 2, 3]) AS trial)""")
def trial_schedule(spark: SparkSession, d: str) -> DataFrame:
    """A schedule is the product of fixed lists: nations, segments and trial numbers."""
    segments = table(spark, d, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    plan = table(spark, d, "nation").select("n_name").join(F.broadcast(segments), F.lit(True))  # one row
    return plan.select("n_name", F.explode("segments").alias("c_mktsegment")).select("n_name", "c_mktsegment", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("trial"))


@R.query("""SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) END) AS BIGINT) AS click, CAST(sum(CASE WHEN event_type = 'error' THEN CAST(round(value * 100) AS BIGINT) END) AS BIGINT) AS error FROM events GROUP BY 1""")
def paired_pivot(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", money("value").alias("cents"))
    return events.groupBy("user_id").pivot("event_type", ["click", "error"]).agg(F.sum("cents"))


@R.query("""SELECT timing_id, CASE WHEN reused.source_run IS NULL THEN 'fresh' WHEN k.run_id IS NULL THEN 'gone' ELSE 'known' END AS status
FROM (SELECT DISTINCT timing_id, source_run FROM stage_timings) reused LEFT JOIN (SELECT DISTINCT run_id FROM stage_timings) k ON reused.source_run = k.run_id""")
def reuse_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stage_timings")
    runs = rows.select(F.col("run_id").alias("known_run")).distinct()
    joined = rows.select("timing_id", "source_run").distinct().join(runs, F.col("source_run") == F.col("known_run"), "left")
    return joined.select("timing_id", F.when(F.col("source_run").isNull(), "fresh").when(F.col("known_run").isNull(), "gone").otherwise("known").alias("status"))
