"""Queries over ordered data and over the state that logs leave."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import exprs
from quire.operators import ledger, pairs, sequence
from quire.plans.matching import signature_words
from quire.plans.registry import Registry
from quire.plans.relational import money
from quire.sources.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
#: Boxes of a page beyond which its order of keeping is followed in rounds over pairs.
HOT_PAGE = 20_000


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")


@R.query("""SELECT user_id, run, event_type, count(*) AS length FROM (SELECT user_id, event_type, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
  SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS s FROM events)) GROUP BY ALL""".replace("SELECT user_id, run,", "SELECT user_id, CAST(run AS BIGINT) AS run,"))
def rle_islands(spark: SparkSession, d: str) -> DataFrame:
    return sequence.islands(_events(spark, d), "user_id", ["ts", "event_id"], "event_type")


@R.query("""SELECT l_orderkey, pos AS position, count(*) AS n_covering FROM (SELECT l_orderkey, unnest(generate_series(l_linenumber, l_linenumber + CAST(l_quantity AS INTEGER) % 5 - 1)) AS pos FROM lineitem) GROUP BY ALL""")
def rle_expand(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 5).alias("n"))
    return sequence.expand_runs(runs, "l_linenumber", "n", "position").groupBy("l_orderkey", "position").agg(F.count("*").alias("n_covering"))


@R.query("""WITH p AS (SELECT l_orderkey, l_suppkey % 3 AS mask, unnest(generate_series(l_linenumber, l_linenumber + CAST(l_quantity AS INTEGER) % 5 - 1)) AS pos FROM lineitem)
SELECT l_orderkey, count(*) AS n_union, count(*) FILTER (k > 1) AS n_overlapping FROM (SELECT l_orderkey, pos, count(DISTINCT mask) AS k FROM p GROUP BY 1, 2) GROUP BY 1""")
def overlap_and_union(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("mask"), "l_linenumber", (F.col("l_quantity").cast("int") % 5).alias("n"))
    points = sequence.expand_runs(runs, "l_linenumber", "n", "pos").groupBy("l_orderkey", "pos").agg((F.min("mask") < F.max("mask")).alias("shared"))
    return points.groupBy("l_orderkey").agg(F.count("*").alias("n_union"), F.count_if("shared").alias("n_overlapping"))


@R.query("""SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events FROM (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS s FROM events)) GROUP BY ALL""")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sequence.sessions(_events(spark, d), "user_id", "ts", 6 * 3600, ["event_id"]).groupBy("user_id", "session").agg(F.count("*").alias("n_events"))


@R.query("SELECT user_id, coalesce(arg_min(strftime(ts, '%Y-%m-%d %H:%M'), (ts, event_id)) FILTER (event_type = 'error'), 'none') AS first FROM events GROUP BY 1")
def first_divergence(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return sequence.first_where(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "error", "at", "none")


@R.query("""SELECT p AS from_state, event_type AS to_state, count(*) AS n_bad FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE p IS NOT NULL AND NOT ((p = 'signup' AND event_type = 'view') OR (p = 'view' AND event_type IN ('click', 'view')) OR (p = 'click' AND event_type IN ('purchase', 'view'))) GROUP BY ALL""")
def transition_validation(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view")], "from_state string, to_state string")
    bad = ledger.bad_transitions(_events(spark, d), "user_id", "event_type", ["ts", "event_id"], allowed)
    return bad.groupBy(F.col("previous").alias("from_state"), F.col("event_type").alias("to_state")).agg(F.count("*").alias("n_bad"))


@R.query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_state, count(*) FILTER (event_type = 'error') AS n_opened, arg_max(event_type, (ts, event_id)) = 'error' AS is_open FROM events GROUP BY 1""")
def issue_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return _events(spark, d).groupBy("user_id").agg(last.alias("last_state"), F.count_if(F.col("event_type") == "error").alias("n_opened"), (last == "error").alias("is_open"))


@R.query("""SELECT DISTINCT page_cleaning_run_id FROM page_cleaning_runs WHERE page_cleaning_run_id NOT IN (SELECT supersedes_run_id FROM page_cleaning_runs WHERE supersedes_run_id IS NOT NULL)""")
def current_facts(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "page_cleaning_runs").select("page_cleaning_run_id", "supersedes_run_id")
    return ledger.current_facts(runs, "page_cleaning_run_id", "supersedes_run_id").select("page_cleaning_run_id").distinct()


@R.query("""SELECT event_id, CASE WHEN h.user_id IS NULL THEN 'unknown' WHEN e.event_type IS NOT DISTINCT FROM h.t THEN 'accepted' ELSE 'conflict' END AS verdict FROM (SELECT * FROM events WHERE event_id >= 5000) e
LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t FROM events WHERE event_id < 5000 GROUP BY 1) h ON e.user_id = h.user_id""")
def cas_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    state = ledger.latest_per_key(rows.where("event_id < 5000"), ["user_id"], ["ts", "event_id"])
    return ledger.compare_and_set(rows.where("event_id >= 5000"), state, "user_id", "event_type", "event_type").select("event_id", "verdict")


def upserted(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """``c_custkey, label``: every customer's segment or, where there are orders of that key, the priority of the last one."""
    base = customers.select("c_custkey", F.lit(0).cast("long").alias("at"), F.col("c_mktsegment").alias("label"))
    changes = orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("label"))
    return ledger.upsert_latest(base, changes, ["c_custkey"], "at").select("c_custkey", "label")


@R.query("""SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NULL THEN c_mktsegment ELSE p END AS label
FROM customer FULL JOIN (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) ON c_custkey = k""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """All orders upserted into all customers."""
    return upserted(table(spark, d, "customer"), table(spark, d, "orders"))


@R.query("""SELECT i.artifact_id, CASE WHEN b.artifact_id IS NULL THEN 'inserted' WHEN i.storage_state IS NOT DISTINCT FROM b.s THEN 'same' ELSE 'mismatch' END AS outcome
FROM (SELECT DISTINCT artifact_id, storage_state FROM processing_artifacts WHERE updated_at >= TIMESTAMP '2025-06-01') i LEFT JOIN (SELECT artifact_id, arg_max(storage_state, updated_at) AS s FROM processing_artifacts WHERE updated_at < TIMESTAMP '2025-06-01' GROUP BY 1) b USING (artifact_id)""")
def insert_or_verify(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processing_artifacts").select("artifact_id", "storage_state", "updated_at")
    cut = F.expr("timestamp_ntz '2025-06-01'")
    base = ledger.latest_per_key(rows.where(F.col("updated_at") < cut), ["artifact_id"], ["updated_at"])
    return ledger.insert_or_verify(base, rows.where(F.col("updated_at") >= cut), "artifact_id", ["storage_state"])


@R.query("""SELECT idempotency_key, arg_min(status, (loaded_at, status)) AS first_payload, count(*) AS n_deliveries, count(DISTINCT status) > 1 AS conflicting FROM page_cleaning_runs GROUP BY 1""")
def idempotent_replay(spark: SparkSession, d: str) -> DataFrame:
    return ledger.idempotent_replay(table(spark, d, "page_cleaning_runs").select("idempotency_key", "status", "loaded_at"), "idempotency_key", F.col("status"), ["loaded_at", "status"])


@R.query("""WITH now AS (SELECT page_id, arg_max(source_hash, (loaded_at, page_cleaning_run_id)) AS h FROM page_cleaning_runs WHERE loaded_at >= TIMESTAMP '2025-06-01' GROUP BY 1)
SELECT DISTINCT r.page_cleaning_run_id, CASE WHEN now.page_id IS NULL THEN 'gone' WHEN now.h IS NOT DISTINCT FROM r.source_hash THEN 'current' ELSE 'stale' END AS status FROM page_cleaning_runs r LEFT JOIN now USING (page_id) WHERE r.loaded_at < TIMESTAMP '2025-06-01'""")
def stale_propagation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page_cleaning_runs").select("page_cleaning_run_id", "page_id", "source_hash", "loaded_at")
    cut = F.expr("timestamp_ntz '2025-06-01'")
    now = ledger.latest_per_key(rows.where(F.col("loaded_at") >= cut), ["page_id"], ["loaded_at", "page_cleaning_run_id"])
    held = ledger.pointer_join(rows.where(F.col("loaded_at") < cut), now.select("page_id", "source_hash"), {"page_id": "page_id"}, "now_")
    status = F.when(F.col("now_page_id").isNull(), "gone").when(F.col("now_source_hash").eqNullSafe(F.col("source_hash")), "current").otherwise("stale")
    return held.select("page_cleaning_run_id", status.alias("status")).distinct()


@R.query("""SELECT user_id, max(n) AS n_attempts, count(*) FILTER (n > 3) AS n_over FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') GROUP BY 1""")
def retry_budget(spark: SparkSession, d: str) -> DataFrame:
    tried = ledger.attempts(_events(spark, d).where("event_type = 'error'"), "user_id", ["ts", "event_id"], 3)
    return tried.groupBy("user_id").agg(F.max("attempt_number").alias("n_attempts"), F.count_if("over_budget").alias("n_over"))


@R.query("""SELECT fixture_id, CAST(sum(CASE WHEN attempt = 'first' THEN latency_ms END) AS BIGINT) AS first_ms, CAST(sum(CASE WHEN attempt = 'repair' THEN latency_ms END) AS BIGINT) AS repair_ms, CAST(sum(latency_ms) AS BIGINT) AS total_ms
FROM (SELECT DISTINCT translation_id, fixture_id, attempt, latency_ms FROM translations) GROUP BY 1""")
def repair_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translations").select("translation_id", "fixture_id", "attempt", "latency_ms").distinct()
    sums = rows.groupBy("fixture_id").pivot("attempt", ["first", "repair"]).agg(F.sum("latency_ms"))
    return sums.select("fixture_id", F.col("first").alias("first_ms"), F.col("repair").alias("repair_ms"), exprs.optional_sum(F.col("first"), F.col("repair")).alias("total_ms"))


@R.query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM level_ratings WHERE doc_id IS NOT NULL)")
def incremental_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return ledger.unseen(table(spark, d, "documents"), table(spark, d, "level_ratings"), ["doc_id"]).select("doc_id")


@R.query("""SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ';' ORDER BY l_linenumber, l_partkey, l_returnflag), '') AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def nested_recovery_view(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("s"))
    joined = table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x.l_linenumber.cast("string"), x.l_partkey.cast("string"), x.l_returnflag)), ";")
    return joined.select("o_orderkey", F.coalesce(text, F.lit("")).alias("lines"))


@R.query("""SELECT asset_id, region_id, row_number() OVER (PARTITION BY asset_id ORDER BY CASE WHEN direction = 'vertical' THEN -bbox.x ELSE bbox.y END, CASE WHEN direction = 'vertical' THEN bbox.y ELSE bbox.x END, region_id) AS reading_order FROM evaluation_regions""")
def orientation_sort(spark: SparkSession, d: str) -> DataFrame:
    vertical = F.col("direction") == "vertical"
    w = Window.partitionBy("asset_id").orderBy(F.when(vertical, -F.col("bbox.x")).otherwise(F.col("bbox.y")), F.when(vertical, F.col("bbox.y")).otherwise(F.col("bbox.x")), "region_id")
    return table(spark, d, "evaluation_regions").select("asset_id", "region_id", F.row_number().over(w).alias("reading_order"))


@R.query("""SELECT project_id, run_id, row_number() OVER (PARTITION BY project_id ORDER BY CAST(regexp_extract(run_id, '([0-9]+)', 1) AS BIGINT), run_id) AS place FROM (SELECT DISTINCT project_id, 'run-' || CAST(regexp_extract(run_id, '([0-9]+)', 1) AS BIGINT) AS run_id FROM stage_timings)""")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    short = F.concat(F.lit("run-"), F.regexp_extract("run_id", "([0-9]+)", 1).cast("long").cast("string"))
    runs = table(spark, d, "stage_timings").select("project_id", short.alias("run_id")).distinct()
    return runs.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(exprs.natural_key(F.col("run_id")), "run_id")))


@R.query("""WITH g AS (SELECT asset_id, list([{id: region_id, y: bbox.y, h: bbox.height, seg: 0}] ORDER BY bbox.y, region_id) AS rows FROM evaluation_regions GROUP BY 1),
s AS (SELECT asset_id, list_reduce(rows, lambda acc, x: list_append(acc, {id: x[1].id, y: x[1].y, h: x[1].h, seg: acc[-1].seg + CASE WHEN
  abs(x[1].y - list_median(list_transform(list_filter(acc, lambda k: k.seg = acc[-1].seg), lambda k: k.y))) > greatest(48, 0.65::DOUBLE * list_median(list_transform(list_filter(acc, lambda k: k.seg = acc[-1].seg), lambda k: k.h))) THEN 1 ELSE 0 END})) AS done FROM g)
SELECT asset_id, r.id AS region_id, r.seg AS segment FROM (SELECT asset_id, unnest(done) AS r FROM s)""")
def jump_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of an asset's regions from top to bottom."""
    rows = table(spark, d, "evaluation_regions").select("asset_id", "region_id", F.col("bbox.y").alias("y"), F.col("bbox.height").alias("h"))

    def body(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["y", "region_id"])
        return pd.DataFrame({"asset_id": g["asset_id"], "region_id": g["region_id"], "segment": sequence.jump_segments(g["y"].tolist(), g["h"].tolist())})

    return sequence.by_group(rows, "asset_id", body, "asset_id string, region_id string, segment int")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bbox")
    return table(spark, d, "fragments").select(F.col("asset_id").alias("page"), F.col("fragment_id").alias("id"), b.x.alias("x"), b.y.alias("y"), b.width.alias("w"), b.height.alias("h")).distinct()


@R.query("""WITH b AS (SELECT DISTINCT asset_id AS page, fragment_id AS id, bbox.x AS x, bbox.y AS y, bbox.width AS w, bbox.height AS h FROM fragments),
g AS (SELECT page, list([{id: id, x: x::DOUBLE, y: y::DOUBLE, w: w::DOUBLE, h: h::DOUBLE}] ORDER BY sha256(id), id) AS rows FROM b GROUP BY 1),
k AS (SELECT page, list_reduce(rows, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k:
  greatest(0, least(k.x + k.w, x[1].x + x[1].w) - greatest(k.x, x[1].x)) * greatest(0, least(k.y + k.h, x[1].y + x[1].h) - greatest(k.y, x[1].y)) >= 0.85::DOUBLE * (k.w * k.h + x[1].w * x[1].h
  - greatest(0, least(k.x + k.w, x[1].x + x[1].w) - greatest(k.x, x[1].x)) * greatest(0, least(k.y + k.h, x[1].y + x[1].h) - greatest(k.y, x[1].y)))
  AND k.w * k.h + x[1].w * x[1].h > 0)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM g)
SELECT page, r.id AS id FROM (SELECT page, unnest(kept) AS r FROM k)""")
def greedy_nms(spark: SparkSession, d: str) -> DataFrame:
    """Readings of a page kept in stable hash order when each is dropped that overlaps an earlier kept one by 0.85."""
    return kept_readings(_boxes(spark, d))


def kept_readings(boxes: DataFrame, limit: float = 0.85, hot_rows: int = HOT_PAGE) -> DataFrame:
    """``page, id`` of the boxes kept; pages of more than ``hot_rows`` boxes are never one task (see ``pairs.boxes_kept``)."""

    def body(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["order", "id"])
        return g.loc[sequence.greedy_keep(g[["x", "y", "w", "h"]].to_numpy("float64"), limit), ["page", "id"]]

    hot = sequence.hot_keys(boxes, "page", hot_rows)
    ordinary = boxes if hot is None else boxes.join(hot, F.col("page").eqNullSafe(F.col("q_hot")), "left_anti")
    kept = sequence.by_group(ordinary.withColumn("order", F.sha2("id", 256)), "page", body, "page string, id string")
    return kept if hot is None else kept.unionByName(pairs.boxes_kept(boxes.join(hot, F.col("page").eqNullSafe(F.col("q_hot")), "left_semi"), limit))


def distinct_vectors(rows: DataFrame, limit: int, chunk_rows: int = sequence.CHUNK_ROWS) -> DataFrame:
    """``label, vec_id`` of ``rows(vec_id, label, high, low)`` kept in stable hash order within a label when each is dropped
    whose signature is at most ``limit`` bits from an earlier kept one.

    Vectors of one signature stand under their first, which decides for all; a null label is a label, and vectors without
    a signature are all kept.
    """
    order = F.concat(F.sha2(F.col("vec_id").cast("string"), 256), F.lpad(F.hex("high"), 8, "0"), F.lpad(F.hex("low"), 8, "0"))
    whole = F.col("high").isNotNull() & F.col("low").isNotNull()
    node = F.concat(order, F.lit("="), F.coalesce(F.col("label").cast("string"), F.lit("")), F.when(F.col("label").isNull(), "?").otherwise(""))
    bits = F.shiftleft("high", 32).bitwiseOR(F.col("low"))
    classes = rows.where(whole).groupBy("label", "high", "low").agg(F.min(F.struct(order.alias("o"), "vec_id"))["vec_id"].alias("vec_id"))
    nodes = classes.select("label", "vec_id", node.alias("node"), bits.alias("bits"))
    dropped = sequence.greedy_dropped(sequence.hamming_pairs(nodes, "label", limit, chunk_rows)).withColumnRenamed("node", "gone")
    kept = nodes.join(dropped, F.col("node") == F.col("gone"), "left_anti").select("label", "vec_id")
    return kept.unionByName(rows.where(~whole).select("label", "vec_id"))


@R.query("""WITH v AS (SELECT vec_id, label, list_transform(embedding[1:64], lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT vec_id, label, list_transform(e, lambda x: x > m) AS bits FROM (SELECT *, list_median(e) AS m FROM v)),
g AS (SELECT label, list([{id: vec_id, bits: bits}] ORDER BY sha256(vec_id::VARCHAR)) AS rows FROM s GROUP BY 1),
k AS (SELECT label, list_reduce(rows, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: len(list_filter(list_zip(k.bits, x[1].bits), lambda z: z[1] <> z[2])) <= 16)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM g)
SELECT label, r.id AS vec_id FROM (SELECT label, unnest(kept) AS r FROM k)""")
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a label kept in stable hash order when each is dropped whose signature is at most 16 bits from an earlier kept one."""
    return distinct_vectors(table(spark, d, "embeddings").select("vec_id", "label", *signature_words()), 16)


# The dynamic program row by row: a cell is its score and the steps that lead to it (D: both, U: a region alone, L: a reading alone).
@R.query("""WITH u AS (SELECT asset_id, 0 AS side, region_id AS id, bbox.y AS y, bbox.height AS h FROM evaluation_regions UNION ALL (SELECT DISTINCT asset_id, 1, fragment_id, bbox.y, bbox.height FROM fragments)),
g AS (SELECT asset_id, coalesce(list({id: id, y: y, h: h} ORDER BY y, id) FILTER (side = 0), []) AS a, coalesce(list({id: id, y: y, h: h} ORDER BY y, id) FILTER (side = 1), []) AS b FROM u GROUP BY 1),
m AS (SELECT asset_id, a, b, list_concat([list_transform(range(0, len(b) + 1), lambda j: {s: -0.22::DOUBLE * j, p: repeat('L', j)})],
  list_transform(range(1, len(a) + 1), lambda i: list_concat([{s: -0.22::DOUBLE * i, p: repeat('U', i)}], list_transform(b, lambda r: {s: 1 - (abs(a[i].y - r.y)::DOUBLE / 50 + abs(a[i].h - r.h)::DOUBLE / 50), p: ''})))) AS rows FROM g),
d AS (SELECT asset_id, a, b, list_reduce(rows, lambda prev, row: list_reduce(list_transform(row, lambda c: [c]), lambda acc, x: list_append(acc, CASE
  WHEN prev[len(acc)].s + x[1].s >= greatest(prev[len(acc) + 1].s, acc[len(acc)].s) + -0.22::DOUBLE THEN {s: prev[len(acc)].s + x[1].s, p: prev[len(acc)].p || 'D'}
  WHEN prev[len(acc) + 1].s >= acc[len(acc)].s THEN {s: prev[len(acc) + 1].s + -0.22::DOUBLE, p: prev[len(acc) + 1].p || 'U'} ELSE {s: acc[len(acc)].s + -0.22::DOUBLE, p: acc[len(acc)].p || 'L'} END))) AS last FROM m),
p AS (SELECT asset_id, a, b, last[-1].p AS path, unnest(range(1, length(last[-1].p) + 1)) AS k FROM d)
SELECT asset_id, CASE WHEN path[k] <> 'L' THEN a[k - length(replace(replace(left(path, k), 'D', ''), 'U', ''))].id END AS region_id, CASE WHEN path[k] <> 'U' THEN b[k - length(replace(replace(left(path, k), 'D', ''), 'L', ''))].id END AS fragment_id FROM p""")
def monotonic_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Regions of an asset aligned in reading order with its first readings, by likeness of height and position."""
    regions = table(spark, d, "evaluation_regions").select("asset_id", F.lit(0).alias("side"), F.col("region_id").alias("id"), F.col("bbox.y").alias("y"), F.col("bbox.height").alias("h"))
    reads = table(spark, d, "fragments").select("asset_id", F.lit(1).alias("side"), F.col("fragment_id").alias("id"), F.col("bbox.y").alias("y"), F.col("bbox.height").alias("h")).distinct()

    def body(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["y", "id"])
        a, b = g[g["side"] == 0], g[g["side"] == 1]
        far = np.abs(a["y"].to_numpy("float64")[:, None] - b["y"].to_numpy("float64")) / 50 + np.abs(a["h"].to_numpy("float64")[:, None] - b["h"].to_numpy("float64")) / 50
        steps = sequence.monotonic_alignment(1 - far)
        pick = lambda side, i: None if i is None else side["id"].iloc[i]
        return pd.DataFrame([(g["asset_id"].iloc[0], pick(a, i), pick(b, j)) for i, j in steps], columns=["asset_id", "region_id", "fragment_id"])

    return sequence.by_group(regions.unionByName(reads), "asset_id", body, "asset_id string, region_id string, fragment_id string")


@R.query("""SELECT a.o_custkey, count(*) AS n_pairs, min(abs(a.c - b.c)) AS least, max(abs(a.c - b.c)) AS most, CAST(sum(abs(a.c - b.c)) AS BIGINT) AS total FROM (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders WHERE o_orderstatus = 'F') a
JOIN (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders WHERE o_orderstatus = 'O') b ON a.o_custkey = b.o_custkey GROUP BY 1""")
def complete_linkage_score(spark: SparkSession, d: str) -> DataFrame:
    """Least, greatest and total distance between the members of two groups, without the pairs: the least lies between neighbours
    in order, the greatest between the ends, and the sum follows from running sums."""
    rows = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')").select("o_custkey", money("o_totalprice").alias("c"), (F.col("o_orderstatus") == "F").alias("one"))
    w = Window.partitionBy("o_custkey").orderBy("c", "one")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_a, last_b = F.max(F.when(F.col("one"), F.col("c"))).over(before), F.max(F.when(~F.col("one"), F.col("c"))).over(before)
    n_other = F.coalesce(F.when(F.col("one"), F.count_if(~F.col("one")).over(before)).otherwise(F.count_if("one").over(before)), F.lit(0))
    s_other = F.coalesce(F.when(F.col("one"), F.sum(F.when(~F.col("one"), F.col("c"))).over(before)).otherwise(F.sum(F.when(F.col("one"), F.col("c"))).over(before)), F.lit(0))
    steps = rows.select("o_custkey", "c", "one", (F.col("c") - F.when(F.col("one"), last_b).otherwise(last_a)).alias("step"), (F.col("c") * n_other - s_other).alias("part"))
    hi = lambda one: F.max(F.when(F.col("one") == one, F.col("c")))
    lo = lambda one: F.min(F.when(F.col("one") == one, F.col("c")))
    sums = steps.groupBy("o_custkey").agg(
        (F.count_if("one") * F.count_if(~F.col("one"))).alias("n_pairs"), F.min("step").alias("least"), F.greatest(hi(True) - lo(False), hi(False) - lo(True)).alias("most"), F.sum("part").alias("total")
    )
    return sums.where("n_pairs > 0")
