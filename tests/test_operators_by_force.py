"""Operators against plain counting on small cases: ranks, signatures, keys of JSON, fences, boxes of every size."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quire.functions import exprs, text
from quire.operators import evaluate, graph, pairs, reconcile
from quire.plans import matching, sequences

rng = random.Random(23)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [10**6, 20])
def test_exact_percentiles_of_hot_and_ordinary_keys(spark, hot):
    data = [("hot", rng.randrange(200)) for _ in range(900)] + [(k, rng.choice([1, 1, 2, 7])) for k in ("a", None) for _ in range(9)] + [("n", None), ("one", 5)]
    df = spark.createDataFrame(data, "k string, v int")
    by = {}
    for k, v in data:
        if v is not None:
            by.setdefault(k, []).append(v)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    want = [(k, *[sorted(v)[max(0, math.ceil(q * len(v)) - 1)] for q in shares.values()]) for k, v in by.items()]
    assert rows(evaluate.exact_percentiles(df, ["k"], "v", shares, hot)) == sorted(want, key=repr)
    assert rows(evaluate.exact_medians(df, ["k"], "v", hot)) == sorted([(k, float(statistics.median(v))) for k, v in by.items()], key=repr)
    assert rows(evaluate.exact_percentiles(df.limit(0), ["k"], "v", shares)) == []
    assert rows(evaluate.exact_medians(spark.createDataFrame([(1.0,), (float("nan"),), (4.0,)], "v double"), [], "v")) == [(2.5,)]


def test_near_signatures_find_every_pair(spark):
    base = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    sigs = []
    for i in range(150):
        s = rng.choice(base)
        for b in rng.sample(range(64), rng.choice([0, 1, 3, 4, 7, 8])):
            s ^= 1 << b
        sigs.append((i, s >> 32, s & 0xFFFFFFFF))
    first = {}
    for i, h, lo in sigs:
        first.setdefault((h << 32) | lo, i)
    want = [(min(a, b), max(a, b), (x ^ y).bit_count()) for x, a in first.items() for y, b in first.items() if a < b and (x ^ y).bit_count() <= 7]
    df = spark.createDataFrame([*sigs, (900, None, 1)], "vec_id long, high long, low long")
    assert want and rows(matching.near_signatures(df)) == sorted(want, key=repr)


JSONS = ['{"a": {"score": 1, "b": [{"x:y": "no\\"key\\": 1", "c": "d"}]}}', '[]', '{"q\\"t": {"u\\u0065": null}}', None, '"just: text"', '{"a" : "b:", "a2":{"a":1}}']


def keys_of(x):
    if isinstance(x, dict):
        return set(x) | {k for v in x.values() for k in keys_of(v)}
    return {k for v in x for k in keys_of(v)} if isinstance(x, list) else set()


def test_keys_of_json_at_any_depth(spark):
    got = spark.createDataFrame([(i, j) for i, j in enumerate(JSONS)], "i int, j string").select("i", text.json_keys(F.col("j")).alias("k"))
    assert {r["i"]: None if r["k"] is None else set(r["k"]) for r in got.collect()} == {i: None if j is None else keys_of(json.loads(j)) for i, j in enumerate(JSONS)}


def test_fences(spark):
    cases = [("```json\n{}\n```", "{}"), (" ```\nx ``` y\n```\n", "x ``` y"), ("``````", ""), ("````", "````"), ("```a", "```a"), ("plain", "plain"), (None, None), ("```JSON x```", "x"), ("", "")]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", text.unfenced(F.col("t")).alias("u"))
    assert {r["i"]: r["u"] for r in got.collect()} == {i: c[1] for i, c in enumerate(cases)}


def test_boxes_of_every_size_meet(spark):
    boxes = [("p", f"b{i:03d}", rng.randrange(-50, 3000), rng.randrange(-50, 3000), w, h) for i in range(90) for w, h in [(rng.choice([0, 1, 20, 63, 64, 65, 700, 100_000]), rng.choice([0, 5, 64, 129, 2500]))]]
    boxes += [("q", "b000", 0, 0, 10, 10), ("p", "null", None, 1, 2, 3)]
    df = spark.createDataFrame(boxes, "page string, id string, x int, y int, w int, h int")

    def gap2(a, b):
        dx, dy = max(0, max(a[2], b[2]) - min(a[2] + a[4], b[2] + b[4])), max(0, max(a[3], b[3]) - min(a[3] + a[5], b[3] + b[5]))
        return dx * dx + dy * dy

    known = [b for b in boxes if b[2] is not None]
    want = [(a[1], b[1]) for a in known for b in known if a[0] == b[0] and a[1] < b[1] and gap2(a, b) <= 900]
    assert rows(pairs.near_pairs(df, 30).select("a_id", "b_id")) == sorted(want)
    assert pairs.near_pairs(df.limit(0), 30).count() == 0


def test_reach_over_long_paths_or_an_error(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(8)], "a string, b string, cost double")
    seeds = spark.createDataFrame([("n00", "s")], "node string, owner string")
    assert max(r["cost"] for r in graph.multi_source_reach(edges, seeds, 100.0).collect()) == 8.0
    with pytest.raises(RuntimeError):
        graph.multi_source_reach(edges, seeds, 100.0, most_rounds=3)


def test_half_even_rounding_is_that_of_exact_values(spark):
    values = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 0.0, 1e-9, 12345.6785, 0.5, 1.5, 2.5] + [rng.randrange(-10**6, 10**6) / 2000 for _ in range(400)] + [rng.uniform(-50, 50) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v double")
    for places in (0, 2, 3):
        got = {r["i"]: r["r"] for r in df.select("i", exprs.half_even(F.col("v"), places).alias("r")).collect()}
        assert got == {i: round(v, places) for i, v in enumerate(values)} | {-1: None}


def test_names_and_times_as_text(spark):
    df = spark.createDataFrame([("a/b c.png", "2025-01-02 03:04:05.6"), ("漢字-é_1", None), ("", "1999-12-31 23:59:59")], "n string, t string").select("n", F.to_timestamp_ntz("t").alias("t"))
    got = rows(df.select(exprs.safe_name(F.col("n")), exprs.utc_text(F.col("t"))))
    assert got == sorted([("a_b_c_png", "2025-01-02T03:04:05.600000+00:00"), ("漢字-é_1", None), ("", "1999-12-31T23:59:59.000000+00:00")], key=repr)


def test_widest_paths_against_all_paths(spark):
    from itertools import permutations

    edges = {(a, b): rng.randrange(1, 9) for a in range(6) for b in range(a + 1, 6) if rng.random() < 0.5} | {(10, 11): 3}
    cap = {**edges, **{(b, a): c for (a, b), c in edges.items()}}
    want = []
    for s in (0, 2):
        for t in {x for e in edges for x in e} - {s}:
            paths = [(s, *mid, t) for k in range(5) for mid in permutations(set(range(6)) - {s, t}, k)]
            widths = [min(cap[p] for p in zip(x, x[1:])) for x in paths if all(p in cap for p in zip(x, x[1:]))]
            if widths:
                want.append((t, s, max(widths)))
    df = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()] + [(1, 1, 99), (None, 2, 9)], "a int, b int, capacity int")
    sources = spark.createDataFrame([(0,), (2,), (2,), (None,)], "source int")
    assert rows(graph.widest_paths(df, sources)) == sorted(want, key=repr)
    assert graph.widest_paths(df.limit(0), sources).count() == 0
    with pytest.raises(RuntimeError):
        graph.widest_paths(spark.createDataFrame([(i, i + 1, 1) for i in range(6)], "a int, b int, capacity int"), sources, most_rounds=2)


def test_dispositions_and_drift(spark):
    cases = [(1, "PRODUCED", False, False, False, None), (2, "PRODUCED", True, None, None, "produced_with_unresolved_blocker"), (3, "PRODUCED", None, True, None, "produced_with_unresolved_blocker"), (4, "INCOMPLETE", True, False, True, None),
             (5, "INCOMPLETE", True, None, None, "incomplete_without_evidence"), (6, "INCOMPLETE", False, None, True, "incomplete_without_evidence"), (7, "DONE", False, False, False, "invalid_disposition"), (8, None, None, None, None, "invalid_disposition")]
    df = spark.createDataFrame([c[:5] for c in cases], "i int, d string, u boolean, p boolean, e boolean")
    found = reconcile.disposition_findings(df, "d", F.col("u"), F.col("p"), F.col("e"))
    assert {r["i"]: r["finding"] for r in found.collect()} == {c[0]: c[5] for c in cases}
    log = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", None, 1)], "k string, v string, t int")
    assert {r["k"]: (r["n_deliveries"], r["n_drifted"]) for r in reconcile.fingerprint_drift(log, "k", ["v"], "t").collect()} == {"a": (3, 1), "b": (1, 0)}


def test_hot_pages_keep_the_same_boxes(spark):
    data = [("p", f"b{i:03d}", rng.randrange(0, 60), rng.randrange(0, 60), rng.choice([0, 40, 41, 42]), rng.choice([30, 31])) for i in range(160)]
    data += [("p", f"c{i}", *data[i][2:]) for i in range(30)] + [("q", "b000", 1, 1, 9, 9), ("q", "b001", 1, 1, 9, 9), ("q", "z", 5, 5, 0, 0)]
    df = spark.createDataFrame(data, "page string, id string, x int, y int, w int, h int")
    want = rows(sequences.kept_readings(df))
    assert rows(sequences.kept_readings(df, hot_rows=100)) == rows(sequences.kept_readings(df, hot_rows=1)) == want and len(want) < len(data)
