import random
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import exprs, text
from quire.operators import evaluate, graph, ledger, pairs, reconcile, selection, sequence

rng = random.Random(8)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ledger_of_nulls_ties_and_clashes(spark):
    base = spark.createDataFrame([("a", 1, "x", "c"), ("a", 2, None, "c"), (None, 5, "n", "c"), (None, 4, "m", "c")], "k string, v int, p string, held_key string")
    assert rows(ledger.latest_per_key(base, ["k"], ["v"])) == [("a", 2, None, "c"), (None, 5, "n", "c")]
    assert rows(ledger.first_per_key(base.select("k", "v", "p"), ["k"], ["v"])) == [("a", 1, "x"), (None, 4, "m")]
    assert ledger.latest_per_key(base.limit(0), ["k"], ["v"]).count() == 0
    owners = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert rows(ledger.next_versions(owners, base, "k", F.col("v"))) == [("a", 3), ("b", 1)]
    assert rows(ledger.counted(owners.distinct(), base, "k", "k", "n")) == [("a", 2), ("b", 0)]
    assert rows(ledger.all_or_nothing(base, "k", F.col("p").isNotNull())) == [(None, 2)]
    commands = spark.createDataFrame([("a", None), ("a", "x"), ("z", "x"), (None, "n")], "k string, e string")
    verdicts = ledger.compare_and_set(commands, ledger.latest_per_key(base, ["k"], ["v"]), "k", "e", "p")
    assert rows(verdicts) == [("a", "x", "conflict"), ("a", None, "accepted"), ("z", "x", "unknown"), (None, "n", "unknown")]
    incoming = spark.createDataFrame([("a", "x"), ("a", None), ("q", "x")], "k string, p string")
    assert rows(ledger.insert_or_verify(base.where("v = 1"), incoming, "k", ["p"])) == [("a", "mismatch"), ("a", "same"), ("q", "inserted")]
    assert rows(ledger.unseen(owners, base, ["k"])) == [("b",), ("b",)]
    assert rows(ledger.upsert_latest(base.select("k", "v").where("v = 1"), spark.createDataFrame([("a", 0), ("c", 1)], "k string, v int"), ["k"], "v")) == [("a", 0), ("c", 1)]
    facts = spark.createDataFrame([("f1", None), ("f2", "f1"), ("f3", "f2")], "f string, s string")
    assert rows(ledger.current_facts(facts, "f", "s").select("f")) == [("f3",)]
    now = spark.createDataFrame([("a", "h1"), ("b", None)], "k string, d string")
    recorded = spark.createDataFrame([("a", "h0"), ("a", "h1"), ("b", None), ("c", "h")], "k string, d string")
    assert rows(ledger.stale_dependents(now, recorded, "k", "d")) == [("a", "current"), ("a", "stale"), ("b", "current"), ("c", "gone")]
    tried = ledger.attempts(base.select("k", "v"), "k", ["v"], 1)
    assert rows(tried.where("over_budget").select("k", "v")) == [("a", 2), (None, 5)]


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "e"), (2, "e"), (2, "e"), (None, "e")], "k int, side string")
    b = spark.createDataFrame([(2, 0), (3, 0), (None, 0)], "k int, lo int")
    assert rows(reconcile.set_reconcile(a, b, ["k"])) == [(1, "missing"), (2, "matched"), (3, "extra"), (None, "matched")]
    assert rows(reconcile.duplicate_keys(a, ["k"])) == [(2, 2)]
    assert rows(reconcile.dangling(a.select("k"), "k", b, "k")) == [(1,)]
    assert rows(reconcile.exact_cover(a.where("k is not null"), spark.createDataFrame([(2,), (2,), (9,)], "x int"), "k", "x")) == [(1, 0, "missing"), (2, 2, "repeated"), (9, 1, "foreign")]
    found = reconcile.findings([("r", "error", a, F.col("k")), ("r", "error", a, F.col("k")), ("s", "warning", b.limit(0), F.col("k"))])
    assert found.count() == 3
    lines = spark.createDataFrame([(g, x) for g in "ab" for x in ["p", "q", "q"]] + [("c", "p"), ("c", "q")], "g string, x string")
    prints = {r["g"]: r["fingerprint"] for r in reconcile.group_fingerprint(lines.repartition(5), ["g"], F.col("x")).collect()}
    assert prints["a"] == prints["b"] != prints["c"]


def test_expressions(spark):
    df = spark.createDataFrame([(1, None, "p10"), (2, 2, "p2"), (None, None, "P1")], "a int, b int, t string")
    got = df.select(
        exprs.mismatches([("ab", F.col("a"), F.col("b")), ("aa", F.col("a"), F.col("a"))]).alias("m"), exprs.optional_sum(F.col("a"), F.col("b")).alias("s"), exprs.safe_rate(F.col("a"), F.lit(0)).alias("r"),
        exprs.first_rule([(F.col("a") > 1, "big"), (F.col("b").isNull(), "none")], "x").alias("f"), exprs.canonical_text([("b", F.col("b")), ("a", F.col("a"))]).alias("c"),
    ).collect()
    assert [tuple(r) for r in got] == [(["ab"], 1, 0.0, "none", '{"a":"1","b":null}'), ([], 4, 0.0, "big", '{"a":"2","b":"2"}'), ([], None, 0.0, "none", '{"a":null,"b":null}')]
    assert [r["t"] for r in df.orderBy(exprs.natural_key(F.col("t"))).collect()] == ["P1", "p2", "p10"]
    worst = df.groupBy().agg(exprs.worst_of(F.col("t"), ["p2", "p10"]).alias("w"), exprs.worst_of(F.col("t"), ["zz"]).alias("n")).first()
    assert tuple(worst) == ("p2", None)


def test_text(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "x"), ("", None), ("äö", "aö"), ("ab", "")], "a string, b string")
    assert [r[0] for r in df.select(text.error_rate(F.col("a"), F.col("b"))).collect()] == pytest.approx([1 / 3, 1.0, 0.0, 0.5, 1.0])
    fenced = spark.createDataFrame([("```json\n{}\n```",), ("``` x ```",), ("plain",)], "t string")
    assert [r[0] for r in fenced.select(text.unfenced(F.col("t"))).collect()] == ["{}", "x", "plain"]
    assert [r[0] for r in df.select(text.charset_overlap(F.col("a"), F.col("b"))).collect()] == [2 / 3, None, None, 0.5, 0.0]


def boxes_of(n, pages=3, size=200):
    return [(f"p{rng.randrange(pages)}", f"b{i:03d}", rng.randrange(-20, size), rng.randrange(size), rng.randrange(1, 60), rng.randrange(1, 90)) for i in range(n)]


def gap2(a, b):
    dx = max(0, max(a[2], b[2]) - min(a[2] + a[4], b[2] + b[4]))
    dy = max(0, max(a[3], b[3]) - min(a[3] + a[5], b[3] + b[5]))
    return dx * dx + dy * dy


@pytest.mark.parametrize("cell", [16, 64, 1000])
def test_pairs_against_all_pairs(spark, cell):
    held = boxes_of(70)
    df = spark.createDataFrame([(*b, "clash") for b in held], "page string, id string, x int, y int, w int, h int, a_id string")
    want = sorted((a[1], b[1], gap2(a, b)) for a, b in product(held, held) if a[0] == b[0] and a[1] < b[1] and gap2(a, b) <= 900)
    got = pairs.near_pairs(df, 30, cell)
    assert rows(got.select("a_id", "b_id", "gap2")) == want
    near = {}
    for a in held:
        options = [(gap2(a, b), b[1]) for b in held if a[0] == b[0] and a[1] != b[1] and gap2(a, b) <= 900]
        if options:
            near[a[1]] = min(options)
    assert {r["id"]: (r["gap2"], r["neighbour"]) for r in pairs.nearest_neighbours(df, 30, cell).collect()} == near
    mutual = {tuple(sorted((k, v[1]))) for k, v in near.items() if near.get(v[1], (0, None))[1] == k}
    found = pairs.mutual_pairs(df, 30, cell).collect()
    assert {(r["id"], r["partner"]) for r in found if r["partner"]} == mutual and len(found) == len(held) - len(mutual)
    assert pairs.near_pairs(df.limit(0), 30, cell).count() == 0


def test_components_and_reach(spark):
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900), (None, 1), (700, 701), (701, 700)] + [(1000, 1001 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        if start not in want:
            stack = [start]
            while stack:
                v = stack.pop()
                if v not in want:
                    want[v] = start
                    stack += near[v]
    assert got == want
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(10)] + [(20, 21, 1.0)], "a int, b int, cost double")
    reach = {r["node"]: (r["owner"], r["cost"], r["contested"]) for r in graph.multi_source_reach(line, spark.createDataFrame([(0, "l"), (10, "r")], "node int, owner string"), 5.0).collect()}
    assert reach == {i: ("l" if i <= 5 else "r", float(min(i, 10 - i)), i == 5) for i in range(11)}


def test_nearest_seed(spark):
    nodes, seeds = boxes_of(60), boxes_of(25)
    n = spark.createDataFrame([(b[1], b[0], b[2], b[3]) for b in nodes], "node string, page string, x int, y int")
    s = spark.createDataFrame([(b[1], b[0], b[2], b[3]) for b in seeds], "seed string, page string, x int, y int")
    want = {}
    for a in nodes:
        options = [((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, b[1]) for b in seeds if a[0] == b[0]]
        options = [o for o in options if o[0] <= 2500]
        if options:
            want[a[1]] = min(options)[::-1]
    assert {r["node"]: (r["seed"], r["distance_squared"]) for r in graph.nearest_seed(n, s, "page", "x", "y", 20, 50).collect()} == want


def test_sequences(spark):
    events = [(k, i, rng.choice(["a", "b", None])) for k in "xy" for i in range(30)]
    df = spark.createDataFrame(events, "k string, i int, v string")
    want = []
    for k in "xy":
        run, before = 0, object()
        for _, _, v in [e for e in events if e[0] == k]:
            run += v != before
            if v != before:
                want.append([k, run, v, 0])
            want[-1][3] += 1
            before = v
    assert rows(sequence.islands(df, "k", ["i"], "v")) == sorted(map(tuple, want), key=repr)
    sums = sequence.by_group(df.repartition(7), "k", lambda g: g.groupby("k", as_index=False)["i"].sum()[["k", "i"]], "k string, i long")
    assert rows(sums) == [("x", 435), ("y", 435)]
    first = sequence.first_where(df, "k", ["i"], F.col("v") == "zz", "v", "none")
    assert rows(first) == [("x", "none"), ("y", "none")]


def test_hot_keys_give_the_same_rows(spark):
    events = [(rng.choice(["h", "h", "h", "a", None]), i, rng.choice(["x", "y", None]), rng.randrange(3)) for i in range(400)]
    df = spark.createDataFrame([(*e, "clash") for e in events], "k string, i int, v string, n int, last string")
    hot = sequence.hot_keys(df, "k", 100)
    assert rows(hot) == [("h",)] and sequence.hot_keys(df, "k", 1000) is None
    for a, b in (
        (sequence.with_previous(df, "k", ["i"], ["v", "n"]), sequence.with_previous(df, "k", ["i"], ["v", "n"], hot)),
        (sequence.running_sum(df, "k", ["i"], F.col("n"), "s"), sequence.running_sum(df, "k", ["i"], F.col("n"), "s", hot)),
        (sequence.islands(df, "k", ["i"], "v"), sequence.islands(df, "k", ["i"], "v", hot_rows=50)),
        (ledger.attempts(df, "k", ["i"], 5), ledger.attempts(df, "k", ["i"], 5, hot_rows=50)),
        (ledger.transitions(df, "k", "v", ["i"]), ledger.transitions(df, "k", "v", ["i"], hot_rows=50)),
    ):
        assert rows(a) == rows(b)
    timed = df.select("k", "i", F.timestamp_seconds(F.col("i") * F.col("i")).alias("t"))
    assert rows(sequence.sessions(timed, "k", "t", 600)) == rows(sequence.sessions(timed, "k", "t", 600, hot_rows=50))


def test_alignment_and_segments():
    assert sequence.monotonic_alignment(np.array([[0.1, 0.9, 0.0], [0.0, 0.2, 0.8]])) == [(None, 0), (0, 1), (1, 2)]
    assert sequence.monotonic_alignment(np.zeros((0, 2))) == [(None, 0), (None, 1)]
    assert sequence.jump_segments([0, 10, 20, 300, 310], [30] * 5) == [0, 0, 0, 1, 1] and sequence.jump_segments([], []) == []
    assert sequence.greedy_keep(np.array([[0, 0, 10, 10], [0, 0, 10, 10], [50, 0, 10, 10], [0, 0, 0, 0]], float), 0.85).tolist() == [True, False, True, True]
    assert sequence.greedy_distinct([0, 1, 7, 0xFF00], 2) == [0, 2, 3]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 4), st.integers(0, 4), st.randoms(use_true_random=False))
def test_alignment_is_the_best(n, m, r):
    scores = np.array([[r.choice([0.0, 0.3, 0.7, 1.0]) for _ in range(m)] for _ in range(n)]).reshape(n, m)

    def best(i, j):
        if i == n or j == m:
            return -0.22 * (n - i + m - j)
        return max(scores[i, j] + best(i + 1, j + 1), -0.22 + best(i + 1, j), -0.22 + best(i, j + 1))

    steps = sequence.monotonic_alignment(scores)
    total = sum(-0.22 if None in s else scores[s] for s in steps)
    assert total == pytest.approx(best(0, 0))


def test_evaluation(spark):
    examples = [(rng.random(), rng.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame([*examples, (None, True)], "s double, p boolean")
    for r in evaluate.calibrate(df, "s", "p", [0.2, 0.5, 0.9]).collect():
        tp, fp = (sum(p is want and s >= r["threshold"] for s, p in examples) for want in (True, False))
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, sum(p for _, p in examples) - tp)
    grid = evaluate.confusion_matrix(df, F.when(F.col("p"), "y").otherwise("n"), F.lit("y"), ["y", "n"])
    assert {(r["actual"], r["predicted"]): r["n"] > 0 for r in grid.collect()} == {("y", "y"): True, ("n", "y"): True, ("y", "n"): False, ("n", "n"): False}
    a = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "C"), (5, "C"), (9, "D")], "i int, g string")
    b = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v"), (4, "v"), (5, "w"), (7, "x")], "i int, g string")
    judged = evaluate.judge_groups(evaluate.partition_overlaps(a, b, "i", "g"))
    assert {r["expected_group"]: r["outcome"] for r in judged.collect()} == {"A": "hit", "B": "merge", "C": "split_merge", "D": "miss"}
    values = [2] * 30 + [3] * 20 + [40] * 25 + [41] * 5
    assert evaluate.otsu_threshold(spark.createDataFrame([(v,) for v in values], "v int"), F.col("v")).first()["threshold_bin"] == 3


def test_selection(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else None, i % 10) for i in range(60)], "k int, g string, size int")
    taken = rows(selection.round_robin(df, "g", "k", 8, "s").groupBy("g").count())
    assert taken == [("a", 2), ("b", 2), ("c", 2), (None, 2)]
    water = selection.quota_waterfall(df, "k", [("x", F.col("size") == 1, 4), ("y", F.col("g") == "a", 5), ("z", F.lit(True), 3)], "s").collect()
    assert [r["bucket"] for r in water] == ["x"] * 4 + ["y"] * 5 + ["z"] * 3 and len({r["k"] for r in water}) == 12
    assert selection.hash_order_sample(df.limit(0), "g", "k", 2, "s").count() == 0


@pytest.mark.parametrize("partitions", [1, 16])
def test_partition_count_changes_nothing(spark, partitions):
    df = spark.createDataFrame([(i % 5, i, "v") for i in range(50)], "k int, i int, v string").repartition(partitions)
    assert rows(sequence.islands(df, "k", ["i"], "v")) == [(k, 1, "v", 10) for k in range(5)]
