import random

import pytest

from quire.operators.hierarchy import descendant_pairs, parent_links, resolve_hierarchy

SCHEMA = "id string, up string, seen int, node_id string, label string"


def brute(parents):
    """Root, depth and on-cycle flag of each node by plain walking."""
    out = {}
    for v in parents:
        trail, x = [v], v
        while parents.get(x) in parents and parents[x] not in trail:
            x = parents[x]
            trail.append(x)
        if parents.get(x) in parents:
            ring = trail[trail.index(parents[x]) :]
            out[v] = ("cycle:" + min(ring), 0 if v in ring else trail.index(ring[0]))
        else:
            out[v] = (x, len(trail) - 1)
    return out


def solve(spark, rows, **kw):
    df = spark.createDataFrame([(i, u, 0, "clash", "clash") for i, u in rows], SCHEMA)
    return resolve_hierarchy(parent_links(df, "id", "up", ["seen"]), **kw)


@pytest.mark.parametrize("limits", [dict(), dict(max_component=2), dict(max_path_nodes=3), dict(paths=False), dict(paths=False, max_component=2)])
def test_random_forests_and_cycles(spark, limits):
    rng = random.Random(7)
    ids = [f"n{i:03d}" for i in range(60)]
    parents = {v: rng.choice([None, "", "gone", *ids[:12], *ids[:12], *ids]) for v in ids}
    parents["n001"] = "n001"
    parents["n050"], parents["n051"] = "n051", "n050"
    rows = [*parents.items(), ("n003", parents["n003"]), (None, "n001")]
    got = {r["node_id"]: r for r in solve(spark, rows, **limits).collect()}
    want = brute({k: v or None for k, v in parents.items()})
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == want
    if limits.get("paths", True):
        assert all(len(r["path"]) == r["depth"] + 1 and r["path"][-1] == k and all(parents[b] == a for a, b in zip(r["path"], r["path"][1:])) for k, r in got.items())
    below = dict.fromkeys(ids, 0)
    for v in ids:
        seen, x = set(), parents[v]
        while x in parents and x not in seen:
            seen.add(x)
            if x != v:
                below[x] += 1
            x = parents[x]
    assert {k: r["n_descendants"] for k, r in got.items()} == below


def test_both_ways_agree_on_a_deep_chain(spark):
    rows = [(f"c{i:04d}", f"c{i - 1:04d}" if i else None) for i in range(300)] + [(f"s{i}", "c0000") for i in range(50)]
    a = {r["node_id"]: r for r in solve(spark, rows).collect()}
    b = {r["node_id"]: r for r in solve(spark, rows, max_component=10).collect()}
    assert a == b and a["c0299"]["depth"] == 299 and a["c0000"]["n_descendants"] == 349


def test_latest_row_names_the_parent(spark):
    df = spark.createDataFrame([("a", None, 1, "", ""), ("b", "a", 1, "", ""), ("b", "x", 2, "", ""), ("c", "a", 5, "", ""), ("c", None, 4, "", "")], SCHEMA)
    links = {r["node_id"]: (r["parent_id"], r["dangling"]) for r in parent_links(df, "id", "up", ["seen"]).collect()}
    assert links == {"a": (None, False), "b": (None, True), "c": ("a", False)}


def test_empty_and_pairs(spark):
    assert solve(spark, []).count() == 0
    tree = solve(spark, [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y")])
    pairs = {tuple(r) for r in descendant_pairs(tree).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("cycle:x", "x", 0), ("cycle:x", "y", 0), ("cycle:x", "z", 1)}


def test_long_cycles_with_long_tails(spark):
    """Windows and steps must go on doubling until they cover every cycle and every tail."""
    rows = [(f"a{i:03d}", f"a{(i + 1) % 37:03d}") for i in range(37)] + [(f"t{i:03d}", f"t{i - 1:03d}" if i else "a005") for i in range(90)] + [(f"b{i:03d}", f"b{(i + 1) % 16:03d}") for i in range(16)]
    rows += [("r", None), ("s", "r")]
    got = {r["node_id"]: r for r in solve(spark, rows).collect()}
    want = brute(dict(rows))
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == want and got["a000"]["n_descendants"] == 126 and got["t000"]["n_descendants"] == 89


def test_walk_holds_little(tmp_path):
    """A chain of 200,000 nodes without paths, and the first slices of one of 50,000 with them, within 400 MB."""
    code = """
import re
from itertools import islice
from quire.operators.hierarchy import _walk
chain = lambda n: ([f"run-{i:032d}" for i in range(n)], [f"run-{i - 1:032d}" if i else None for i in range(n)])
rows = [r for piece in _walk(*chain(200_000), False) for r in piece]
assert len(rows) == 200_000 and rows[-1][2:5] == ("run-" + "0" * 32, 199_999, 0)
n = sum(len(piece) for piece in islice(_walk(*chain(50_000), True), 2_000))
assert n > 20_000
print(int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024)
"""
    import subprocess
    import sys

    root = __import__("pathlib").Path(__file__).resolve().parent.parent
    peak = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=root).stdout)
    assert peak < 400, peak
