import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import quantiles as q


def true_rank_gap(values, got, rank):
    """How far rank lies from the ranks that ``got`` has in the sorted values."""
    lo, hi = np.searchsorted(values, got, "left") + 1, np.searchsorted(values, got, "right")
    return max(lo - rank, rank - hi, 0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), max_size=60), min_size=1, max_size=9), st.integers(3, 12))
def test_intervals_hold_through_merges(parts, size):
    whole = np.sort(np.concatenate([np.array(p, "float64") for p in parts]))
    s = q._merged([q.summarise(np.sort(np.array(p, "float64")), size) for p in parts], size)
    assert s[0] == len(whole)
    if not s[0]:
        return
    assert s[1][0] == whole[0] and s[1][-1] == whole[-1] and (np.diff(s[1]) >= 0).all()
    for v, lo, hi in zip(*s[1:]):
        assert lo <= hi and lo <= np.searchsorted(whole, v, "right") and hi >= np.searchsorted(whole, v, "left") + 1
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        rank = max(1, int(np.ceil(share * len(whole))))
        assert true_rank_gap(whole, q.answer(s, share), rank) <= q.rank_error(s)


def test_hierarchy_keeps_the_bound(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(-5, 100, 30000), rng.lognormal(8, 3, 20000).astype("int64")])
    rows = [("hot" if i % 3 else f"g{i % 7}", int(v), 9) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, v long, slot long").repartition(16)
    parts = q.summarise_groups(df, ["g"], "v", 600, 16)
    merged = q.merge_levels(parts, ["g"], "slot", 16, 600, fan_in=3)
    got = {r["g"]: r for r in q.percentile_rows(merged, ["g"], {"p50": 0.5, "p99": 0.99}).collect()}
    for g in got:
        own = np.sort([v for k, v, _ in rows if k == g])
        assert got[g]["n"] == len(own) and got[g]["rank_error"] <= 0.01 * len(own) + 1
        for c, share in (("p50", 0.5), ("p99", 0.99)):
            assert true_rank_gap(own, got[g][c], int(np.ceil(share * len(own)))) <= got[g]["rank_error"]


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), ("a", None), ("b", float("nan")), ("c", 7.0)], "g string, v double")
    got = {r["g"]: (r["n"], r["p50"], r["rank_error"]) for r in q.percentile_rows(q.group_summaries(df, ["g"], "v"), ["g"], {"p50": 0.5}).collect()}
    assert got == {None: (2, 1.0, 0.0), "c": (1, 7.0, 0.0)}
    assert q.group_summaries(df.limit(0), ["g"], "v").count() == 0


@pytest.mark.parametrize("slots,levels", [(1, 0), (2, 1), (64, 1), (65, 2), (5000, 3)])
def test_levels(slots, levels):
    assert q.levels_of(slots) == levels


def test_a_task_gives_one_summary_a_key(spark):
    """Many chunks, with the pile's bound observed and the error kept; a small bound on what is held gives more summaries, none lost."""
    df = spark.range(60_000).selectExpr("id % 3 AS g", "hash(id) AS v").repartition(2)
    own = {g: np.sort([r["v"] for r in df.where(f"g = {g}").collect()]) for g in range(3)}
    for held, least, most in ((10**9, 6, 6), (900, 7, 60)):
        parts = q.summarise_groups(df, ["g"], "v", 500, 8, chunk_rows=500, held_tuples=held).cache()
        assert least <= parts.count() <= most
        for r in q.percentile_rows(q.merge_levels(parts, ["g"], "slot", 8, 500), ["g"], {"p50": 0.5}).collect():
            assert r["n"] == 20_000 and r["rank_error"] <= 0.02 * 20_000 and true_rank_gap(own[r["g"]], r["p50"], 10_000) <= r["rank_error"]


def test_5000_partitions_hold_few_at_a_time():
    rng, pile, whole, most = np.random.default_rng(5), q.Pile(4_001), [], 0
    for _ in range(5_000):
        values = np.sort(rng.lognormal(5, 2, 40))
        whole.append(values)
        pile.add(q.summarise(values, 4_001))
        most = max(most, max(map(len, pile.levels)))
    whole, s = np.sort(np.concatenate(whole)), pile.whole()
    assert most < q.FAN_IN and pile.held() < 3 * q.FAN_IN and s[0] == 200_000 and q.rank_error(s) <= 0.001 * 200_000
    for share in (0.5, 0.99):
        assert true_rank_gap(whole, q.answer(s, share), int(np.ceil(share * len(whole)))) <= q.rank_error(s)
