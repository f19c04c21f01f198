from datetime import datetime, timedelta

from quire.operators.references import find_orphans, orphan_report, parent_rows, reference_rows

T = datetime(2025, 3, 31, 23, 0)
REF = "rid string, k string, at timestamp, kh long, salt int"
PAR = "k string, st string, born timestamp, upd timestamp, range_id int"


def refs(spark, rows):
    return reference_rows(spark.createDataFrame([(*r, 1, 2) for r in rows], REF), "t", "rid", "k", "at")


def parents(spark, rows):
    return parent_rows(spark.createDataFrame([(*r, 3) for r in rows], PAR), "k", "st", "born", "upd")


def test_kinds(spark):
    later = T + timedelta(days=1)
    p = parents(spark, [("a", "present", T, T), ("d", "present", T, T), ("d", "deleted", T, later), ("u", "deleted", T, T), ("u", "present", T, later),
                        ("l", "missing", later, later), ("dl", "deleted", later, later), ("n", None, None, None), (None, "present", T, T)])
    r = refs(spark, [("1", "a", T), ("2", "d", T), ("3", "u", T), ("4", "l", T), ("5", "dl", T), ("6", "A", T), ("6", "A", T), ("7", None, T), ("8", "", T),
                     ("9", "n", T), ("10", "l", None), ("11", "a ", None), ("12", "x" * 5000, T), (None, "a", T)])
    got = {(x["record_id"], x["orphan_kind"], x["period"]) for x in find_orphans(r, p).collect()}
    m = "2025-03"
    assert got == {("2", "deleted", m), ("4", "late", m), ("5", "deleted", m), ("6", "missing", m), ("11", "missing", None), ("12", "missing", m)}


def test_hot_key_is_split_and_agrees(spark):
    p = parents(spark, [(f"k{i}", "deleted" if i % 7 == 0 else "present", T, T) for i in range(500)])
    r = refs(spark, [(f"r{i}", "k7" if i % 3 else f"k{i % 600}", T) for i in range(3000)])
    whole = {tuple(x) for x in find_orphans(r, p).collect()}
    split = {tuple(x) for x in find_orphans(r, p, parents_per_range=50, refs_per_task=100).collect()}
    want = {f"r{i}" for i in range(3000) if i % 3 or i % 600 >= 500 or (i % 600) % 7 == 0}
    assert whole == split and {x[1] for x in whole} == want


def test_empty_tables(spark):
    none_p, none_r = parents(spark, []), refs(spark, [])
    one_r = refs(spark, [("1", "a", T)])
    assert [x["orphan_kind"] for x in find_orphans(one_r, none_p).collect()] == ["missing"]
    assert find_orphans(none_r, none_p).count() == 0
    report = orphan_report(one_r, find_orphans(one_r, none_p)).collect()
    assert [tuple(x) for x in report] == [("t", "2025-03", 1, 1, 0, 0)]
