"""Queries do the whole job: small cases that a cut of the rows, texts or pairs would fail."""

import hashlib
import random

from quire.operators import evaluate, pairs, sequence
from quire.plans import evaluation, matching, relational, sequences, texts

rng = random.Random(11)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_distinct_vectors_agree_with_brute_force(spark):
    base = [rng.getrandbits(64) for _ in range(12)]
    vectors = []
    for i in range(160):
        s = rng.choice(base)
        for bit in rng.sample(range(64), rng.choice([0, 3, 8, 9, 16, 17])):
            s ^= 1 << bit
        vectors.append((i, rng.choice([1, 1, 1, 2, None]), s >> 32, s & 0xFFFFFFFF))
    vectors += [(500, 7, 0, 0), (501, 7, 0xFFFF0000, 0), (502, 7, 0xFFFF8000, 0), (503, 8, None, None), (504, 8, None, None)]  # 16 and 17 bits apart, all of them leading ones
    want = [(8, 503), (8, 504)]
    for label in (1, 2, None, 7):
        own = sorted((v for v in vectors if v[1] == label), key=lambda v: hashlib.sha256(str(v[0]).encode()).hexdigest())
        want += [(label, own[k][0]) for k in sequence.greedy_distinct([(v[2] << 32) | v[3] for v in own], 16)]
    df = spark.createDataFrame(vectors, "vec_id long, label int, high long, low long")
    for chunk_rows in (7, 10_000):
        assert rows(sequences.distinct_vectors(df, 16, chunk_rows)) == sorted(want, key=repr)
    assert rows(sequences.distinct_vectors(df.limit(0), 16)) == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_of_all_scripts(spark):
    regions = [("p", "r2", "plain"), ("p", "r1", "猫が鳴く𠮷"), ("q", "r1", None), ("q", "r3", "¿Qué año?"), ("e", "r1", ""), ("n", "r1", None)]
    reads = [("a", "p", "猫か鳴く𠮷"), ("b", "p", "cat"), ("c", "p", None), ("d", "p", ""), ("e", "q", "Que ano"), ("f", "q", "¿Qué año?"), ("g", "e", "é"), ("h", "e", None), ("i", "n", "x"), ("a", "p", "猫か鳴く𠮷")]
    first = {"p": "猫が鳴く𠮷", "q": "¿Qué año?", "e": ""}
    want = {(f, round(distance(first[p], t or "") / len(first[p]), 6) if first[p] else float(bool(t))) for f, p, t in reads if p in first}
    got = texts.error_rates(spark.createDataFrame(reads, "fragment_id string, asset_id string, ocr_text string"), spark.createDataFrame(regions, "asset_id string, region_id string, expected string"))
    assert rows(got) == sorted(want, key=repr)


def test_every_order_is_upserted(spark):
    customers = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "c_custkey long, c_mktsegment string")
    orders = spark.createDataFrame([(1, 1, "low"), (1, 7, "high"), (2, 5, "old"), (2, 6, "new"), (9, 3, "first"), (9, 4, "last")], "o_custkey long, o_orderkey long, o_orderpriority string")
    assert rows(sequences.upserted(customers, orders)) == [(1, "high"), (2, "new"), (3, "C"), (4, "D"), (9, "last")]
    assert rows(sequences.upserted(customers, orders.limit(0))) == [(1, "A"), (2, "B"), (3, "C"), (4, "D")]


def test_lines_of_every_date_are_numbered(spark):
    lines = [(1, n, 5, 6, 1.0, date) for n, date in ((1, "1994-01-01"), (2, "1997-12-31"), (3, "1998-01-01"))] + [(2, 4, 5, 6, 1.0, "1992-02-02"), (2, 7, 5, 6, 1.0, None)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string")
    got = [(r["l_orderkey"], r["l_linenumber"], r["place"]) for r in relational.numbered_lines(df).collect()]
    assert sorted(got) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 4, 1), (2, 7, 2)]


def test_label_lines_of_every_language_and_source(spark):
    docs = [(1, "Name: Ana\nno label\nRole-x: b\r", "es", "scene_transcript"), (2, "Ab: 猫\u2028犬", None, None), (3, "x\n\nNote: a: b", "ja", "web"), (4, None, "en", "scene_transcript"), (5, "A: short\nOk:none\nOk: ", "en", "scene_transcript")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    assert rows(relational.label_lines(df)) == [(1, 1, "Name", 3), (1, 3, "Role-x", 2), (2, 1, "Ab", 3), (3, 3, "Note", 4)]


def test_partitions_over_all_regions(spark):
    kind = "region_id string, asset_id string, direction string"
    expected = spark.createDataFrame([("reg-0", "p", "v"), ("reg-5", "p", "v"), ("reg-z", "p", "h"), ("reg-1", "q", "v"), ("reg-g", "q", "v"), ("reg-2", "m", "v")], kind)
    actual = spark.createDataFrame([("reg-0", "p", "v"), ("reg-5", "p", "v"), ("reg-z", "p", "h"), ("reg-1", "q", "v"), ("reg-g", "q", "v"), ("reg-y", "q", "v"), ("reg-x", "x", "h")], kind)
    held = evaluation.whole_overlaps(expected, actual)  # reg-2 is missing; reg-y and reg-x are extra
    assert rows(held) == sorted([("p", "pv", 2), ("p", "ph", 1), ("q", "qv", 2), ("m", None, 1), (None, "qv", 1), (None, "xh", 1)], key=repr)
    assert rows(evaluate.judge_groups(held)) == [("m", 1, 0, "miss"), ("p", 3, 2, "split"), ("q", 2, 1, "merge")]
    assert rows(evaluation.merges_and_extras(held)) == [("ph", 1, False, False), ("pv", 1, False, False), ("qv", 1, False, True), ("xh", 0, False, True)]


def test_readings_of_equal_boxes_keep_their_rows(spark):
    box, other = (10, 10, 20, 40), (200, 10, 60, 20)
    reads = [("f1", "p", box), ("f2", "p", box), ("f3", "p", box), ("f4", "p", other), ("f1", "p", box), ("f5", "q", box), ("f7", "q", (None, 1, 1, 1)), ("f6", "q", (None, 1, 1, 1))]
    df = spark.createDataFrame(reads, "fragment_id string, asset_id string, bbox struct<x int, y int, width int, height int>")
    own = matching.all_readings(df)
    areas = spark.createDataFrame([("p", "r1", 0, 0, 100, 100)], "page string, id string, x int, y int, w int, h int")
    assert rows(pairs.unique_containers(own.where("page = 'p'"), areas)) == [("f1", "r1", "unique"), ("f2", "r1", "unique"), ("f3", "r1", "unique"), ("f4", None, "none")]
    assert rows(matching.seeds_of(own, areas)) == [("f1", "r1", 200), ("f2", "r1", 200), ("f3", "r1", 200)]
    assert rows(matching.votes(own.where("page = 'p'"))) == [("p", 3, 1, "vertical")]
    assert rows(matching.box_classes(own)) == [("p", "f1", "f1"), ("p", "f2", "f1"), ("p", "f3", "f1"), ("p", "f4", "f4"), ("q", "f5", "f5"), ("q", "f6", "f6"), ("q", "f7", "f6")]
