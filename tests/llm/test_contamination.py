import random

import pytest

from quire.llm import contamination
from quire.llm.contamination import Leaks, built, find_leaks

DOC = "doc_id long, text string, item_id string"
ITEM = "item_id long, suite string, lang string, passage string, question string, answer string"
WORDS = [a + b for a in ("bal", "cor", "dun", "fel", "gim", "hos", "jer", "kan") for b in ("aro", "ine", "upo", "ossa", "ety", "imal", "une")]
rng = random.Random(4)
EN = ". ".join(" ".join(rng.choice(WORDS).capitalize() for _ in range(12)) for _ in range(5)) + "."
JA = "".join(rng.choice("観測所陰名呼郵便橇守続戻前縫直置紙漉場残絵猫鈴竹雲") for _ in range(120))
ITEMS = [(1, "s", "en", EN, "What happened to the falconer of Corine?", "Balaro of Kanune"), (2, "s", "ja", JA, None, None), (3, "s", None, None, None, "x"), (4, "s", "en", "", None, None)]


def found(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], DOC)
    return {(r["doc_id"], r["item_id"]): r for r in find_leaks(df, spark.createDataFrame(ITEMS, ITEM), **kw).collect() if r["part"] == "passage"}


def test_leaks_and_no_leaks(spark):
    w = EN.split()
    changed = [x if i % 11 else "zzz" for i, x in enumerate(w)]
    shuffled = EN.split(". ")
    rng.shuffle(shuffled)
    docs = [
        (1, "Intro. " + EN + " End."), (2, EN.upper().replace(" ", "\n")), (3, " ".join(w[10:40]).replace(",", "")), (4, " ".join(w[:15])), (5, " ".join(changed)),
        (6, ITEMS[0][4]), (7, " ".join(sorted(w))), (8, None), (9, ""), (10, "x" * 200000 + JA[30:90]), (11, "、".join(JA)), (12, JA[:40]), (13, "".join(c if i % 17 else "某" for i, c in enumerate(JA))),
        (14, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in EN)), (15, EN + JA), (1, "Intro. " + EN + " End."), (16, " ".join(s + "." for s in shuffled[::2])[:150]),
    ]
    got = found(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 1), (10, 2), (11, 2), (13, 2), (14, 1), (15, 1), (15, 2)}
    r = got[(1, 1)]
    assert docs[0][1][r["start"] : r["stop"]] == EN[:-1] and r["share"] == 1.0
    assert (got[(10, 2)]["start"], got[(10, 2)]["stop"]) == (200000, 200060)


def test_blocks_agree_with_one_automaton(spark):
    docs = [(1, EN), (2, JA), (3, "nothing of it")]
    assert set(found(spark, docs)) == set(found(spark, docs, block_chars=50)) == {(1, 1), (2, 2)}


@pytest.mark.parametrize("docs,items", [(0, 4), (3, 0)])
def test_empty_tables(spark, docs, items):
    df = spark.createDataFrame([(1, EN, "")] * docs, DOC)
    assert find_leaks(df, spark.createDataFrame(ITEMS[:items], ITEM)).count() == 0


def test_short_answers_are_listed_as_words(spark):
    items = [(1, "s", "en", EN, None, "Lin"), (2, "s", "ja", JA, "誰?", "ヤタモ"), (3, "s", "en", None, None, "7"), (4, "s", "en", "", "", "..."), (5, "s", "en", None, None, "Mo Li")]
    docs = [(1, "Then LIN; linen, Berlin and lin"), (2, "昔ヤタモは誰"), (3, "17 or 7"), (4, "Linヤタモ"), (5, "mo-li, mo linen"), (6, "li\u0301n l\u200bin"), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "") for i, t in docs], DOC)
    got = {(r["doc_id"], r["item_id"], r["part"], r["start"], r["stop"]) for r in find_leaks(df, spark.createDataFrame(items, ITEM)).collect()}
    assert got == {
        (1, 1, "answer", 5, 8), (1, 1, "answer", 28, 31), (2, 2, "answer", 1, 4), (2, 2, "question", 5, 6), (3, 3, "answer", 6, 7),
        (4, 1, "answer", 0, 3), (4, 2, "answer", 3, 6), (5, 5, "answer", 0, 5), (6, 1, "answer", 5, 9),
    }


def test_a_short_chinese_question_is_found(spark):
    items = [(1, "s", "zh", "", "谁打破了那盏古老的灯", "莲雄")]
    docs = spark.createDataFrame([(1, "昨天，谁打破了，那盏古老的灯？莲雄。", ""), (2, "谁打破了那盏新的灯", "")], DOC)
    got = {(r["doc_id"], r["part"]) for r in find_leaks(docs, spark.createDataFrame(items, ITEM)).collect()}
    assert got == {(1, "question"), (1, "answer")}


def test_one_automaton_for_many_partitions(spark):
    """Each worker process builds the block's automaton once, whatever the number of tasks."""
    import os

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            before = set(contamination._BUILT)
            built([(r[0], *r[2:]) for r in ITEMS], ("count-test", 0.4, 32))
            fresh = "count-test" not in {k[0] for k in before}
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([int(fresh)])], ["pid", "n"])

    rows = spark.range(0, 64, 1, 32).mapInArrow(count, "pid long, n long").groupBy("pid").sum("n").collect()
    assert all(r[1] <= 1 for r in rows) and sum(r[1] for r in rows) < 32


def test_seeds_that_many_passages_share(spark):
    """A common introduction anchors nothing but is still part of a stretch; passages of common seeds alone are found all the same."""
    own = [" ".join(rng.choice(WORDS) for _ in range(16)) for _ in range(40)]
    lead = " ".join(rng.choice(WORDS) for _ in range(4))
    items = [(i, "s", "en", f"{lead} {x}", None, None) for i, x in enumerate(own)] + [(100 + i, "s", "en", lead + " end", None, None) for i in range(3)]
    leaks = Leaks([(r[0], *r[2:]) for r in items], 0.4, most_shared=5)
    assert sum(leaks.thin) == 40 and len(leaks.items) == 41 and leaks.items[40] == [100, 101, 102]
    docs = [(1, f"Now {lead} {own[7]}."), (2, f"only {lead}, no more"), (3, own[3])]
    df = spark.createDataFrame([(i, t, "") for i, t in docs], DOC)
    got = {(r["doc_id"], r["item_id"]): (r["share"], r["exact"]) for r in find_leaks(df, spark.createDataFrame(items, ITEM), most_shared=5).collect()}
    assert got[(1, 7)] == (1.0, True) and got[(3, 3)] == (0.8, False) and {k for k in got if k[0] == 2} == {(2, 100), (2, 101), (2, 102)}
    assert {k for k in got if k[0] == 1 and k[1] < 100} == {(1, 7)}
