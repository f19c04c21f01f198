import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.visual_text import consistent_form, fold_array, fold_points, look_key, read_points, row_chunks

SAME = [
    ("ｶﾞﾗｽの羅針盤", "ガラスの羅針盤"), ("が", "が"), ("Véa", "Véa"), ("Vеlka", "Velka"), ("A B", "A B"), ("口クスケ", "ロクスケ"),
    ("べル力", "ベルカ"), ("⽯の⼀つ", "石の一つ"), ("古い‍図\xad書", "古い図書"), ("ＰＡＧＥ　１", "PAGE 1"), ("オルゴ一ル", "オルゴール"), ("ﾊﾟﾁ!", "パチ！"),
    (" x　", "x"), ("q̣̇", "q̣̇"), ("Ａ̊", "Å"), ("ﬁn", "fin"),
]
OTHER = [("た", "だ"), ("つ", "っ"), ("a", "á"), ("A", "a"), ("！", "？"), ("ab", "a b"), ("x", "")]


KEEP = ["二十一日、工事は八時に力を入れて口頭で一人", "一方、夕方りんごへ", "Москва и ещё раз Москва", "Αθήνα", "カタカナ一つ", "一口カツ", "Москва-City", "naïve Ωmega"]
SETTLED = [("カ二ロ", "カニロ"), ("オルゴ一ルと一人", "オルゴールと一人"), ("Vеlka и он", "Velka и он"), ("Роlly", "Polly"), ("ア力口夕ン", "アカロタン"), ("РAGE‑1", "PAGE-1")]
LOOKS = [("𝐀ℌ", "AH"), ("ρаge", "page"), ("νia", "via"), ("ᎪᏢ", "AP"), ("Роlа", "Pola"), ("カ囗", "カ口")]


def one(x, look=False):
    return fold_array(pa.array([x]), look)[0].as_py()


@pytest.mark.parametrize("a,b", SAME)
def test_same_to_the_eye(a, b):
    assert one(a, True) == one(b, True)


@pytest.mark.parametrize("a,b", OTHER)
def test_different_to_the_eye(a, b):
    assert one(a) != one(b) and one(a, True) != one(b, True)


@pytest.mark.parametrize("text", KEEP)
def test_ordinary_texts_stay(text):
    assert one(text) == text


@pytest.mark.parametrize("a,b", SETTLED)
def test_look_alikes_are_put_right_among_others(a, b):
    assert one(a) == b and one(b) == b


@pytest.mark.parametrize("a,b", LOOKS)
def test_look_keys(a, b):
    assert one(a, True) == one(b, True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=12)), max_size=8))
def test_batches_equal_single_rows_and_are_stable(texts):
    for look in (False, True):
        got = fold_array(pa.array(texts, pa.string()), look)
        assert got.to_pylist() == [None if x is None else one(x, look) for x in texts]
        assert fold_array(got, look).to_pylist() == got.to_pylist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeoéíñかがハパ゙゚̣́̃ x漢", max_size=20))
def test_composition_is_nfc(text):
    want = unicodedata.normalize("NFC", text).strip(" ")
    assert one(text) == want


def test_places_point_into_the_original():
    folded = fold_points(read_points(pa.array([None, "", "ﾊﾟ​ｘ y"])))
    assert folded.place.tolist() == [0, 3, 4, 5] and set(folded.row.tolist()) == {2}


def test_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "​"), (4, "ｱ" * 70000), (5, "x"), (5, "x")], "id int, text string")
    got = {r["id"]: r["f"] for r in df.select("id", consistent_form("text").alias("f")).collect()}
    assert got == {1: None, 2: "", 3: "", 4: "ア" * 70000, 5: "x"}
    assert {r["id"]: r["f"] for r in df.select("id", look_key("text").alias("f")).collect()} == got
    assert df.limit(0).select(consistent_form("text")).count() == 0


def test_sql_gives_the_same_forms():
    import duckdb

    from quire.llm.forms_sql import consistent_sql

    texts = [x for pair in [*SAME, *OTHER, *SETTLED, *LOOKS] for x in pair] + KEEP + ["", None, "Ⅷ ﬃ", "\u200b", "豈ﾊﾞ", "a\tb\n c"]
    c = duckdb.connect()
    c.execute("CREATE TABLE t (i INTEGER, x VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    got = dict(c.execute(f"SELECT i, {consistent_sql('x')} FROM t").fetchall())
    assert {i: got[i] for i in range(len(texts))} == {i: None if x is None else one(x) for i, x in enumerate(texts)}


def test_chunks_cover_all_rows():
    texts = pa.array(["a" * 10, None, "", "b" * 95, "c" * 300, "d"])
    spans = list(row_chunks(texts, 100))
    assert [lo for lo, _ in spans] == [0, *[lo + n for lo, n in spans][:-1]] and sum(n for _, n in spans) == 6 and len(spans) > 1
    assert list(row_chunks(texts.slice(0, 0))) == []
