import pytest

from quire.llm.reading_level import count_sentences, difficulty, document_frequencies, held_out_levels, level_agreement, reading_levels, words_of

DOC = "doc_id long, text string, lang string, level int, word string"
RATE = "doc_id long, rater_id string, reading_level int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 9, "clash") for r in rows], DOC)


def test_pieces():
    assert words_of("It's a Big-deal, año 7!") == ["it's", "a", "big-deal", "año"]
    assert words_of("古い図書館でミゾレ") == ["古", "い", "図書", "書館", "で", "ミゾレ"]
    assert count_sentences("One. Two! 3.5 three?\n\nFour") == 4 and count_sentences("一。二！三") == 3
    assert words_of("don’t -x- 'y' Ünï–z ab中文字cd カタカナー・ヒ 々") == ["don’t", "x", "y", "ünï", "z", "ab", "中文", "文字", "cd", "カタカナー", "ヒ", "々"]
    assert count_sentences("") == count_sentences("7. …") == 0 and count_sentences("a\nb. \"c!\" d") == 4


def test_against_plain_counting(spark):
    texts = {i: " ".join(["the cat sat on the mat."] * (i % 3 + 1) + (["obfuscatory perspicacity notwithstanding " + "x" * (i % 5 + 1) + "."] if i % 16 == 0 else [])) for i in range(60)}
    df = docs(spark, [*[(i, t, "en") for i, t in texts.items()], (0, texts[0], "en"), (90, None, "en"), (91, "", None), (92, "…!", "zh"), (93, "la niña. " * 9000, "es"), (94, "la niña, la niña", None), (95, "zzz", None), *[(200 + i, "la niña.", "es") for i in range(5)]])
    freq = {r["word"]: r["n_documents"] for r in document_frequencies(df.where("lang = 'en'").dropDuplicates(["doc_id"])).collect()}
    assert freq["cat"] == 60 and freq["perspicacity"] == 4 and freq["xx"] == sum(i % 16 == 0 and i % 5 == 1 for i in range(60))
    ratings = spark.createDataFrame([(i, "r", i % 5 + 1) for i in range(60)], RATE)
    got, rated = ({r["doc_id"]: r for r in reading_levels(df, x).collect()} for x in (None, ratings))
    assert len(got) == 71
    for i in range(60):
        found = words_of(texts[i])
        share = sum(freq[w] + (w in words_of(texts[0])) < 0.2 * 61 for w in found) / len(found)
        assert got[i]["unfamiliar_share"] == pytest.approx(share) and got[i]["n_words"] == len(found)
        assert got[i]["difficulty"] == pytest.approx(difficulty(share, len(found) / got[i]["n_sentences"])) and got[i]["level"] is None
    assert all(got[i]["difficulty"] == rated[i]["difficulty"] for i in got) and rated[3]["level"] is not None and rated[93]["level"] is not None
    assert [got[i]["difficulty"] for i in (90, 91, 92)] == [None] * 3 and got[93]["n_words"] == 18000 and got[94]["lang"] == "es" and got[95]["lang"] is None


def test_levels_follow_ratings(spark):
    rows = [(i, " ".join(["word"] * (3 + 4 * (i % 5))) + ".", "en") for i in range(200)]
    rates = [(i, f"r{k}", i % 5 + 1) for i in range(150) for k in range(2)] + [(0, "r0", 1), (1, "r1", None), (999, "r", 3)]
    df, ratings = docs(spark, rows), spark.createDataFrame(rates, RATE)
    levels = reading_levels(df, ratings)
    assert all(abs(r["level"] - (r["doc_id"] % 5 + 1)) < 0.2 for r in levels.collect())
    report = level_agreement(levels, ratings).collect()
    held = level_agreement(held_out_levels(df, ratings), ratings).first()
    assert held["n_documents"] == 150 and held["level_correlation"] > 0.99
    assert len(report) == 1 and report[0]["n_documents"] == 150 and report[0]["level_correlation"] > 0.99 and report[0]["unfamiliar_share_correlation"] is None


def test_empty(spark):
    df, ratings = docs(spark, [(1, "a b.", "en")]), spark.createDataFrame([], RATE)
    assert reading_levels(df.limit(0), ratings).count() == 0
    assert reading_levels(df, ratings).first()["level"] is None
    assert level_agreement(reading_levels(df), ratings).count() == 0
