import json
import random

import pytest

import numpy as np

from quire.llm.letters import MARKS, Hashes, block, clauses, grams, letters
from quire.llm.pair_defects import COLUMNS, Judge, answer_text, bare_answer, find_defects

THINGS = ["bell", "lamp", "mask", "letter", "map", "crane", "key", "coin", "drum", "rope"]
COSAS = ["campana", "farol", "máscara", "carta", "mapa", "grulla", "llave", "moneda", "tambor", "cuerda"]
WARE = ["鐘", "ランプ", "仮面", "手紙", "地図", "折り鶴", "鍵", "コイン", "太鼓", "縄"]
FRAMES = [("The old {} is gone.", "El viejo {} ya no está.", "古い{}がなくなった。"), ("Give me the {}!", "¡Dame el {} ahora!", "その{}をくれ！"), ("Who broke my {}?", "¿Quién rompió mi {}?", "誰が{}を壊したの？"),
          ("I can't say anything about the {}.", "No puedo decir nada del {}.", "{}のことは何も言えない。")]
REFUSALS = ["I'm sorry, but I can't translate this content.", "この内容を翻訳することはできません。", "No puedo ayudar con esta solicitud."]


def row(i, ja, es, **kw):
    content = json.dumps({"translations": [{"translation_text": es}]}, ensure_ascii=False)
    base = dict(translation_id=i, source_lang="ja", target_lang="es", instruction="Traduce el texto al español.", source_text=ja, translation_text=es, content=content, error_classification=None, api_ok=True)
    return base | kw


def sample(n=700, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        picks = [(rng.choice(FRAMES), rng.randrange(10)) for _ in range(rng.randint(1, 3))]
        ja, es, en = ("".join(f[2].format(WARE[k]) for f, k in picks), " ".join(f[1].format(COSAS[k]) for f, k in picks), " ".join(f[0].format(THINGS[k]) for f, k in picks))
        rows.append(row(i, ja, es) if i % 3 else row(i, ja, en, target_lang="en", instruction="Translate into English."))
        if i % 25 == 0:
            rows[-1] |= dict(translation_text=None, content=rng.choice(REFUSALS), error_classification="provider_refusal")
    return rows


@pytest.fixture(scope="module")
def judge():
    return Judge.of_rows(sample())


JA, ES = "その鍵をくれ！古い鐘がなくなった。", "¡Dame el llave ahora! El viejo campana ya no está."
CASES = [
    (dict(), None), (dict(translation_text=None, content=""), "empty"), (dict(translation_text=" ​　"), "empty"), (dict(translation_text="N/A"), "empty"), (dict(translation_text="（无）"), "empty"),
    (dict(translation_text=None, content="", error_classification="api_timeout", api_ok=False), "empty"), (dict(translation_text=None, content="", error_classification="provider_refusal"), "refusal"),
    (dict(translation_text="I'm sorry, but I can't translate this content."), "refusal"), (dict(translation_text=None, content="この内容を翻訳することはできません。"), "refusal"),
    (dict(translation_text=JA), "source_copy"), (dict(translation_text="Traduce el texto al español. " + JA.replace("。", " ")), "source_copy"), (dict(translation_text="The old key is gone. Give me the bell!"), "wrong_language"),
    (dict(translation_text="¡Dame el llave ahora! El viejo cam"), "truncated"), (dict(translation_text="¡Dame el llave ahora! El viejo campana ya", content='{"translations": [{"translation_text": "¡Dame el'), "truncated"),
    (dict(source_text="鍵のことは何も言えない。", translation_text="No puedo decir nada del llave."), None), (dict(source_text="……", translation_text="…"), None), (dict(source_text="♪", translation_text=""), "empty"),
    (dict(source_text=JA[:-1] + "——", translation_text=ES[:-1] + "——"), None), (dict(source_text=None, translation_text=ES), None), (dict(content="x" * 100000), None),
    (dict(target_lang=None, source_lang=None, instruction=None), None), (dict(translation_text=ES, content="```json\nbroken wrapping"), None),
]


@pytest.mark.parametrize("change,want", CASES)
def test_cases(judge, change, want):
    assert judge.defect(row(1, JA, ES) | change) == want


def test_sound_rows_stay_sound(judge):
    fresh = [r for r in sample(400, seed=9) if r["error_classification"] is None]
    assert sum(judge.defect(r) is not None for r in fresh) <= 2


def parts(text):
    x = clauses(block([text])).letters
    return ["".join(map(chr, x.points[x.group == i])) for i in range(x.n)]


def test_pieces():
    assert parts("Oh... no! Go.  ") == ["ohno", "go"] and parts("……") == parts("") == [] and parts("v1.5 a.b。「はい。」次") == ["v15ab", "はい", "次"]
    held = clauses(block(["a。」", "b——", "c", "", "d...", None]))
    assert [MARKS[k] for k in held.row_mark] == [".", "-", "", "", "~", ""] and held.row.tolist() == [0, 1, 2, 4] and held.closed.tolist() == [True, False, False, False]
    assert answer_text(None, "```json\n\n```") == ("", False) and answer_text("x", '{"a": "b') == ("x", True)


def test_hashes_of_equal_stretches_are_equal():
    x = letters(block(["abcab", "cab", "ab\0c"]))
    h, row = grams(x, 2, Hashes(x.points))
    assert row.tolist() == [0, 0, 0, 0, 1, 1, 2, 2] and len(np.unique(h)) == 3 and h[0] == h[3] == h[5] == h[6]


def test_column_form(spark):
    kinds = dict(translation_id="long")
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in COLUMNS) + ", defect_type string"
    rows = sample(300) + [row(1000, JA, JA), row(1000, JA, JA), row(1001, None, None, content=None)]
    df = spark.createDataFrame([(*[r[c] for c in COLUMNS], "clash") for r in rows], schema)
    got = sorted(tuple(r) for r in find_defects(df).collect())
    assert [x for x in got if x[0] >= 1000] == [(1000, "source_copy"), (1001, "empty")]
    assert {x[0] for x in got if x[1] == "refusal"} == {r["translation_id"] for r in rows if r["error_classification"]}
    assert find_defects(df.limit(0)).count() == 0


def test_instructions_go(judge):
    told = "Vierta cada frase del globo al castellano con todo cuidado y sin comentario alguno, por favor."
    assert bare_answer(told + " " + JA, told).strip() == JA and bare_answer(told, told) == told and bare_answer(JA, None) == bare_answer(JA, "") == JA
    assert judge.defect(row(1, JA, told + " " + JA, instruction=told)) == "source_copy"
    assert judge.defect(row(1, JA, "Translate into English. " + JA)) == "source_copy"  # another row's instruction


def test_refusals_of_a_fifth_language_are_learnt_from_the_providers_labels():
    said = ["Dieser Inhalt kann leider nicht übersetzt werden.", "Ich darf diese Anfrage nicht beantworten.", "Als Sprachmodell muss ich diese Anfrage ablehnen."]
    rows = sample(500)
    for i, r in enumerate(rows):
        if i % 20 == 7:
            rows[i] = r | dict(translation_text=None, content=said[i // 20 % 3], error_classification="provider_refusal")
    german = Judge.of_rows(rows)
    assert [german.defect(row(1, JA, x)) for x in said] == ["refusal"] * 3
    assert german.defect(row(1, JA, "Leider kann diese Anfrage nicht beantwortet werden.")) == "refusal"  # in no labelled row
    assert german.defect(row(1, JA, ES)) is None


def test_the_latest_delivery_counts(spark):
    texts = [c for c in COLUMNS if c != "translation_id"]
    schema = "translation_id long, " + ", ".join(f"{c} string" for c in texts) + ", loaded_at timestamp_ntz"
    import datetime as dt

    early, late = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    rows = [(r, late) for r in sample(300)] + [(row(1000, JA, JA), early), (row(1000, JA, ES), late), (row(1001, JA, ES), early), (row(1001, JA, JA), late), (row(None, JA, JA), late)]
    df = spark.createDataFrame([(r["translation_id"], *[r[c] for c in texts], at) for r, at in rows], schema)
    assert [tuple(r) for r in find_defects(df).collect() if r[0] is None or r[0] >= 1000] == [(1001, "source_copy")]
