"""Defects of source-answer pairs: empty, truncated, refused, copied or in another language.

An answer is cut into clauses; a conditional random field tags each as answer, refusal, echo, foreign or unfinished,
and the tags' share of the answer's letters decides the pair's defect. Nothing is labelled by hand and no words of any
language are given: counts over all rows tell which letters belong to which language, how clauses end, and how the
refusals that the provider labelled differ from answers. The field's weights are fitted on a bounded sample of rows,
labelled refusals and sound answers, the latter also cut, swapped and replaced by their sources to give every tag.

All features of a batch come from arrays of code points at once (see ``letters``); the field is decoded by length.
"""

from __future__ import annotations

import json
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import crf
from quire.llm.letters import MARKS, Block, Hashes, Letters, block, clauses, grams, letters, mixed, slots, tables
from quire.session import shipped

FIT_ROWS = 4_000
FIT_REFUSALS = 1_000
FIT_CHARS = 2_000
FLAGGED_EMPTY = 50
MAX_LANGUAGES = 200
CHUNK_ROWS = 4_000
CHUNK_BYTES = 4_000_000
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
KINDS = ("empty", "refusal", "source_copy", "truncated", "wrong_language")
COLUMNS = ("translation_id", "source_lang", "target_lang", "instruction", "source_text", "translation_text", "content", "error_classification")
TEXTS = COLUMNS[1:]
REFUSED = "provider_refusal"
SHARE = 0.5
REFUSAL_SHARE = 0.3
LANGUAGE_GRAMS, LANGUAGE_BITS = (1, 2, 3), 16
REFUSAL_GRAMS, REFUSAL_BITS = (2, 3, 5), 18
WHOLE = 1 << 40
ENDINGS, ENDING_BITS = (WHOLE, 6, 3), 20  # letters before a place; first all of its clause's
LEAD_BITS = 20
ALL_ROWS = 2 << LEAD_BITS
LEAD_SHARE = 0.001
USUAL_SCRIPT = 0.03
#: What stands where an answer should, in whole answers of no other letters.
PLACEHOLDER = re.compile(r"\W*(n/?a|tbd|tba|todo|null|none|nil|nan|undefined|empty|blank|translation|translated text|text|无|無|空|なし|暂无|ninguno|nada|vacío)?\W*", re.I)
PLACEHOLDER_LETTERS = 16
LABEL_LEAD = re.compile(r"^\s*[\w'-]{1,16}\s*[:：]\s*")
_BLANKS = re.compile(r"[\W_]+")
_DECODER = json.JSONDecoder()
COUNT_SCHEMA = "kind int, lang string, slot int, n long, m long"
IS_LANGUAGE, IS_SCRIPT, IS_REFUSAL, IS_ENDING, IS_LEAD = range(5)


def plain(text: str | None) -> str:
    """Letters and digits in one width and case."""
    return _BLANKS.sub("", unicodedata.normalize("NFKC", text).lower()) if text else ""


def answer_text(translation: str | None, content: str | None) -> tuple[str, bool]:
    """What stands as the answer, and whether the raw answer is JSON that breaks off."""
    content = content or ""
    brace = content.find("{")
    broken = False
    if brace >= 0:
        try:
            _DECODER.raw_decode(content, brace)
        except ValueError:
            broken = True
    if translation is not None:
        return translation, broken
    if brace >= 0:
        return "", broken
    return re.sub(r"```\w*", "", content).strip(), broken


def bare_answer(answer: str, own: str | None = None) -> str:
    """An answer without a lead-in: the row's instruction said again (unless nothing else would be left), a label or a speaker's name."""
    text, told = answer.strip(), (own or "").strip()
    if told and text.startswith(told) and any(map(str.isalnum, text[len(told) :])):
        text = text[len(told) :]
    return LABEL_LEAD.sub("", text)


class Batch:
    """Columns of some rows as lists, with what stands as their answers."""

    def __init__(self, columns: dict[str, list]) -> None:
        self.columns = columns
        self.n = len(columns["source_text"])
        self.flagged = np.array([x == REFUSED for x in columns["error_classification"]], bool)
        both = [answer_text(a, b) for a, b in zip(columns["translation_text"], columns["content"])]
        self.answer = [a for a, _ in both]
        self.broken = np.array([b for _, b in both], bool)

    @classmethod
    def of_rows(cls, rows: list[dict]) -> Batch:
        return cls({c: [r.get(c) for r in rows] for c in TEXTS})

    def bare(self) -> list[str]:
        return [bare_answer(a, told) for a, told in zip(self.answer, self.columns["instruction"])]


def _coded(values: list[str | None], known: dict[str, int]) -> np.ndarray:
    return np.array([known.get(v, -1) for v in values], "int64")


def _text_hash(values: list[str | None]) -> np.ndarray:
    """A hash of each of a few short texts, the same in every process."""
    b = block(values)
    ends = np.flatnonzero(b.points == 0)
    return Hashes(b.points).of(np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends, ends)


def _ending_slots(x: Letters, at: np.ndarray, first: np.ndarray, lang: np.ndarray, size: int, hashes: Hashes) -> list[np.ndarray]:
    """Two slots, each in a table of its own, of the ``size`` letters before each place ``at`` (the clause's start counts as one), apart by language."""
    start = np.maximum(at - size, first)
    with np.errstate(over="ignore"):
        h = hashes.of(start, at) + (at - first < size) * np.uint64(0x632BE59BD9B4E019) + lang * np.uint64(3)
    h = mixed(h)
    both = (slots(h, ENDING_BITS), slots(h << np.uint64(ENDING_BITS), ENDING_BITS))
    return [slot + ((2 * ENDINGS.index(size) + i) << ENDING_BITS) for i, slot in enumerate(both)]


def no_endings() -> np.ndarray:
    """Counts of endings of no text: going on and done, by slot."""
    return np.zeros((2, (2 * len(ENDINGS)) << ENDING_BITS), "int32")


def _clause_slots(x: Letters, hashes: Hashes) -> np.ndarray:
    """Two slots of each clause's letters, in halves of one table."""
    stops = np.cumsum(np.bincount(x.group, minlength=x.n))
    h = hashes.of(np.concatenate([[0], stops[:-1]]) if len(stops) else stops, stops)
    return np.stack([slots(h, LEAD_BITS), slots(mixed(h ^ np.uint64(0x2545F4914F6CDD1D)), LEAD_BITS) + (1 << LEAD_BITS)])


def count_batch(batch: Batch, endings: np.ndarray) -> list[tuple[int, str | None, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, language, slot, count, second count) behind the features, of one batch; its clauses' endings are added to ``endings``."""
    c, out = batch.columns, []
    answers = block([None if f else t for t, f in zip(c["translation_text"], batch.flagged)])
    source = letters(block(c["source_text"]))
    said = clauses(answers)
    own = Letters(said.letters.points, said.row[said.letters.group] if len(said.row) else said.letters.group, batch.n)
    names = sorted({x for x in [*c["source_lang"], *c["target_lang"]] if x})
    code = {x: i for i, x in enumerate(names)}
    per = [(source, _coded(c["source_lang"], code)), (own, _coded(c["target_lang"], code))]
    for bits, kind, parts in ((LANGUAGE_BITS, IS_LANGUAGE, LANGUAGE_GRAMS), (8, IS_SCRIPT, ())):
        total = np.zeros(len(names) << bits, "int64")
        for x, lang in per:
            if kind == IS_SCRIPT:
                pieces = [(tables().script[x.points].astype("int64"), x.group)]
            else:
                hashes = Hashes(x.points)
                pieces = [(slots(h, bits), g) for h, g in (grams(x, k, hashes) for k in parts)]
            for slot, group in pieces:
                owner = lang[group]
                total += np.bincount((owner[owner >= 0] << bits) + slot[owner >= 0], minlength=len(total))
        for name, i in code.items():
            own_part = total[i << bits : (i + 1) << bits]
            held = np.flatnonzero(own_part)
            out.append((kind, name, held, own_part[held], np.zeros(len(held), "int64")))
    refused = letters(block([a if f else None for a, f in zip(batch.answer, batch.flagged)]))
    pair = []
    for x in (refused, own):
        hashes = Hashes(x.points)
        pair.append(sum(np.bincount(slots(grams(x, k, hashes)[0], REFUSAL_BITS), minlength=1 << REFUSAL_BITS) for k in REFUSAL_GRAMS))
    held = np.flatnonzero(pair[0] + pair[1])
    out.append((IS_REFUSAL, None, held, pair[0][held], pair[1][held]))
    told = Counter(t for t in c["instruction"] if t)
    leads = clauses(block(list(told)))
    times = np.array(list(told.values()), "int64")
    held, where = np.unique(_clause_slots(leads.letters, Hashes(leads.letters.points)), return_inverse=True)
    said_in = np.bincount(where.ravel(), np.tile(times[leads.row], 2), len(held)).astype("int64")
    slot = np.append(held, ALL_ROWS)
    out.append((IS_LEAD, None, slot, np.append(said_in, batch.n), np.zeros(len(slot), "int64")))
    x = said.letters
    if len(x.points):
        hashes = Hashes(x.points)
        starts = np.flatnonzero(np.concatenate([[True], x.group[1:] != x.group[:-1]]))
        stops = np.append(starts[1:], len(x.points))
        first = np.repeat(starts, stops - starts)
        at = np.arange(1, len(x.points) + 1)
        done = np.zeros(len(at), bool)
        done[stops - 1] = True
        used = ~done | np.repeat(said.closed, stops - starts)
        lang = _text_hash(c["target_lang"])[own.group]
        ended = done[used]
        for size in ENDINGS:
            for slot in _ending_slots(x, at[used], first[used], lang[used], size, hashes):
                np.add.at(endings[0], slot[~ended], 1)
                np.add.at(endings[1], slot[ended], 1)
    return out


def ending_counts(endings: np.ndarray) -> tuple[int, None, np.ndarray, np.ndarray, np.ndarray]:
    """The counts of endings in the form of the others."""
    held = np.flatnonzero(endings.any(0))
    return IS_ENDING, None, held, endings[0, held].astype("int64"), endings[1, held].astype("int64")


class Statistics:
    """Counts over all rows behind the features; of fixed size for each language, whatever the number of rows."""

    def __init__(self, counts: pa.Table | list[tuple]) -> None:
        if isinstance(counts, pa.Table):
            kinds, langs = counts.column("kind").to_numpy(), np.array(counts.column("lang").to_pylist(), object)
            slot, n, m = (counts.column(x).to_numpy() for x in ("slot", "n", "m"))
            parts = []
            for kind in range(5):
                for lang in sorted({x for x in langs[kinds == kind] if x}) if kind < IS_REFUSAL else [None]:
                    held = (kinds == kind) & ((langs == lang) if lang else True)
                    parts.append((kind, lang, slot[held], n[held], m[held]))
        else:
            parts = counts
        self.languages = sorted({p[1] for p in parts if p[1]})
        if len(self.languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        self.code = {x: i for i, x in enumerate(self.languages)}
        k = len(self.languages)
        tally, scripts = np.full((k, 1 << LANGUAGE_BITS), 0.05), np.zeros((k, 256))
        refusal, ends = np.zeros((2, 1 << REFUSAL_BITS)), np.zeros((2, (2 * len(ENDINGS)) << ENDING_BITS), "float32")
        leads = np.zeros(ALL_ROWS + 1)
        for kind, lang, slot, n, m in parts:
            if kind == IS_LEAD:
                np.add.at(leads, slot, n)
            elif kind == IS_LANGUAGE:
                np.add.at(tally[self.code[lang]], slot, n)
            elif kind == IS_SCRIPT:
                np.add.at(scripts[self.code[lang]], slot, n)
            else:
                into = refusal if kind == IS_REFUSAL else ends
                np.add.at(into[0], slot, n)
                np.add.at(into[1], slot, m)
        self.language = np.log(tally / tally.sum(1, keepdims=True)).astype("float32") if k else np.zeros((0, 1 << LANGUAGE_BITS), "float32")
        self.usual = scripts > USUAL_SCRIPT * scripts.sum(1, keepdims=True)
        r, g = refusal.sum(1)
        share = refusal.sum(0) / max(1.0, r + g)
        odds = np.log((refusal[0] / max(r, 1.0) + share + 1e-12) / (refusal[1] / max(g, 1.0) + share + 1e-12)) if r and g else np.zeros(1 << REFUSAL_BITS)
        self.refusal = np.clip(odds, -3, 3).astype("float32")
        self.lead = leads[:ALL_ROWS] > LEAD_SHARE * leads[ALL_ROWS]
        # An ending has a slot in either of two tables; the one with fewer counts holds fewer of other endings.
        self.end_count = np.log1p(ends.sum(0)).astype("float16")
        self.end = np.log((ends[1] + 0.2) / (ends[0] + 0.2)).astype("float16")

    @classmethod
    def of_rows(cls, rows: list[dict]) -> Statistics:
        """Statistics of rows in memory."""
        endings = no_endings()
        return cls([*count_batch(Batch.of_rows(rows), endings), ending_counts(endings)])


def _shares(x: Letters, table: np.ndarray, sizes: tuple[int, ...], bits: int, hashes: Hashes) -> np.ndarray:
    """Mean over each group's grams of each row of a table by slot; 0 without grams."""
    total, count = np.zeros((len(table), x.n)), np.zeros(x.n)
    for size in sizes:
        h, group = grams(x, size, hashes)
        slot = slots(h, bits)
        count += np.bincount(group, minlength=x.n)
        for k, row in enumerate(table):
            total[k] += np.bincount(group, row[slot], x.n)
    return total / np.maximum(count, 1)


def _pairs_held(x: Letters, row: np.ndarray, by: Letters) -> np.ndarray:
    """Share of each clause's pairs of letters that also stand in its row's other text; ``row`` is the row of each letter."""

    def keys(z: Letters, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(z.group[:-1] == z.group[1:]) if len(z.points) > 1 else np.zeros(0, "int64")
        p = z.points.astype("int64")
        return (group[at] << 42) | (p[at] << 21) | p[at + 1], z.group[at]

    known = np.unique(keys(by, by.group)[0])
    own, clause = keys(x, row)
    found = np.isin(own, known)
    return np.bincount(clause, found, x.n) / np.maximum(np.bincount(clause, minlength=x.n), 1)


def features(stats: Statistics, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each clause of the batch's answers, its row, and its letters.

    A clause that instructions often hold (in ``LEAD_SHARE`` of all rows) leads in to the answer and counts no letters, where others follow. A row that the provider classed as refused has a clause without letters where its answer has none.
    """
    c, n = batch.columns, batch.n
    said = clauses(block(batch.bare()))
    lone = np.setdiff1d(np.flatnonzero(batch.flagged), said.row)
    source_block = block(c["source_text"])
    asked = clauses(source_block)
    source_mark, mark = asked.row_mark, said.row_mark
    n_source = np.bincount(asked.row, minlength=n)
    source = Letters(asked.letters.points, asked.row[asked.letters.group] if len(asked.row) else asked.letters.group, n)
    x, row = said.letters, said.row
    k = len(row)
    letter_row = row[x.group] if k else x.group
    hashes = Hashes(x.points)
    size = np.bincount(x.group, minlength=k)
    target = _coded(c["target_lang"], stats.code)
    odds = np.zeros(k)
    if len(stats.languages) > 1 and k:
        scores = _shares(x, stats.language, LANGUAGE_GRAMS, LANGUAGE_BITS, hashes)
        own = target[row]
        at = np.arange(k)
        mine = scores[np.maximum(own, 0), at]
        scores[np.maximum(own, 0), at] = -np.inf
        odds = np.where(own >= 0, mine - scores.max(0), 0.0)
    strange = np.zeros(k)
    if len(stats.languages) and k:
        own = target[letter_row]
        odd = (own >= 0) & ~stats.usual[np.maximum(own, 0), tables().script[x.points]]
        strange = np.bincount(x.group, odd, k) / np.maximum(size, 1)
    refusal = _shares(x, stats.refusal[None], REFUSAL_GRAMS, REFUSAL_BITS, hashes)[0] if k else np.zeros(0)
    echo = _pairs_held(x, letter_row, source)
    told: dict[str, int] = {}
    instruction = np.array([told.setdefault(t or "", len(told)) for t in c["instruction"]], "int64")
    repeated = _pairs_held(x, instruction[letter_row], letters(block(list(told)))) if k else np.zeros(0)
    leads = stats.lead[_clause_slots(x, hashes)].all(0) if k else np.zeros(0, bool)
    follow = np.bincount(row, ~leads, minlength=n) > 0
    per_row = np.bincount(row, minlength=n)
    first = np.concatenate([[True], row[1:] != row[:-1]]) if k else np.zeros(0, bool)
    last = np.append(first[1:], True) if k else first
    top = np.full(n, -9.0)
    np.maximum.at(top, row, refusal)
    open_end = last & (mark[row] == 0)
    soft = (mark[row] == 0) | (mark[row] >= 4)
    asks = last & soft & (mark[row] != source_mark[row]) | open_end
    ends, known = np.zeros(k), np.ones(k, bool)
    if asks.any():
        stops = np.cumsum(size)[asks]
        begins = stops - size[asks]
        lang = _text_hash(c["target_lang"])[row[asks]]
        value, seen = np.zeros(len(stops)), np.zeros(len(stops), bool)
        for length in ENDINGS:
            one, two = _ending_slots(x, stops, begins, lang, length, hashes)
            slot = np.where(stats.end_count[one] <= stats.end_count[two], one, two)
            new = ~seen & (stats.end_count[slot] > 0.7)  # more than once
            value[new], seen[new] = stats.end[slot[new]], True
        ends[asks], known[asks] = value, seen
    whole_source = source_mark[row] == 0
    flagged = batch.flagged[row]
    columns = [
        np.ones(k), first, last, per_row[row] == 1,
        np.clip(odds, -1.5, 1.5), odds > 0.3, odds < -0.3,
        echo, echo >= 0.85, echo < 0.3, (repeated >= 0.9) | leads, (echo >= 0.85) & (odds < 0),
        np.clip(refusal, -1.5, 1.5), refusal > 0.3, refusal > 1.0, top[row] > 1.0, (top[row] > 1.0) & (refusal > 0), flagged, strange, strange > 0.5,
        open_end, open_end & ~whole_source, open_end & whole_source,
        last & batch.broken[row], np.clip(ends, -6, 4) / 4, ~known, ends < -1.9, ends > -1, open_end & whole_source & (ends > 0), open_end & whole_source & (ends < -1.9), open_end & whole_source & (ends < -3.2),
        last & (mark[row] >= 4) & (mark[row] != source_mark[row]), last & (per_row[row] < n_source[row]), size < 3,
    ]
    out = np.stack([np.asarray(col, "float64") for col in columns], 1) if k else np.zeros((0, len(columns)))
    size = np.where(leads & follow[row], 0, size) if k else size
    if len(lone):
        extra = np.zeros((len(lone), out.shape[1]))
        extra[:, [0, 1, 2, 3, 17]] = 1.0
        order = np.argsort(np.concatenate([row, lone]), kind="stable")
        out, row, size = np.concatenate([out, extra])[order], np.concatenate([row, lone])[order], np.concatenate([size, np.ones(len(lone), "int64")])[order]
    return out, row, size


def examples(stats: Statistics, rows: list[dict], seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tagged sequences: labelled refusals, with and without their label, and sound answers as they are and spoilt in known ways."""
    rng = random.Random(seed)
    batch = Batch.of_rows(rows)
    x, row, _ = features(stats, batch)
    odds, refusal = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
    np.minimum.at(odds, row, x[:, 4])
    np.maximum.at(refusal, row, x[:, 12])
    made: list[tuple[dict, int, bool]] = []  # row, tag, whether the last clause alone has it

    def sound(i: int, r: dict) -> bool:
        text = r["translation_text"] or ""
        same_end = bool(_last_mark(text)) or not _last_mark(r["source_text"] or "")
        bare = plain(text)
        return bool(bare) and r["error_classification"] is None and bare != plain(r["source_text"]) and same_end and not PLACEHOLDER.fullmatch(text) and odds[i] > 0 and refusal[i] < 0.7 and not batch.broken[i]

    good = [r for i, r in enumerate(rows) if sound(i, r)]
    refused = [i for i in range(len(rows)) if batch.flagged[i]]
    texts = sorted({batch.answer[i] for i in refused if plain(batch.answer[i])})
    for i in refused:
        made.append((rows[i], 1, False))
        made.append((rows[i] | {"error_classification": None}, 1, False))
    for r in [*(rows[i] for i in refused), *good[:FLAGGED_EMPTY]]:
        made.append((r | {"translation_text": None, "content": None, "error_classification": REFUSED}, 1, False))
    for r in good:
        made.append((r | {"content": None}, 0, False))
        text, spoil = r["translation_text"], rng.random()
        if spoil < (0.12 if _last_mark(r["source_text"] or "") else 0.2):  # broken off inside a clause, oftener where no mark is due
            spots = [m.end() for m in re.finditer(r"\w", text) if m.end() < len(text.rstrip("。！？.!?…—” 」")) and m.end() > 1]
            if spots:
                made.append((r | {"translation_text": text[: rng.choice(spots)], "content": "{" if rng.random() < 0.4 else None}, 4, True))
        elif spoil < 0.3:
            lead = rng.choice(["", (r["instruction"] or "") + " "])
            made.append((r | {"translation_text": lead + rng.choice([r["source_text"] or "", plain(r["source_text"]), f" {r['source_text'] or ''}\n"]), "content": None}, 2, False))
        elif spoil < 0.5:
            other = rng.choice(good)
            if other["target_lang"] != r["target_lang"]:
                made.append((r | {"translation_text": other["translation_text"], "content": None}, 3, False))
        elif spoil < 0.65 and texts:
            some = [rng.choice(texts)] * rng.choice([1, 1, 1, 2]) if rng.random() < 0.8 else [rng.choice(texts), rng.choice(texts)]
            made.append((r | {"translation_text": " ".join(some), "content": None}, 1, False))
    if not made:
        return []
    x, row, _ = features(stats, Batch.of_rows([m[0] for m in made]))
    edges = np.flatnonzero(np.diff(row)) + 1
    out = []
    for part, lo in zip(np.split(x, edges), [0, *edges.tolist()]):
        _, tag, last_only = made[row[lo]]
        y = np.zeros(len(part), int) if last_only else np.full(len(part), tag)
        y[-1] = tag
        out.append((part, y))
    return out


def _last_mark(text: str) -> str:
    return MARKS[int(clauses(block([text])).row_mark[0])]


class Judge:
    """A fitted field with its statistics: some 30 MB and a quarter of a megabyte for each language, whatever the table's size."""

    def __init__(self, stats: Statistics, rows: list[dict]) -> None:
        self.stats = stats
        known = examples(stats, rows)
        self.field = crf.fit(known, len(TAGS)) if known else None

    @classmethod
    def of_rows(cls, rows: list[dict]) -> Judge:
        """A judge whose statistics and field both come from rows in memory."""
        return cls(Statistics.of_rows(rows), rows)

    def defects(self, batch: Batch) -> list[str | None]:
        """The defect of each pair, null for a sound one."""
        n = batch.n
        x, row, size = features(self.stats, batch)
        tags = crf.decode_many(self.field, x, row) if self.field is not None else batch.flagged[row].astype("int64")
        weight = np.zeros((len(TAGS), n))
        np.add.at(weight, (tags, row), size)
        total = np.maximum(weight.sum(0), 1)
        unfinished = np.zeros(n, bool)
        if len(row):
            last = np.append(row[1:] != row[:-1], True)
            unfinished[row[last]] = tags[last] == 4
        answers, sources = letters(block(batch.answer)), letters(block(batch.columns["source_text"]))
        n_answer, n_source = (np.bincount(z.group, minlength=n) for z in (answers, sources))
        out = np.full(n, None, object)
        for kind, holds in (
            ("wrong_language", weight[3] >= SHARE * total),
            ("truncated", unfinished),
            ("source_copy", (weight[2] >= SHARE * total) & (n_source > 0)),
        ):
            out[holds] = kind
        out[weight[1] >= np.maximum(REFUSAL_SHARE * total, 1)] = "refusal"
        for i in np.flatnonzero((n_answer <= PLACEHOLDER_LETTERS) & ~batch.flagged).tolist():
            answer = batch.answer[i]
            if not n_answer[i] or PLACEHOLDER.fullmatch(answer):
                kept = answer.strip() and not n_source[i] and not n_answer[i]
                visible = any(unicodedata.category(ch)[0] not in "CZ" for ch in answer)
                out[i] = None if kept and visible else "empty"
        return out.tolist()

    def defect(self, row: dict) -> str | None:
        """The defect of one pair."""
        return self.defects(Batch.of_rows([row]))[0]


def _batches(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """Slices of bounded rows and text; a longer text is a slice of its own."""
    for whole in batches:
        if not whole.num_rows:
            continue
        size = np.zeros(whole.num_rows, "int64")
        for c in TEXTS:
            size += pc.fill_null(pc.binary_length(whole.column(c)), 0).to_numpy(zero_copy_only=False)
        part = np.maximum(np.cumsum(size) // CHUNK_BYTES, np.arange(whole.num_rows) // CHUNK_ROWS)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            piece = whole.slice(lo, hi - lo)
            yield piece, Batch({c: piece.column(c).to_pylist() for c in names})


def count_rows(rows: DataFrame) -> DataFrame:
    """The counts of ``count_batch`` over all rows; each task adds up its own first, so at most the slots are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        endings = no_endings()

        def summed(parts: list[tuple]) -> tuple:
            slot, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return (slot, *[np.bincount(where, np.concatenate([p[i] for p in parts]), len(slot)).astype("int64") for i in (1, 2)])

        for _, batch in _batches(batches, TEXTS):
            for kind, lang, slot, n, m in count_batch(batch, endings):
                parts = held.setdefault((kind, lang), [])
                parts.append((slot, n, m))
                if len(parts) >= 16:
                    held[(kind, lang)] = [summed(parts)]
        if endings.any():
            kind, lang, *counts = ending_counts(endings)
            held[(kind, lang)] = [tuple(counts)]
        for (kind, lang), parts in held.items():
            slot, n, m = summed(parts)
            langs = pa.array([lang] * len(slot), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), kind, "int32")), langs, pa.array(slot.astype("int32")), pa.array(n), pa.array(m)], [c.split()[0] for c in COUNT_SCHEMA.split(", ")])

    parts = shipped(rows.select(*TEXTS)).mapInArrow(count, COUNT_SCHEMA)
    return parts.groupBy("kind", "lang", "slot").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def sample_rows(rows: DataFrame, fit_rows: int = FIT_ROWS, fit_refusals: int = FIT_REFUSALS, fit_chars: int = FIT_CHARS) -> list[dict]:
    """The rows that the field's weights are fitted on: of the labelled refusals ``fit_refusals`` and of the others
    ``fit_rows`` with the smallest hashes of their ids, none with a text of more than ``fit_chars`` characters."""
    short = F.col("translation_id").isNotNull()
    for c in TEXTS:
        short = short & (F.coalesce(F.length(c), F.lit(0)) <= fit_chars)
    refused = F.coalesce(F.col("error_classification") == REFUSED, F.lit(False))
    held = rows.where(short).select(*COLUMNS)
    pick = lambda df, n: df.orderBy(F.xxhash64("translation_id"), "translation_id", *TEXTS).limit(n)
    return [r.asDict() for r in pick(held.where(~refused), fit_rows).unionByName(pick(held.where(refused), fit_refusals)).collect()]


def fit_judge(rows: DataFrame, fit_rows: int = FIT_ROWS, fit_refusals: int = FIT_REFUSALS, fit_chars: int = FIT_CHARS) -> Judge:
    """A judge with counts over all rows and a field fitted on the bounded sample of ``sample_rows``.

    What reaches the driver is the sample and at most a row a slot: 65,792 a language, 262,144 for refusals, 6,291,456 for
    endings and 2,097,152 for clauses of instructions.
    """
    stats = Statistics(count_rows(rows).toArrow())
    return Judge(stats, sample_rows(rows, fit_rows, fit_refusals, fit_chars))


def find_defects(rows: DataFrame, fit_rows: int = FIT_ROWS, fit_refusals: int = FIT_REFUSALS, fit_chars: int = FIT_CHARS) -> DataFrame:
    """``translation_id, defect_type`` of every defective pair, once however often it was delivered.

    Of several deliveries of one id the latest by ``loaded_at`` counts (where rows have that column; of equally late ones
    a defective one). Rows without an id are no pairs. Null texts count as empty ones, a null source matches nothing,
    unknown languages never give ``wrong_language``. An empty table gives no rows; extra columns are not read. Every row
    is judged whole; only the field's weights come from a sample.
    """
    held = rows.sparkSession.sparkContext.broadcast(fit_judge(rows, fit_rows, fit_refusals, fit_chars))
    when = F.col("loaded_at").cast("timestamp_ltz") if "loaded_at" in rows.columns else F.lit(None).cast("timestamp_ltz")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, batch in _batches(batches, TEXTS):
            kinds = pa.array(held.value.defects(batch), pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("translation_id"), piece.column("moment"), kinds], ["translation_id", "moment", "defect_type"])

    # Verdicts, not texts, are shuffled.
    known = rows.where(F.col("translation_id").isNotNull()).select(F.col("translation_id").cast("long"), F.unix_micros(when).alias("moment"), *TEXTS)
    judged = shipped(known).mapInArrow(judge, "translation_id long, moment long, defect_type string")
    last = judged.groupBy("translation_id").agg(F.max(F.struct("moment", "defect_type"))["defect_type"].alias("defect_type"))
    return last.where(F.col("defect_type").isNotNull())
