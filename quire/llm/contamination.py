"""Passages of held-out items inside corpus texts.

Texts and items are brought to one form (see ``visual_text``), lower-cased and stripped of everything that is no letter
or digit, so case, punctuation, spacing and line breaks cannot differ. One Aho-Corasick automaton holds, for every
position of every passage, the seed of a few words (characters in Japanese and Chinese) that starts there, and the
questions and answers whole. Seeds that many passages share anchor nothing and are left out, unless a passage would lack
others. The automaton is built once a worker process and block of items, whose size is bounded. Each batch of texts is scanned once as one string. Seeds that go forward together in text
and passage are chained over changed words; a chain that spans enough of the passage is a leak. Offsets are carried
back to the original text through the places that every code point keeps.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.visual_text import CodePoints, fold_points, read_points, row_chunks
from quire.session import shipped

SHARE = 0.4
SEED_WORDS, SEED_CHARS = 3, 5
HOLE_WORDS, HOLE_CHARS = 5, 8
DRIFT = 12
CHANGED = 0.15
#: Characters of items in one automaton: at most some 210 MB and two seconds to build, once in each worker process.
BLOCK_CHARS = 250_000
#: A seed of more passages is common.
MOST_SHARED = 32
#: A question or answer of fewer letters and digits counts only where it stands as words of its own.
SHORT_CHARS = 12
UNSPACED = ("ja", "zh")
#: Scripts that put no spaces between words: Thai and Lao, Burmese, Khmer, kana and Chinese characters.
UNSPACED_RANGES = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3008), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000))
SPAN_SCHEMA = "doc_id long, item_id long, part string, start long, stop long, share double, exact boolean"


@lru_cache(maxsize=1)
def _plain_tables() -> tuple[np.ndarray, np.ndarray]:
    lower, kept = np.arange(0x110000, dtype="uint32"), np.zeros(0x110000, bool)
    for cp in range(0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        kept[cp] = unicodedata.category(chr(cp))[0] in "LNM"
        small = chr(cp).lower()
        if len(small) == 1:
            lower[cp] = ord(small)
    return lower, kept


def plain_points(texts: pa.Array) -> CodePoints:
    """Letters, marks and digits of each text in one form and lower case, with their places in the original."""
    return _plain_words(texts)[0]


def _plain_words(texts: pa.Array) -> tuple[CodePoints, np.ndarray]:
    """``plain_points`` and which of them go on with the word of the point before; scripts without spaces have no such points."""
    folded = fold_points(read_points(texts))
    lower, kept = _plain_tables()
    at = np.flatnonzero(kept[folded.points])
    text = CodePoints(lower[folded.points[at]], folded.row[at], folded.place[at])
    spaced = np.ones(len(at), bool)
    for lo, hi in UNSPACED_RANGES:
        spaced &= (text.points < lo) | (text.points >= hi)
    inside = np.zeros(len(at), bool)
    inside[1:] = (np.diff(at) == 1) & (text.row[1:] == text.row[:-1]) & spaced[1:] & spaced[:-1]
    return text, inside


def _decoded(points: np.ndarray) -> str:
    return points.astype("uint32").tobytes().decode("utf-32-le")


def plain_text(text: str | None) -> str:
    """Letters, marks and digits of one text in one form and lower case."""
    return _decoded(plain_points(pa.array([text or ""])).points)


def seeds_of(units: list[str], chars: bool) -> list[tuple[str, int, int]]:
    """(pattern, first unit, unit count) of the seeds at every position of a passage; one of fewer units than a seed is one pattern.

    A unit is a word, or a character where ``chars``. A passage without units has none.
    """
    k = SEED_CHARS if chars else SEED_WORDS
    return [("".join(units[i : i + k]), i, min(k, len(units))) for i in range(max(1, len(units) - k + 1))] if units else []


def _unspaced(passage: str | None, lang: str | None) -> bool:
    return lang in UNSPACED or lang is None and len((passage or "").split()) * 12 < len(passage or "")


def passage_units(passage: str | None, lang: str | None) -> tuple[list[str], bool]:
    """Units of a passage in plain form, and whether they are characters."""
    if _unspaced(passage, lang):
        return list(_decoded(plain_points(pa.array([passage or ""])).points)), True
    words = (passage or "").split()
    points = plain_points(pa.array(words, pa.string()))
    whole, lengths = _decoded(points.points), np.bincount(points.row, minlength=len(words)) if words else np.zeros(0, int)
    ends = np.cumsum(lengths)
    return [whole[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist()) if n], False


class Leaks:
    """The automaton of one block of items ``(item_id, lang, passage, question, answer)``.

    Items of one passage share its seeds. Null and empty parts have no pattern; questions and answers are one each,
    however short.
    """

    def __init__(self, items: list[tuple], share: float, most_shared: int = MOST_SHARED) -> None:
        self.share = share
        self.items: list[list[int]] = []  # by passage
        self.units, self.hole, self.before, self.thin = [], [], [], []
        known: dict[tuple, int] = {}
        places: dict[str, list] = defaultdict(list)
        shared: dict[str, int] = defaultdict(int)
        seeds = []
        for item_id, lang, passage, question, answer in items:
            for part, text in (("question", question), ("answer", answer)):
                whole = plain_text(text)
                if whole:
                    places[whole].append((item_id, part, 0, 1))
            units, chars = passage_units(passage, lang)
            key = (chars, *units)
            if key in known:
                self.items[known[key]].append(item_id)
                continue
            known[key] = len(self.items)
            self.items.append([item_id])
            self.units.append(units)
            self.hole.append(HOLE_CHARS if chars else HOLE_WORDS)
            self.before.append(np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype("int64"))
            seeds.append(seeds_of(units, chars))
            for pattern in {x for x, _, _ in seeds[-1]}:
                shared[pattern] += 1
        for p, own in enumerate(seeds):
            rare = np.array([shared[x] <= most_shared for x, _, _ in own], bool)
            self.thin.append(bool(len(rare)) and not rare.all() and self._rare_suffice(rare, len(self.units[p])))
            for (pattern, first, n), keep in zip(own, rare.tolist()):
                if keep or not self.thin[-1]:
                    places[pattern].append((p, "passage", first, n))
        self.automaton = ahocorasick.Automaton()
        for pattern, where in places.items():
            self.automaton.add_word(pattern, (len(pattern), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def _rare_suffice(self, rare: np.ndarray, n_units: int) -> bool:
        """Whether half of the seeds of every stretch that counts as a leak are rare."""
        k = n_units - len(rare) + 1
        window = max(1, int(np.ceil(self.share * n_units)) - k + 1)
        sums = np.concatenate([[0], np.cumsum(rare)])
        return bool((2 * (sums[window:] - sums[:-window]) >= window).all()) if window <= len(rare) else bool(2 * rare.sum() >= len(rare))

    def spans(self, texts: pa.Array) -> list[tuple[int, int, str, int, int, float, bool]]:
        """(row, item, part, start, stop, share, letter by letter) of the leaks in a batch of texts; offsets are of the original, stop excluded."""
        if self.empty or not len(texts):
            return []
        text, inside = _plain_words(texts)
        n = len(texts)
        ends = np.cumsum(np.bincount(text.row, minlength=n)) + np.arange(1, n + 1)  # a break, which no pattern holds, follows each row
        spread = np.zeros(len(text.points) + n, "uint32")
        spread[np.arange(len(text.points)) + text.row] = text.points
        hits: dict[tuple, list] = {}
        whole = _decoded(spread)
        for end, (size, where) in self.automaton.iter(whole):
            hits[(end, size)] = where
        if not hits:
            return []
        at = np.array([k for k in hits], "int64")
        rows = np.searchsorted(ends, at[:, 0], "right")
        found: dict[tuple, list] = defaultdict(list)
        for (end, size), row, wheres in zip(hits, rows.tolist(), hits.values()):
            for item_id, part, first, count in wheres:
                start, stop = end - size + 1, end + 1
                if part != "passage" and size < SHORT_CHARS and (inside[start - row] or stop - row < len(inside) and inside[stop - row]):
                    continue
                found[(row, item_id, part)].append((start, stop, first, first + count))
        out = []
        for (row, of, part), seeds in found.items():
            runs = [(s, e, 1.0, True) for s, e, _, _ in seeds] if part != "passage" else self._chains(of, sorted(seeds), whole)
            for start, stop, part_share, exact in runs:
                places = text.place[[start - row, stop - 1 - row]]
                for item_id in self.items[of] if part == "passage" else [of]:
                    out.append((row, item_id, part, int(places[0]), int(places[1]) + 1, part_share, exact))
        return out

    def _chains(self, passage: int, seeds: list[tuple], text: str) -> list[tuple[int, int, float, bool]]:
        """Stretches of the passage: seeds one after another whose holes are small and as long in the text as in the passage.

        The exact check follows: of the stretch's units, those in holes that the text doesn't have there count as changed.
        """
        units, hole, before, share = self.units[passage], self.hole[passage], self.before[passage], self.share
        chains: list[list[int]] = []  # text start, text stop, first unit, last unit, changed units
        done = []
        for start, stop, first, last in seeds:
            best = None
            for chain in chains:
                if first > chain[2] and last > chain[3] and first - chain[3] <= hole and start >= chain[0]:
                    drift = (start - chain[1]) - (before[first] - before[chain[3]])
                    if abs(drift) <= DRIFT and (best is None or chain[3] > best[3]):
                        best = chain
            if best is not None:
                best[4] += self._changed(units[best[3] : first], text[best[1] : start])
                best[1], best[3] = stop, last
            else:
                chains.append([start, stop, first, last, 0])
            if len(chains) > 64:  # chains that no seed can reach any more
                reach = start - before[-1] - DRIFT
                done += [c for c in chains if c[1] < reach]
                chains = [c for c in chains if c[1] >= reach]
        out = []
        for start, stop, first, last, changed in done + chains:
            if not self.thin[passage] and (last - first) * 2 < share * len(units):
                continue
            more, gone, stop = self._extend(units[last:], text[stop : stop + before[-1] - before[last] + 8 * DRIFT], stop)
            last, changed = last + more, changed + gone
            more, gone, back = self._extend([u[::-1] for u in units[:first][::-1]], text[max(0, start - before[first] - 8 * DRIFT) : start][::-1], 0)
            start, first, changed = start - back, first - more, changed + gone
            if last - first >= share * len(units) and changed <= CHANGED * (last - first):
                whole = last - first == len(units) and not changed and stop - start == before[-1]
                out.append((start, stop, (last - first) / len(units), bool(whole)))
        return out

    @staticmethod
    def _changed(units: list[str], text: str) -> int:
        """How many of the units a hole's text doesn't have in their order."""
        at, missed = 0, 0
        for u in units:
            found = text.find(u, at, at + len(u) + DRIFT)
            if found < 0:
                missed += 1
            else:
                at = found + len(u)
        return missed

    @staticmethod
    def _extend(units: list[str], text: str, stop: int) -> tuple[int, int, int]:
        """Units that go on past a chain's end, over single changed ones; with the changed count and the new text end."""
        n = changed = at = 0
        while n < len(units):
            if text.startswith(units[n], at):
                at, n = at + len(units[n]), n + 1
                continue
            if n + 2 >= len(units):
                break
            after = text.find(units[n + 1] + units[n + 2], at, at + len(units[n]) + DRIFT + len(units[n + 1]) + len(units[n + 2]))
            if after < 0:
                break
            at, n, changed = after, n + 1, changed + 1
        return n, changed, stop + at


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """Items in blocks of about ``block_chars`` characters of passages, questions and answers, each small enough to be broadcast."""
    columns = ["item_id", "lang", "passage", "question", "answer"]
    size = F.lit(0)
    for c in columns[2:]:
        size = size + F.coalesce(F.length(c), F.lit(0))
    total = items.select(F.sum(size).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_chars))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select(*columns).distinct().collect()
        yield sorted((tuple(r) for r in rows if r["item_id"] is not None), key=repr)


_BUILT: dict[tuple, Leaks] = {}


def built(block: list[tuple], key: tuple) -> Leaks:
    """The automaton of a block, built once in a worker process for all of its tasks; the one before goes."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Leaks(block, key[1], key[2])
    return _BUILT[key]


def find_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, block_chars: int = BLOCK_CHARS, most_shared: int = MOST_SHARED) -> DataFrame:
    """Every stretch of an item's passage (``share`` of it at least), question or answer in ``documents(doc_id, text)``.

    Columns of ``SPAN_SCHEMA``; ``exact`` says that the whole part stands there letter by letter. A question or answer of
    fewer than ``SHORT_CHARS`` letters and digits is listed wherever it stands as words of its own, and at every place in
    scripts without spaces. Null and empty texts hold nothing; a document delivered twice is listed once; items without a
    passage match by question and answer only. Texts are scanned whole, once a block of items.
    """
    context = documents.sparkSession.sparkContext
    texts = documents.select("doc_id", "text")
    names = [c.split()[0] for c in SPAN_SCHEMA.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
    parts = []
    for block in item_blocks(items, block_chars):
        held = context.broadcast(block)
        key = (hashlib.sha256(repr(block).encode("utf-8", "replace")).hexdigest(), share, most_shared)

        def scan(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            leaks = built(held.value, key)
            for batch in batches:
                for lo, n in row_chunks(batch.column("text")):  # rows scanned as one string
                    piece = batch.slice(lo, n)
                    spans = leaks.spans(piece.column("text"))
                    if spans:
                        rows, *rest = zip(*spans)
                        doc_ids = piece.column("doc_id").take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), *[pa.array(c, k) for c, k in zip(rest, kinds)]], names)

        parts.append(shipped(texts).mapInArrow(scan, SPAN_SCHEMA))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.distinct()
