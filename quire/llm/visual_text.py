"""One form for texts that look the same.

A batch of Arrow strings becomes one array of code points. Table gathers fold width, spaces and shapes, drop what shows
nothing and expand what decomposes (expansion offsets from a cumulative sum); marks are then put in canonical order and
composed by searches in a table of pairs. No step calls anything per row.

There are two forms. The consistent form is a text to keep: canonical composition (NFC) after dropping invisible
characters, turning every kind of space into U+0020, full- and half-width forms into their plain ones, and CJK radicals
and compatibility ideographs into the ideographs. Letters of other scripts that look alike are put right only where
their neighbours leave no doubt: between katakana, and in words that also hold Latin letters. The look key is for
comparing: it folds look-alikes everywhere, so that texts the eye cannot tell apart have one key, but it is no text to read.
Case, accents, voicing marks, kana size and punctuation stay in both; spaces at either end, which no eye sees, go.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.session import ship_package

# Look-alike characters, each followed by the one they are read as.
LETTERS_ALIKE = {
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹονρϲ": "ABEZHIKMNOPTYXCovpc",  # Greek
    "АВЕКМНОРСТХЅІЈУԌԚԜ": "ABEKMHOPCTXSIJYGQW",  # Cyrillic capitals
    "аеорсухѕіјһԁԛԝ": "aeopcyxsijhdqw",  # Cyrillic small
    "ՏօսհՕ": "SouhO",  # Armenian
    "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ": "ABCDEHJKLMPRSTVWZ",  # Cherokee
    "ɑɡıȷ": "agij",  # IPA and dotless letters
}
KANA_ALIKE = {"力口囗夕卜工二八一丿りへ": "カロロタトエニハーノリヘ"}  # ideographs, hiragana and katakana
SIGNS_ALIKE = {"‐‑−": "---", "―": "—"}  # hyphens and dashes
# Characters with no mark on the page besides those of category Cf and Cc.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
KANA_RANGES = ((0x30A1, 0x30FB), (0x30FC, 0x30FF), (0x31F0, 0x3200))
WIDTH_TAGS = ("<wide>", "<narrow>")
SHAPE_RANGES = ((0x2E80, 0x2FDF), (0xFB00, 0xFB06), (0x2160, 0x217F))  # CJK radicals, Latin ligatures, Roman numerals
CHUNK_BYTES = 2_000_000
FOREIGN_SCRIPTS = ("GREEK ", "CYRILLIC ", "ARMENIAN ", "CHEROKEE ")
VOICING = {0x309B: 0x3099, 0x309C: 0x309A}  # spacing forms of the voicing marks


class _Tables(NamedTuple):
    count: np.ndarray
    single: np.ndarray
    start: np.ndarray
    flat: np.ndarray
    mark: np.ndarray
    pair: np.ndarray
    composed: np.ndarray


def _alike(*groups: dict[str, str]) -> dict[int, int]:
    return {ord(a): ord(b) for g in groups for many, ones in g.items() for a, b in zip(many, ones)}


def fold_one(cp: int, look: bool) -> list[int]:
    """What one code point becomes before marks are composed; with ``look`` look-alikes and styled letters fold too."""
    kind = unicodedata.category(chr(cp))
    if cp in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85) or kind in ("Zs", "Zl", "Zp"):
        return [0x20]
    if cp in _hidden() or kind in ("Cf", "Cc"):
        return []
    if cp in VOICING:
        return [VOICING[cp]]
    alike = alike_folds(look)
    if cp in alike:
        return [alike[cp]]
    parts = unicodedata.decomposition(chr(cp)).split()
    if parts and parts[0][0] == "<":
        shape = parts[0] == "<compat>" and any(a <= cp <= b for a, b in SHAPE_RANGES)
        style = look and parts[0] == "<font>"
        parts = parts[1:] if parts[0] in WIDTH_TAGS or shape or style else []
    if parts:
        return [x for p in parts for x in fold_one(int(p, 16), look)]
    return [cp]


@lru_cache(maxsize=1)
def _hidden() -> set[int]:
    return set(map(ord, INVISIBLE)) | {*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


@lru_cache(maxsize=2)
def alike_folds(look: bool) -> dict[int, int]:
    """Look-alikes that fold whatever their neighbours, by code point."""
    return _alike(SIGNS_ALIKE, LETTERS_ALIKE, KANA_ALIKE) if look else _alike(SIGNS_ALIKE)


@lru_cache(maxsize=2)
def _tables(look: bool) -> _Tables:
    """Lookup tables over all code points, made once a process from the Unicode data of the interpreter."""
    size = 0x110000
    count, single, start = np.ones(size, "uint8"), np.arange(size, dtype="uint32"), np.zeros(size, "int32")
    mark = np.zeros(size, "uint8")
    alike = alike_folds(look)
    flat: list[int] = []
    pairs: dict[int, int] = {}
    for cp in [*range(0x30000), *range(0xE0000, 0xE0200)]:
        if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0x9FFF and cp not in alike:
            continue
        char = chr(cp)
        mark[cp] = unicodedata.combining(char)
        to = fold_one(cp, look)
        count[cp] = len(to)
        if len(to) == 1:
            single[cp] = to[0]
        elif to:
            start[cp] = len(flat)
            flat.extend(to)
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", char) == char:
            pairs[(int(parts[0], 16) << 21) | int(parts[1], 16)] = cp
    keys = np.array(sorted(pairs), "int64")
    return _Tables(count, single, start, np.array(flat or [0], "uint32"), mark, keys, np.array([pairs[k] for k in keys.tolist()], "uint32"))


class _Context(NamedTuple):
    """By code point: part of a word, Latin, Greek or Cyrillic and such, what it folds to; katakana, what it folds to between them."""

    word: np.ndarray
    latin: np.ndarray
    foreign: np.ndarray
    letter: np.ndarray
    kana: np.ndarray
    between: np.ndarray


@lru_cache(maxsize=1)
def _context() -> _Context:
    size = 0x110000
    word, latin, foreign, kana = (np.zeros(size, bool) for _ in range(4))
    letter, between = np.zeros(size, "uint32"), np.zeros(size, "uint32")
    for cp in range(0x30000):
        if 0x3400 <= cp < 0xE000:
            word[cp] = cp < 0xD7A4
            continue
        char = chr(cp)
        if unicodedata.category(char)[0] in "LM":
            word[cp] = True
            name = unicodedata.name(char, "")
            latin[cp] = name.startswith("LATIN ")
            foreign[cp] = name.startswith(FOREIGN_SCRIPTS)
    for lo, hi in KANA_RANGES:
        kana[lo:hi] = True
    for table, groups in ((letter, LETTERS_ALIKE), (between, KANA_ALIKE)):
        for a, b in _alike(groups).items():
            table[a] = b
    return _Context(word, latin, foreign, letter, kana, between)


class CodePoints(NamedTuple):
    """Code points of many texts, the row of each and the place in its original text."""

    points: np.ndarray
    row: np.ndarray
    place: np.ndarray


def read_points(texts: pa.Array) -> CodePoints:
    """Code points of an Arrow string array; null rows have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], "int64", n + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", "uint8")[offsets[0] : offsets[-1]] if n else np.zeros(0, "uint8")
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "uint32")
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    at = heads[offsets - offsets[0]] if n else np.zeros(1, "int64")
    lengths = np.diff(at)
    return CodePoints(points, np.repeat(np.arange(n), lengths), np.arange(len(points)) - np.repeat(at[:-1], lengths))


def write_points(points: np.ndarray, row: np.ndarray, valid: pa.Array) -> pa.Array:
    """Arrow strings of code points in row order; rows not ``valid`` are null."""
    n = len(valid)
    data = points.astype("uint32").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype("int64") + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, width, n).astype("int64"))])
    out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype("int64")), pa.py_buffer(data)).cast(pa.string())
    return pc.if_else(valid, out, pa.scalar(None, pa.string()))


def _runs(part: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of runs of ``part`` within rows."""
    joined = part[1:] & part[:-1] & (row[1:] == row[:-1])
    first, last = part.copy(), part.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def settle_points(text: CodePoints) -> CodePoints:
    """Look-alikes put right where their neighbours leave no doubt.

    Between two katakana all of a run of ideographs and such that look like katakana become katakana. In a word with Latin
    letters all letters of other scripts become Latin, if each of them has a Latin look-alike.
    """
    t, points, row = _context(), text.points, text.row
    n = len(points)
    if n < 2 or not (t.letter[points].any() or t.between[points].any()):
        return text
    points = points.copy()
    lo, hi = _runs(t.between[points] > 0, row)
    if len(lo):
        inner = (lo > 0) & (hi < n)
        lo, hi = lo[inner], hi[inner]
        inner = t.kana[points[lo - 1]] & t.kana[points[hi]] & (row[lo - 1] == row[lo]) & (row[hi] == row[lo])
        lo, hi = lo[inner], hi[inner]
        spot = np.zeros(n + 1, "int64")
        spot[lo], spot[hi] = 1, spot[hi] - 1
        at = np.flatnonzero(np.cumsum(spot)[:n])
        points[at] = t.between[points[at]]
    lo, hi = _runs(t.word[points], row)
    if len(lo):
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (t.latin[points], t.foreign[points], t.foreign[points] & (t.letter[points] > 0))]
        latin, foreign, alike = (x[hi] - x[lo] for x in sums)
        doubtless = (latin > 0) & (foreign > 0) & (foreign == alike)
        for a, b in zip(lo[doubtless].tolist(), hi[doubtless].tolist()):
            part = points[a:b]
            part[:] = np.where(t.foreign[part], t.letter[part], part)
    return CodePoints(points, row, text.place)


def fold_points(text: CodePoints, look: bool = True) -> CodePoints:
    """The look key of many texts, or without ``look`` their consistent form; ``place`` keeps where in the original each code point comes from."""
    t = _tables(look)
    n = t.count[text.points].astype("int64")
    first = np.cumsum(n) - n
    points = np.repeat(t.single[text.points], n)
    row, place = np.repeat(text.row, n), np.repeat(text.place, n)
    many = np.flatnonzero(n > 1)
    if len(many):
        times = n[many]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        points[np.repeat(first[many], times) + step] = t.flat[np.repeat(t.start[text.points[many]], times) + step]
    ccc = t.mark[points]
    while True:  # canonical order of marks: each pass swaps neighbours, so passes are as many as marks on one letter
        wrong = np.flatnonzero((ccc[:-1] > ccc[1:]) & (ccc[1:] > 0) & (row[:-1] == row[1:]))
        wrong = wrong[np.concatenate([[True], np.diff(wrong) > 1])] if len(wrong) else wrong
        if not len(wrong):
            break
        for a in (points, place, ccc):
            a[wrong], a[wrong + 1] = a[wrong + 1].copy(), a[wrong].copy()
    while len(points) > 1:  # each pass gives every letter its first mark that composes with it and is not blocked by one of its class
        base = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(points)), -1))
        marks = 1 + np.flatnonzero((ccc[1:] > 0) & ((ccc[:-1] == 0) | (ccc[:-1] < ccc[1:])))
        marks = marks[(base[marks] >= 0) & (row[np.maximum(base[marks], 0)] == row[marks])]
        key = (points[base[marks]].astype("int64") << 21) | points[marks]
        at = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
        fits = t.pair[at] == key
        marks, at = marks[fits], at[fits]
        letters, chosen = np.unique(base[marks], return_index=True)
        if not len(letters):
            break
        points[letters] = t.composed[at[chosen]]
        keep = np.ones(len(points), bool)
        keep[marks[chosen]] = False
        points, row, place, ccc = points[keep], row[keep], place[keep], ccc[keep]
    if len(points):  # spaces at the ends of a row
        filled = np.where(points != 0x20, np.arange(len(points)), -1)
        edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        upto = np.concatenate([edge[1:], [len(points)]])
        last = np.maximum.reduceat(filled, edge)
        lead = np.minimum.reduceat(np.where(filled < 0, len(points), filled), edge)
        index, spans = np.arange(len(points)), upto - edge
        keep = (index >= np.repeat(lead, spans)) & (index <= np.repeat(last, spans))
        points, row, place = points[keep], row[keep], place[keep]
    folded = CodePoints(points, row, place)
    return folded if look else settle_points(folded)


def row_chunks(texts: pa.Array, most_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive rows of about ``most_bytes``, so that the arrays of a step stay small; a longer text is a chunk of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")
    part = np.cumsum(sizes) // most_bytes
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]]) if len(sizes) else np.zeros(1, int)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield lo, hi - lo


def fold_array(texts: pa.Array, look: bool = False) -> pa.Array:
    """Consistent form or look key of an Arrow string array; null stays null."""
    parts = []
    for lo, n in row_chunks(texts):
        piece = texts.slice(lo, n)
        folded = fold_points(read_points(piece), look)
        parts.append(write_points(folded.points, folded.row, piece.is_valid()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _form_udf(texts: pa.Array) -> pa.Array:
    return fold_array(texts)


@F.arrow_udf(StringType())
def _key_udf(texts: pa.Array) -> pa.Array:
    return fold_array(texts, look=True)


def _shipped() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)


def consistent_form(text: Column | str) -> Column:
    """Column of the consistent form. Null gives null; empty and invisible texts give the empty text."""
    _shipped()
    return _form_udf(text)


def look_key(text: Column | str) -> Column:
    """Column of the look key, equal for texts that the eye cannot tell apart. Null gives null."""
    _shipped()
    return _key_udf(text)
