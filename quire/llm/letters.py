"""Many texts as one array of code points: letters, words' neighbours and clauses found by table gathers, with no call per row.

Texts are joined with U+0000 after each, brought to compatibility form and lower case in one call, and read as one array.
Hashes of stretches come from one running sum: with an odd base every power has an inverse modulo 2^64, so the hash of any
stretch is a difference of two sums times a power, whatever its length.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np

SIZE = 0x110000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MARKS = ("", ".", "!", "?", "~", "-")
# Closing marks of clauses after compatibility form, what may follow a clause's mark, and other ends.
ENDERS = "。.!?．！？｡…"
JOINERS = "'’-"
CLOSERS = "\"'”’」』)]】》"
MARK_OF = {"。": 1, ".": 1, "!": 2, "?": 3, "♪": 4, "~": 4, "—": 5, "―": 5}


class Tables(NamedTuple):
    """By code point: letter or digit, script (an index of ``scripts``), white space, clause end, closing mark, end mark, and
    the kind of word it is part of: 0 none, 1 letters of most scripts, 2 ideographs, 3 hiragana, 4 katakana."""

    letter: np.ndarray
    script: np.ndarray
    scripts: list[str]
    space: np.ndarray
    ender: np.ndarray
    closer: np.ndarray
    mark: np.ndarray
    word: np.ndarray


@lru_cache(maxsize=1)
def tables() -> Tables:
    """Made once a process from the Unicode data of the interpreter."""
    letter, space = np.zeros(SIZE, bool), np.zeros(SIZE, bool)
    script, names = np.zeros(SIZE, "uint8"), {"?": 0}
    ender, closer, mark = np.zeros(SIZE, bool), np.zeros(SIZE, bool), np.zeros(SIZE, "uint8")
    word = np.zeros(SIZE, "uint8")
    cjk = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x32000))
    for lo, hi in cjk:
        letter[lo:hi] = True
        word[lo:hi] = 2
        script[lo:hi] = names.setdefault("CJK", len(names))
    word[0xAC00:0xD7A4] = 1
    letter[0xAC00:0xD7A4], script[0xAC00:0xD7A4] = True, names.setdefault("HANGUL", len(names))
    for cp in [*range(0x3400), *range(0x4DC0, 0x4E00), *range(0xA000, 0xAC00), *range(0xF900, 0x20000)]:
        char = chr(cp)
        if char.isalnum():
            letter[cp] = True
            word[cp] = char.isalpha()
            name = unicodedata.name(char, "?").split(" ", 1)[0].split("-", 1)[0]
            name = "KANA" if name in ("HIRAGANA", "KATAKANA") else name
            script[cp] = names.setdefault(name, len(names)) if len(names) < 255 or name in names else 0
        elif char.isspace():
            space[cp] = True
    for lo, hi, kind in ((0x3041, 0x30A0, 3), (0x30A1, 0x30FB, 4), (0x30FC, 0x30FD, 4), (0x3005, 0x3006, 2)):
        word[lo:hi] = kind
    for c in ENDERS:
        ender[ord(c)] = True
    for c in CLOSERS:
        closer[ord(c)] = True
    for c, k in MARK_OF.items():
        mark[ord(c)] = k
    return Tables(letter, script, list(names), space, ender, closer, mark, word)


class Block(NamedTuple):
    """Joined texts: code points (0 after each text) and the row of each."""

    points: np.ndarray
    row: np.ndarray
    n: int


def block(texts: list[str | None], compatible: bool = True) -> Block:
    """Texts in compatibility form (unless not asked for) and lower case; null texts are empty."""
    n = len(texts)
    whole = "\0".join([t or "" for t in texts]) + "\0"
    if whole.count("\0") != n:
        whole = "\0".join([(t or "").replace("\0", " ") for t in texts]) + "\0"
    whole = unicodedata.normalize("NFKC", whole) if compatible else whole
    points = np.frombuffer(whole.lower().encode("utf-32-le", "replace"), "uint32") if n else np.zeros(0, "uint32")
    end = points == 0
    row = np.cumsum(end) - end
    return Block(points, row, n)


class Letters(NamedTuple):
    """Letters and digits in order, the group (row or clause) of each."""

    points: np.ndarray
    group: np.ndarray
    n: int


def letters(b: Block) -> Letters:
    """Letters and digits of each row."""
    at = np.flatnonzero(tables().letter[b.points])
    return Letters(b.points[at], b.row[at], b.n)


class Clauses(NamedTuple):
    """Letters by clause; the row of each clause, whether a full stop or such closes it, and each row's last mark."""

    letters: Letters
    row: np.ndarray
    closed: np.ndarray
    row_mark: np.ndarray


class Pieces(NamedTuple):
    """The piece of each point; last points of pieces; points that close a clause; dots in a row of three."""

    piece: np.ndarray
    cut: np.ndarray
    hard: np.ndarray
    trail: np.ndarray


def pieces(b: Block) -> Pieces:
    """Pieces end at full stops, exclamation and question marks and line ends, with the closing marks that follow.

    A dot ends one only before white space, a closing mark or the text's end, and never in a row of three.
    """
    t, p, n = tables(), b.points, len(b.points)
    index = np.arange(n)
    dot = p == 0x2E
    after = np.append(p[1:], 0)
    before = np.concatenate([[0], p[:-1]])
    opens, shuts = np.flatnonzero(dot & (before != 0x2E)), np.flatnonzero(dot & (after != 0x2E))
    run = np.zeros(n, "int64")
    run[dot] = np.repeat(shuts - opens + 1, shuts - opens + 1)
    trail = run >= 3
    ender = t.ender[p] & ~(dot & ~((after == 0) | t.space[after] | t.closer[after])) & ~trail
    hard = ender.copy()
    ender |= p == 0x0A
    tight = ender | t.closer[p]
    start = np.maximum.accumulate(np.where(~tight, index + 1, 0))
    tail = tight & (np.maximum.accumulate(np.where(ender, index, -1)) >= start)
    cut = (tail & ~np.append(tail[1:], False)) | (p == 0)
    return Pieces(np.cumsum(cut) - cut, cut, hard, trail)


def clauses(b: Block) -> Clauses:
    """Clauses are pieces with a letter or digit; what holds none goes to the clause before, at the start of a text to the first."""
    t, p = tables(), b.points
    if not len(p):
        none = np.zeros(0, "int64")
        return Clauses(Letters(p, none, 0), none, np.zeros(0, bool), np.zeros(b.n, "uint8"))
    piece, cut, hard, trail = pieces(b)
    n_pieces = int(piece[-1]) + 1
    at = np.flatnonzero(t.letter[p])
    holds = np.bincount(piece[at], minlength=n_pieces) > 0
    number = np.cumsum(holds) - 1
    piece_row = b.row[np.flatnonzero(cut)]
    kept = np.flatnonzero(holds)
    closed = (np.bincount(piece[hard], minlength=n_pieces) > 0)[kept]
    # the last character of a row that is neither white space nor a closing mark
    solid = np.flatnonzero(~(t.space[p] | t.closer[p] | (p == 0)))
    ends = np.searchsorted(b.row[solid], np.arange(b.n), "right") - 1
    has = (ends >= 0) & (b.row[solid[np.maximum(ends, 0)]] == np.arange(b.n)) if len(solid) else np.zeros(b.n, bool)
    last = solid[np.maximum(ends, 0)] if len(solid) else np.zeros(b.n, "int64")
    row_mark = np.where(has, np.where(trail[last], 4, t.mark[p[last]]), 0).astype("uint8")
    return Clauses(Letters(p[at], number[piece[at]], len(kept)), piece_row[kept], closed, row_mark)


class Words(NamedTuple):
    """Places of words in a block's points, and the row of each."""

    start: np.ndarray
    stop: np.ndarray
    row: np.ndarray


def words(b: Block) -> Words:
    """Runs of letters of one kind, joined over a hyphen or apostrophe within most scripts; longer runs of ideographs give overlapping pairs."""
    t, p, n = tables(), b.points, len(b.points)
    kind = t.word[p]
    if n > 2:
        joins = np.isin(p[1:-1], [ord(c) for c in JOINERS]) & (kind[:-2] == 1) & (kind[2:] == 1)
        kind[1:-1][joins] = 1
    edge = np.concatenate([[True], kind[1:] != kind[:-1]]) if n else np.zeros(0, bool)
    start = np.flatnonzero(edge & (kind > 0))
    stop = np.flatnonzero(np.append(edge[1:], True) & (kind > 0)) + 1 if n else start
    long = (kind[start] == 2) & (stop - start > 2)
    if long.any():
        count = np.where(long, stop - start - 1, 1)
        which = np.repeat(np.arange(len(start)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start, stop = start[which] + step, np.where(long[which], start[which] + step + 2, stop[which])
    return Words(start, stop, b.row[start])


class Hashes:
    """Hashes of any stretch of an array of code points."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        with np.errstate(over="ignore"):
            power, back = _powers(n)
            self.sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum((points.astype("uint64") + np.uint64(1)) * power)])
        self.back = back

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of each stretch [start, stop)."""
        with np.errstate(over="ignore"):
            h = (self.sums[stop] - self.sums[start]) * self.back[start]
            return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of 64-bit hashes spread over the whole word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest array so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            both = [np.cumprod(np.concatenate([np.ones(1, "uint64"), np.full(n, x, "uint64")])) for x in (BASE, INVERSE)]
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1]


def grams(x: Letters, size: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and group of every stretch of ``size`` letters within a group."""
    n = len(x.points)
    if n < size:
        return np.zeros(0, "uint64"), np.zeros(0, "int64")
    start = np.flatnonzero(x.group[: n - size + 1] == x.group[size - 1 :])
    return hashes.of(start, start + size), x.group[start]


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Slots below 2^bits of 64-bit hashes."""
    return (h >> np.uint64(64 - bits)).astype("int64")
