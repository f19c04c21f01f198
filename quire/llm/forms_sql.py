"""The consistent form of ``visual_text`` as a DuckDB expression, for the check of its queries.

It shares the fixed values and the rule for single code points, and does the rest by other means: DuckDB's own
composition, and regular expressions for what stands between katakana and in mixed words.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from quire.llm.visual_text import KANA_ALIKE, LETTERS_ALIKE, alike_folds, fold_one


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(maxsize=2)
def _maps(look: bool) -> tuple[dict[str, str], dict[str, str], str]:
    """Single characters that become one other, those that become several, and those that go; what composition does itself is left out."""
    one, many, gone, folds = {}, {}, [], alike_folds(look)
    for cp in range(sys.maxunicode + 1):
        if cp not in folds and (0x3400 <= cp < 0xE000 and not 0xA000 <= cp < 0xAC00 or 0xE000 <= cp < 0xF900 or cp >= 0x30000 and not 0xE0000 <= cp < 0xE0200):
            continue
        char = chr(cp)
        to = "".join(map(chr, fold_one(cp, look)))
        if not to:
            if cp:
                gone.append(char)
        elif unicodedata.normalize("NFC", to) != unicodedata.normalize("NFC", char):
            (one if len(to) == 1 else many)[char] = to
    return one, many, "".join(gone)


def _folded_sql(column: str, look: bool) -> str:
    one, many, gone = _maps(look)
    text = f"translate({column}, {_quoted(''.join(one) + gone)}, {_quoted(''.join(one.values()))})"
    for char, to in many.items():
        text = f"replace({text}, {_quoted(char)}, {_quoted(to)})"
    return f"trim(nfc_normalize({text}), ' ')"


def look_sql(column: str) -> str:
    """SQL of the look key of a column."""
    return _folded_sql(column, True)


def plain_sql(column: str) -> str:
    """SQL of a column's letters, marks and digits in the form of the look key and lower case."""
    return f"regexp_replace(lower({look_sql(column)}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')"


def consistent_sql(column: str) -> str:
    """SQL of the consistent form of a column."""
    text = _folded_sql(column, False)
    alike = "".join(KANA_ALIKE)
    to = "".join(KANA_ALIKE.values())
    kana = "ァ-ヺー-ヾㇰ-ㇿ"
    between = f"CASE WHEN i > 1 AND i < len(l) AND regexp_matches(x, '^[{alike}]') AND regexp_matches(l[i - 1], '[{kana}]$') AND regexp_matches(l[i + 1], '^[{kana}]') THEN translate(x, '{alike}', '{to}') ELSE x END"
    pieces = f"regexp_extract_all({text}, '[{alike}]+|[^{alike}]+')"
    text = f"array_to_string(list_transform(list_value({pieces}), lambda l: array_to_string(list_transform(l, lambda x, i: {between}), '')), '')"
    pairs = [(a, b) for many, ones in LETTERS_ALIKE.items() for a, b in zip(many, ones) if not unicodedata.name(a).startswith("LATIN ")]
    letters, latin = ("".join(x) for x in zip(*pairs))
    foreign = r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}]"
    folded = f"translate(x, '{letters}', '{latin}')"
    mixed = f"CASE WHEN regexp_matches(x, '\\p{{Latin}}') AND regexp_matches(x, '{foreign}') AND NOT regexp_matches({folded}, '{foreign}') THEN {folded} ELSE x END"
    words = f"regexp_extract_all({text}, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+')"
    return f"CASE WHEN {column} IS NOT NULL THEN coalesce(array_to_string(list_transform({words}, lambda x: {mixed}), ''), '') END"
