"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"
# Fixed value: the likeness of names of which one contains the other.
PART_LIKENESS = 0.55
#: A JSON string, with the colon where it is a key. Read from the start of a text, strings are taken whole, so nothing within one is.
JSON_STRING = r'"(?:[^"\\]|\\.)*"\s*:?'


def without_blanks(text: Column) -> Column:
    """A text without any white space, the ideographic space included."""
    return F.regexp_replace(text, r"[\s　 ]+", "")


def error_rate(expected: Column, got: Column) -> Column:
    """Edit distance over the expected length; with nothing expected 0 for nothing and 1 for anything. A missing reading counts as empty."""
    read = F.coalesce(got, F.lit(""))
    none = F.when(F.length(read) == 0, 0.0).otherwise(1.0)
    return F.when(F.length(expected) == 0, none).otherwise(F.levenshtein(expected, read) / F.length(expected))


def unfenced(text: Column) -> Column:
    """The inside of a text that opens and closes with a Markdown code fence, without the mark ``json``, else the text itself."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    whole = bare(text)
    inside = F.substr(whole, F.lit(len(FENCE) + 1), F.length(whole) - 2 * len(FENCE))
    marked = F.lower(F.substr(inside, F.lit(1), F.lit(4))) == "json"
    inside = bare(F.when(marked, F.substr(inside, F.lit(5))).otherwise(inside))
    fenced = whole.startswith(FENCE) & whole.endswith(FENCE) & (F.length(whole) >= 2 * len(FENCE))
    return F.when(fenced, inside).otherwise(text)


def json_keys(text: Column) -> Column:
    """The distinct keys of all objects in a JSON text, at any depth; null gives null, a text without keys none."""
    strings = F.regexp_extract_all(text, F.lit(JSON_STRING), F.lit(0))
    keys = F.transform(F.filter(strings, lambda x: x.endswith(":")), lambda x: F.regexp_replace(x, r"\s*:$", ""))
    return F.from_json(F.concat(F.lit("["), F.array_join(F.array_distinct(keys), ","), F.lit("]")), "array<string>")


def charset_overlap(a: Column, b: Column) -> Column:
    """Share of the first text's distinct characters that the second has too, null for an empty first text."""
    letters = lambda x: F.array_distinct(F.array_remove(F.split(x, ""), ""))
    return F.try_divide(F.size(F.array_intersect(letters(a), letters(b))).cast("double"), F.size(letters(a)).cast("double"))


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns occurs."""
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def name_likeness(a: Column, b: Column) -> Column:
    """1 for equal names, 0.55 where one contains the other, else 0; case and blanks don't count."""
    x, y = (F.lower(without_blanks(c)) for c in (a, b))
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), PART_LIKENESS).otherwise(0.0)
