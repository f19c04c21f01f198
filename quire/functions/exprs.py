"""Column helpers shared by operators; everything stays in built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def mismatches(pairs: Sequence[tuple[str, Column, Column]]) -> Column:
    """Names of the fields that differ, null-safe, in the given order."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, a, b in pairs]))


def first_rule(rules: Sequence[tuple[Column, str]], otherwise: str | None) -> Column:
    """Outcome of the first rule that holds; a rule that is null doesn't."""
    chain = F
    for condition, outcome in rules:
        chain = chain.when(condition, F.lit(outcome))
    return chain.otherwise(F.lit(otherwise))


def all_rules(rules: Sequence[tuple[Column, str]]) -> Column:
    """Sorted distinct outcomes of all rules that hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(o)) for c, o in rules]))))


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def bands(score: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
    """Three-way classification: below low, from low to below high, from high."""
    return F.when(score >= high, names[2]).when(score >= low, names[1]).when(score < low, names[0])


def worst_of(value: Column, order: Sequence[str]) -> Column:
    """Aggregate: the value of the group that comes first in ``order``; unknown values don't count."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.try_element_at(F.array(*[F.lit(x) for x in order]), F.min(F.when(rank > 0, rank)).cast("int"))


def optional_sum(a: Column, b: Column) -> Column:
    """a + b with a missing one as 0; null only if both are."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def canonical_text(fields: Sequence[tuple[str, Column]]) -> Column:
    """``{"name":"value",...}`` with sorted names and null for missing values, the same bytes in every engine."""
    parts = [F.concat(F.lit(f'"{n}":'), F.coalesce(F.concat(F.lit('"'), c.cast("string"), F.lit('"')), F.lit("null"))) for n, c in sorted(fields, key=lambda x: x[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def content_id(kind: str, text: Column) -> Column:
    """A stable id derived from content."""
    return F.concat(F.lit(f"{kind}-v1:"), F.sha2(text, 256))


def natural_key(text: Column) -> Column:
    """Sort key with digit runs as numbers of up to 12 digits, letters in lower case."""
    padded = F.regexp_replace(F.lower(text), r"(\d+)", "000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{12})(?!\d)", "$1")


def half_even(value: Column, places: int) -> Column:
    """A double rounded to ``places`` decimals (0 to 7) by its exact binary value, ties to the even digit.

    2.675 lies below its tie in binary and goes to 2.67, where rounding by its shortest decimal text gives 2.68. Which side
    of the nearest tie, an odd half of 10^-places, a value lies on follows from the product 2 * 10^places * value and its
    rounding error, which is exact in two parts.
    """
    scale = F.lit(2.0 * 10**places)
    v = value.cast("double")
    twice = v * scale
    high = v * 134217729.0 - (v * 134217729.0 - v)
    error = (high * scale - twice) + (v - high) * scale
    odd = F.floor(twice / 2).cast("double") * 2 + 1
    beyond = (twice - odd) + error
    return F.when(beyond == 0, F.bround(v, places)).otherwise((odd + F.signum(beyond)) / 2 / F.lit(10.0**places))


def utc_text(moment: Column) -> Column:
    """ISO text of a UTC time with microseconds and offset."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def safe_name(text: Column) -> Column:
    """A name for a file: every character but letters, digits, ``-`` and ``_`` becomes ``_``."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")
