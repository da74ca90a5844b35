"""Column expressions over words and lines. A word is ``[^\\x20\\x09-\\x0D]+``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def evaluated_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: inside a lambda, a computed column would be computed anew."""
    return F.transform(F.array(value), use)[0]


#: Elements of a part that ``running_sums`` and ``in_parts`` go through at a time.
PART = 128


def in_parts(values: Column) -> Column:
    """An array as an array of arrays of ``PART`` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / PART).cast("int")), lambda i: F.slice(values, i * PART + 1, F.lit(PART)))


def running_sums(values: Column) -> Column:
    """0 and the sums of the first one, two, ... of an array of ints.

    A list can only be made longer by copying it, so long arrays are summed in parts, each moved by the sum of those before it.
    """
    def short(some: Column) -> Column:
        return F.aggregate(some, F.array(F.lit(0)), lambda seen, n: F.concat(seen, F.array(F.element_at(seen, -1) + n)))

    def moved(parts: Column) -> Column:
        bases = evaluated_once(F.transform(parts, lambda p: F.element_at(p, -1)), short)
        return evaluated_once(bases, lambda base: F.concat(F.array(F.lit(0)), F.flatten(F.transform(
            parts, lambda p, i: F.transform(F.slice(p, F.lit(2), F.lit(PART)), lambda n: n + base[i])))))

    return evaluated_once(values, lambda all_: F.when(F.size(all_) <= PART, short(all_)).otherwise(
        evaluated_once(F.transform(in_parts(all_), short), moved)))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def word_array(text: Column) -> Column:
    inner = trimmed(text)
    return F.when(inner != "", F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """Occurrences of any of these ASCII characters."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def normal_line(line: Column) -> Column:
    """One space between words, none around, A-Z in lower case."""
    return ascii_lower(F.regexp_replace(trimmed(line), r"[\x20\x09-\x0D]+", " "))
