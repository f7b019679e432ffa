"""Text functions on columns, all inside code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = chr(0x1680) + chr(0x2000) + "-" + "".join(map(chr, (0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Members of a regular-expression class: the white space of ``str.split`` and ``str.strip``.
WHITE = r"\x09-\x0d\x1c-\x20\x85\xa0" + _WIDE
#: The same without the four separators that regular-expression engines don't count.
WHITE_RE = r"\x09-\x0d\x20\x85\xa0" + _WIDE


def words(text: Column) -> Column:
    """Array of the words between white space."""
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WHITE}]+\\z", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"\\A[{WHITE}]+|[{WHITE}]+\\z", "")


def one_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"[{WHITE}]+", " "))


def count_outside(text: Column, members: str) -> Column:
    """Number of characters that aren't in the class ``members``."""
    return F.length(F.regexp_replace(text, f"[{members}]", ""))


def alphabetic(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{IsAlphabetic}", "")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
