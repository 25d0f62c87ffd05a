"""Numeric answers: extraction, parsing and comparison, all as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import WHITE, strip

#: Fixed value: the marker of a final number, then digits, commas, points and minus signs.
FINAL_NUMBER = r"####\s*([\-\d,\.]+)"
#: The same, but for a currency sign or box in between.
FINAL_NUMBER_LENIENT = r"####\s*\$?(?:\\boxed\{)?\s*\$?(-?\d[\d,\.]*)"
#: What may be cast: decimal notation and the names of infinity and no number, so that suffixes and hexadecimal floats stay out.
_NUMBER = rf"^{WHITE}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?i:inf|infinity|nan)){WHITE}*%?{WHITE}*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def last_match(text: Column, pattern: str = FINAL_NUMBER) -> Column:
    """Group 1 of the last match, trimmed; null without a match."""
    return strip(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1)))


def first_match_or_all(text: Column, pattern: str = FINAL_NUMBER) -> Column:
    """Group 1 of the first match, else the whole text, trimmed: how a reference answer is read from its solution."""
    return strip(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text))


def parse_number(text: Column) -> Column:
    """A double, or null: commas and blanks dropped, single underscores between digits too; a closing percent sign
    divides by 100. Other white space may stand at the ends, but not between digits."""
    bare = F.regexp_replace(F.translate(text, ", ", ""), r"(?<=\d)_(?=\d)", "")
    # what does not match is the empty string, which casts to null
    return F.regexp_extract(bare, _NUMBER, 1).try_cast("double") / F.when(text.rlike(rf"%{WHITE}*$"), 100).otherwise(1)


def close(a: Column, b: Column, relative: float = 1e-4, near_zero: float = 1e-6) -> Column:
    """Whether a prediction equals a reference: relative to the larger one, absolute if the reference is 0.

    Null and NaN never match; infinities match only themselves.
    """
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    near = F.when(b == 0, F.abs(a) < near_zero).otherwise((a == b) | (finite & (F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b)))))
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & near, F.lit(False))


def close_pair(a: Column, b: Column) -> Column:
    """As ``close``, with either side worked out once."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda v: close(v["a"], v["b"]))


def number_match(prediction: Column, reference: Column) -> Column:
    return close_pair(parse_number(prediction), parse_number(reference))
