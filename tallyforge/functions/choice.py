"""Letters of multiple-choice answers, by the two conventions in use: the first stated, and the last stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Explicit forms of an answer, A-D, of which the first counts.
FIRST_EXPLICIT = r"(?imd)(?:(?:the\s+)?answer\s+is\s*[:\-]?\s*\(?([A-D])\)?|\b([A-D])\)\s|^([A-D])$)"
FIRST_STANDALONE = r"(?i)\b([A-D])\b"
#: Explicit forms, A-E, of which the last counts.
LAST_EXPLICIT = r"(?i)(?:answer|option|choice)\s*(?:is)?\s*[:(]?\s*([A-E])"
LAST_STANDALONE = r"\b([A-Ea-e])\b"
#: Strict variants: the letter must stand alone, and the article "a" is no answer.
FIRST_EXPLICIT_STRICT = r"(?imd)(?:(?:the\s+)?answer\s+is\s*[:\-]?\s*\(?([A-E])\)?(?![A-Za-z])|\b([A-E])\)\s|^([A-E])$)"
LAST_EXPLICIT_STRICT = r"(?i)(?:answer|option|choice)\s*(?:is)?\s*[:(]?\s*([A-E])(?![A-Za-z])"
STANDALONE_STRICT = r"\b([A-E])\b"


def _last(text: Column, pattern: str) -> Column:
    return F.upper(F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1)))


def first_choice(text: Column, strict: bool = False) -> Column:
    """The first explicit letter, else the last standalone one, upper case; null if there is none."""
    pattern, alone = (FIRST_EXPLICIT_STRICT, STANDALONE_STRICT) if strict else (FIRST_EXPLICIT, FIRST_STANDALONE)
    # the whole first match is looked up once; its letter is the last one that stands alone in it
    first = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    return F.coalesce(F.upper(F.regexp_extract(first, r"([A-Ea-e])\)?\s*$", 1)), _last(text, alone))


def last_choice(text: Column, strict: bool = False) -> Column:
    """The last explicit letter, else the last standalone one, upper case; null if there is none."""
    explicit, alone = (LAST_EXPLICIT_STRICT, STANDALONE_STRICT) if strict else (LAST_EXPLICIT, LAST_STANDALONE)
    return F.coalesce(_last(text, explicit), _last(text, alone))


def answer_type(reference: Column) -> Column:
    """``multiple_choice`` for exactly one letter A to E of either case, else ``free_text``."""
    return F.when(reference.rlike(r"\A[A-Ea-e]\z"), "multiple_choice").otherwise("free_text")


def normal_label(label: Column) -> Column:
    """Labels 1 to 5 as letters; all others unchanged."""
    letters = F.create_map(*[F.lit(x) for pair in zip("12345", "ABCDE") for x in pair])
    return F.coalesce(F.try_element_at(letters, label), label)
