"""White space as Unicode has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every white-space character, as a character class for Java's patterns.
WHITE = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end: line breaks, tabs and no-break spaces too."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")
