"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def accent_pairs() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from their canonical decomposition."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccent(text: Column) -> Column:
    """Latin letters without accents, composed or combining."""
    return F.regexp_replace(F.translate(text, *accent_pairs()), r"\p{M}+", "")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """Lower case, no accents, no outer blanks."""
    return strip(unaccent(F.lower(text)))
