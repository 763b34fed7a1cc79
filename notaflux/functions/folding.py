"""Accent and case folding inside the JVM: one translate over the Latin blocks, no Python on the way."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def latin_map() -> tuple[str, str]:
    """Letters of the Latin blocks with their base letter, built from Unicode decompositions."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(text: Column) -> Column:
    """Latin letters without their accents, composed or not; other scripts stay."""
    letters, bases = latin_map()
    return F.regexp_replace(F.translate(text, letters, bases), "[\\u0300-\\u036f]", "")


def strip_space(text: Column) -> Column:
    """Both ends without white space of any kind (SQL trim knows U+0020 alone)."""
    return F.regexp_replace(text, "^[\\s\\u001c-\\u001f\\u0085\\p{Z}]+|[\\s\\u001c-\\u001f\\u0085\\p{Z}]+$", "")
