"""Normalisation of note texts: measurements kept as written, Unicode composed, symbols, control characters, white
space, case and, if wanted, accents.

Everything runs inside the JVM; Unicode normal forms come from the ICU library that Spark ships. A measurement is
protected where it stands (not at the first equal string of the text). Null stays null; blank texts become empty.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notaflux.conf import EngineConf
from notaflux.functions.patterns import PROTECTED
from notaflux.functions.spans import let, strip

# Symbols and what they are written as.
SYMBOLS_FROM = "–—‘’“”•ºª²³"
SYMBOLS_TO = "--''\"\"-oa23"
DEGREE, DEGREE_WORD = "°", " graus "
_KEEP = ("\u0004", "\u0005", "\u0006", "\u0007")
# control characters that the marks of this package use; all of them are stripped alike, so one may stand for another
_CONTROLS, _STAND_IN = "".join(map(chr, range(1, 8))), "\u0008"


@cache
def combining_class() -> str:
    """A character class of the code points with a canonical combining class (not all marks have one), from Unicode data."""
    points = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    firsts = [c for c, before in zip(points, [-2, *points], strict=False) if c != before + 1]
    lasts = [c for c, after in zip(points, [*points[1:], -2], strict=True) if c != after - 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(firsts, lasts, strict=True)) + "]"


def nfc(text: Column) -> Column:
    """Canonical composition."""
    return F.when(text.isNotNull(), F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)))


def remove_accents(text: Column) -> Column:
    """Compatibility decomposition without characters of a combining class: vowel signs, which have none, stay."""
    apart = F.when(text.isNotNull(), F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True)))
    return F.regexp_replace(apart, F.lit(combining_class()), F.lit(""))


def symbols(text: Column) -> Column:
    """Dashes, quotation marks, ordinals and raised digits in plain characters, the degree sign as a word."""
    return F.replace(F.translate(text, SYMBOLS_FROM, SYMBOLS_TO), F.lit(DEGREE), F.lit(DEGREE_WORD))


def strip_controls(text: Column) -> Column:
    """Without control characters, but with tabs and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def whitespace(text: Column) -> Column:
    """One blank for a run of blanks and tabs, at most two line ends in a row, nothing around."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def _protect(text: Column, pattern: str, mark: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"_{mark}_"))


def _restore(text: Column, mark: str, kept: Column) -> Column:
    """Put the kept strings back, in order, where their marks stand."""
    return let(F.split(text, f"_{mark}_", -1), lambda parts: F.concat_ws("", F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(kept, i), F.lit(""))))))


def protected(text: Column) -> Column:
    """ARRAY<ARRAY<STRING>> of what each of the four patterns protects, in the order of the text."""
    steps = [text]
    for pattern, mark in zip(PROTECTED, _KEEP, strict=True):
        steps.append(_protect(steps[-1], pattern, mark))
    return F.array(*[F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)) for t, p in zip(steps, PROTECTED, strict=False)])


def normalize(text: Column, conf: EngineConf | None = None) -> Column:
    """The whole normalisation of one text column."""
    conf = conf or EngineConf()
    clean = F.translate(text, _CONTROLS, _STAND_IN * len(_CONTROLS))

    def changed(t: Column) -> Column:
        t = symbols(nfc(t))
        # the marks are control characters themselves and stay until the strings are back
        t = F.regexp_replace(t, r"[\x00-\x03\x08\x0b\x0c\x0e-\x1f\x7f]", "")
        if conf.remove_extra_whitespace:
            t = whitespace(t)
        if conf.lowercase:
            t = F.lower(t)
        return remove_accents(t) if conf.normalize_accents else t

    def protect(t: Column, kept: tuple[Column, ...] = ()) -> Column:
        """Each pattern sees the text that the ones before have left; every step is computed once."""
        k = len(kept)
        if k == len(PROTECTED):
            t = changed(t)
            for mark, strings in zip(_KEEP, kept, strict=True):
                t = _restore(t, mark, strings)
            return t
        return let(F.regexp_extract_all(t, F.lit(f"({PROTECTED[k]})"), F.lit(1)), lambda strings: let(_protect(t, PROTECTED[k], _KEEP[k]), lambda rest: protect(rest, (*kept, strings))))

    return F.when(text.isNull(), None).when(strip(text) == "", "").otherwise(let(clean, lambda t: protect(t)))


def normalized(notes: DataFrame, text: str = "text", conf: EngineConf | None = None) -> DataFrame:
    return notes.withColumn(text, normalize(F.col(text), conf))
