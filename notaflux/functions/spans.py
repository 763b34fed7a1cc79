"""All matches of a pattern with code point offsets, as one Column expression.

Spark has no such function. The text is marked at every match, split at the marks, and the starts are running sums of
the lengths of the parts; matching runs on the intact text, so boundaries see their context. The whole stays inside the
JVM and local to the row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word characters and white space as the rules of the notes understand them: all scripts, all kinds of numbers.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\u001c- \u0085\p{Z}]"
DIGIT = r"\p{Nd}"
#: A word boundary that does not depend on the regex engine's own idea of letters.
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_BLOCK = 32
MARKS = ("\u0001", "\u0002", "\u0003")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_marks(text: Column) -> Column:
    """The text with the marks of this module replaced one by one, so that offsets stay."""
    return F.translate(text, "".join(MARKS), "�" * len(MARKS))


def strip(text: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def running(values: Column, zero: int, join: Callable[[Column, Column], Column]) -> Column:
    """n + 1 running results of n numbers under an associative ``join``: within blocks first, then every block joins what
    those before it give. Three levels, each of which is a short fold, so the work grows with n."""

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(zero), join)

    def within(block: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(block)), lambda i: total(F.slice(block, F.lit(1), i)))

    def blocks(numbers: Column, size: int) -> Column:
        last = F.greatest(F.ceil(F.size(numbers) / size).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(numbers, b * size + 1, F.lit(size)))

    def level(numbers: Column, above: Callable[[Column], Column]) -> Column:
        """Running results of short blocks, moved by those of the blocks' totals, which ``above`` gives."""
        parts = let(blocks(numbers, _BLOCK), lambda bs: let(above(F.transform(bs, total)), lambda at: F.flatten(F.transform(
            bs, lambda b, i: F.transform(F.slice(within(b), F.lit(2), F.size(b)), lambda n: join(n, F.get(at, i)))))))
        return F.when(F.size(numbers) <= _BLOCK, within(numbers)).otherwise(F.concat(F.array(F.lit(zero)), parts))

    def copied(numbers: Column) -> Column:
        """For the few totals of the third level: a fold that copies its result at every step."""
        return F.aggregate(numbers, F.array(F.lit(zero)), lambda done, n: F.concat(done, F.array(join(F.element_at(done, -1), n))))

    return let(values, lambda v: level(v, lambda t: let(t, lambda u: level(u, copied))))


def starts(parts: Column) -> Column:
    """Running sums of the lengths of ``parts`` before each."""
    return running(F.transform(parts, F.length), 0, lambda a, b: a + b)


def pieces(text: Column, pattern: str, replacement: str = "\u0001$0\u0002") -> Column:
    """ARRAY<STRUCT<part, start, matched>> of the matches and of what lies between them, in order."""
    parts = F.split(F.regexp_replace(without_marks(text), F.lit(pattern), F.lit(replacement)), "[\u0001\u0002]", -1)
    return let(parts, lambda p: let(starts(p), lambda s: F.transform(p, lambda x, i: F.struct(
        x.alias("part"), F.get(s, i).alias("start"), (i % 2 == 1).alias("matched")))))


def _surface(text: Column, part: Column, start: Column) -> Column:
    """A match as the text has it: the part itself, cut from the text only where a replaced mark may lie inside."""
    return F.when(F.contains(part, F.lit("�")), F.substring(text, start + 1, F.length(part))).otherwise(part)


def tagged(text: Column, patterns: Sequence[str], before: str = "", after: str = "") -> Column:
    """ARRAY<STRUCT<text, start, end, tag>> of one scan with several patterns: at each place the first that fits wins, and
    ``tag`` is its number. Each pattern writes its own place into the mark, so the tag is the place that is not empty.
    ``before`` and ``after``: conditions without width that all patterns share.
    """
    marks = "\u0001" + "\u0003".join(f"${k + 1}" for k in range(len(patterns))) + "\u0001"
    parts = F.split(F.regexp_replace(without_marks(text), F.lit(f"{before}(?:{'|'.join(f'({p})' for p in patterns)}){after}"), F.lit(marks)), "\u0001", -1)
    place = lambda p: F.length(p) - F.length(F.ltrim(F.translate(p, "\u0003 ", " \u0003")))

    def read(p: Column) -> Column:
        return let(F.transform(p, lambda x: F.translate(x, "\u0003", "")), lambda w: let(starts(w), lambda at: F.transform(
            F.filter(F.transform(w, lambda t, i: F.struct(t.alias("t"), F.get(at, i).alias("start"), i.alias("i"))), lambda t: t.i % 2 == 1),
            lambda t: F.struct(_surface(text, t.t, t.start).alias("text"), t.start.alias("start"), (t.start + F.length(t.t)).alias("end"), place(F.get(p, t.i)).alias("tag")))))

    return F.coalesce(let(parts, read), F.array().cast("array<struct<text:string,start:int,end:int,tag:int>>"))


def spans(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<text, start, end>> of all matches from left to right; empty for null texts and texts without one.

    The surface is cut from the original text, so marks in it survive.
    """
    found = F.transform(F.filter(pieces(text, pattern), lambda p: p.matched), lambda p: F.struct(
        _surface(text, p.part, p.start).alias("text"), p.start.alias("start"), (p.start + F.length(p.part)).alias("end")))
    return F.coalesce(found, F.array().cast("array<struct<text:string,start:int,end:int>>"))


def exploded(df: DataFrame, key: str, items: Column, no: str = "no") -> DataFrame:
    """(key, no, x): a row for each item of an array.

    The outer form keeps the optimizer from inferring a filter on the array, which it would push down by computing the
    whole chain of expressions a second time.
    """
    return df.select(key, F.posexplode_outer(items).alias(no, "x")).where(F.col(no).isNotNull())
