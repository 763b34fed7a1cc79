"""Tokens and sentences of note texts, with code point offsets.

Tokens are scanned from left to right; at each place the first class that fits wins. Sentences are stripped, empty ones
dropped; the tokens of a sentence are counted from its own start. Null and empty texts give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notaflux.functions.patterns import SENTENCE_BREAK, TOKEN_CLASSES
from notaflux.functions.spans import SPACE, exploded, pieces, strip, tagged

TOKEN = "struct<text:string,start:int,end:int,token_type:string>"


def tokens(text: Column) -> Column:
    """ARRAY<STRUCT<text, start, end, token_type>>."""
    names = F.array(*[F.lit(n) for n, _ in TOKEN_CLASSES])
    return F.transform(tagged(text, [p for _, p in TOKEN_CLASSES]), lambda t: F.struct(t.text.alias("text"), t.start.alias("start"), t.end.alias("end"), F.get(names, t.tag).alias("token_type")))


def sentences(text: Column, with_tokens: bool = False) -> Column:
    """ARRAY<STRUCT<text, start, end[, tokens]>>."""
    lead = lambda p: F.length(p) - F.length(F.regexp_replace(p, rf"^{SPACE}+", ""))

    def shaped(p: Column) -> Column:
        start = p.start + lead(p.part)
        own = F.substring(text, start + 1, F.length(strip(p.part)))
        fields = [own.alias("text"), start.alias("start"), (start + F.length(strip(p.part))).alias("end")]
        return F.struct(*fields, tokens(own).alias("tokens")) if with_tokens else F.struct(*fields)

    kept = F.transform(F.filter(pieces(text, SENTENCE_BREAK), lambda p: ~p.matched & (strip(p.part) != "")), shaped)
    inner = f",tokens:array<{TOKEN}>" if with_tokens else ""
    return F.coalesce(kept, F.array().cast(f"array<struct<text:string,start:int,end:int{inner}>>"))


def token_rows(notes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, token_no, token, start, end, token_type)."""
    rows = exploded(notes, key, tokens(F.col(text)), "token_no")
    return rows.select(key, "token_no", F.col("x.text").alias("token"), F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"), "x.token_type")


def sentence_rows(notes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_no, sentence, start, end)."""
    rows = exploded(notes, key, sentences(F.col(text)), "sentence_no")
    return rows.select(key, "sentence_no", F.col("x.text").alias("sentence"), F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"))
