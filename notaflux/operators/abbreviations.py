"""Abbreviations of clinical notes and their expansions.

One pass from left to right over the text, longest abbreviation first, whole words, any case; a match is looked up as
written, then in capitals, and stays where neither is known. The dictionary is a literal of the plan.
"""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notaflux.functions.patterns import edges, either
from notaflux.functions.spans import let
from notaflux.functions.vocab import Abbreviations

log = logging.getLogger(__name__)


def load(path: str | None = None, base: Abbreviations | None = None, required: bool = False) -> Abbreviations:
    """The built-in dictionary, overridden by a JSON object of a file. A missing or broken file leaves the dictionary as
    it is, unless the caller requires it."""
    known = base or Abbreviations.builtin()
    if not path:
        return known
    file = Path(path)
    if not file.exists():
        if required:
            raise FileNotFoundError(path)
        log.debug("no abbreviation file at %s", path)
        return known
    try:
        return known.added({str(k): str(v) for k, v in json.loads(file.read_text(encoding="utf-8")).items()})
    except (OSError, ValueError) as e:
        if required:
            raise
        log.warning("abbreviation file %s not read: %s", path, e)
        return known


def matcher(known: Abbreviations) -> str:
    before, after = edges(known.mapping)
    return f"{before}{either(known.mapping)}{after}"


def _map(known: Abbreviations) -> Column:
    return F.create_map(*[F.lit(x) for pair in known.mapping.items() for x in pair])


def lookup(abbreviation: Column, known: Abbreviations | None = None) -> Column:
    """The expansion of one abbreviation: as written, then in capitals, else null."""
    table = _map(known or Abbreviations.builtin())
    return F.coalesce(F.try_element_at(table, abbreviation), F.try_element_at(table, F.upper(abbreviation)))


def expand(text: Column, known: Abbreviations | None = None, inline: bool = True) -> Column:
    """The text with its abbreviations expanded in place, or followed by their expansion in brackets."""
    known = known or Abbreviations.builtin()
    # the mark is written in another way where the text itself holds it, and restored at the end
    free = F.replace(F.replace(text, F.lit("\u0002"), F.lit("\u0002\u0004")), F.lit("\u0001"), F.lit("\u0002\u0003"))
    marked = F.split(F.regexp_replace(free, F.lit(matcher(known)), F.lit("\u0001$0\u0001")), "\u0001", -1)

    def written(part: Column, i: Column) -> Column:
        full = F.nullif(lookup(part, known), F.lit(""))
        new = F.coalesce(full, part) if inline else F.when(full.isNull(), part).otherwise(F.concat(part, F.lit(" ("), full, F.lit(")")))
        return F.when(i % 2 == 1, new).otherwise(part)

    def restored(t: Column) -> Column:
        return F.replace(F.replace(t, F.lit("\u0002\u0003"), F.lit("\u0001")), F.lit("\u0002\u0004"), F.lit("\u0002"))

    return F.when(text == "", "").otherwise(restored(let(marked, lambda parts: F.array_join(F.transform(parts, written), ""))))


def dictionary(spark: SparkSession, known: Abbreviations | None = None) -> DataFrame:
    """(abbreviation, expansion): the dictionary as a table."""
    return spark.createDataFrame(list((known or Abbreviations.builtin()).mapping.items()), "abbreviation string, expansion string")


def found(notes: DataFrame, key: str = "doc_id", text: str = "text", known: Abbreviations | None = None) -> DataFrame:
    """(key, abbreviation, expansion) of every abbreviation of the texts that has an expansion."""
    hits = F.regexp_extract_all(F.col(text), F.lit(f"({matcher(known or Abbreviations.builtin())})"), F.lit(1))
    return notes.select(key, F.explode(hits).alias("abbreviation")).withColumn("expansion", lookup(F.col("abbreviation"), known)).where("expansion is not null")
