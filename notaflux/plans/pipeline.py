"""The two flows over notes, each one lazy plan without a shuffle.

``report`` finds entities in the normalised text and shows the expansion beside it; ``expanded`` finds them in the
expanded text, so expansions feed the entities and offsets are those of the expanded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notaflux.conf import EngineConf
from notaflux.functions.vocab import Abbreviations, Gazetteers
from notaflux.operators import abbreviations, entities, fhir, relations, summaries
from notaflux.operators.normalize import normalize


def _known(conf: EngineConf, known: Abbreviations | None) -> Abbreviations:
    """The caller's dictionary, else the built-in one with the file of the configuration."""
    return known or abbreviations.load(conf.abbreviation_dict_path)


def _tail(df: DataFrame, text: str, conf: EngineConf, vocabulary: Gazetteers | None) -> DataFrame:
    found = entities.with_entities(df, text, conf, vocabulary)
    return relations.with_relations(found, text, conf).withColumn("summary", summaries.summary(F.col("entities"), F.col("relations")))


def report(notes: DataFrame, text: str = "text", conf: EngineConf | None = None, known: Abbreviations | None = None, vocabulary: Gazetteers | None = None) -> DataFrame:
    """``notes`` with normalized, expanded, entities, relations and summary; entities are those of the normalised text."""
    conf = conf or EngineConf()
    df = notes.withColumn("normalized", normalize(F.col(text), conf))
    return _tail(df.withColumn("expanded", abbreviations.expand(F.col("normalized"), _known(conf, known), inline=False)), "normalized", conf, vocabulary)


def expanded(notes: DataFrame, text: str = "text", conf: EngineConf | None = None, known: Abbreviations | None = None, vocabulary: Gazetteers | None = None) -> DataFrame:
    """``notes`` with normalized, expanded, entities, relations and summary; entities are those of the expanded text."""
    conf = conf or EngineConf()
    df = notes.withColumn("normalized", normalize(F.col(text), conf))
    return _tail(df.withColumn("expanded", abbreviations.expand(F.col("normalized"), _known(conf, known))), "expanded", conf, vocabulary)


def documents_of(processed: DataFrame, key: str = "doc_id", conf: EngineConf | None = None, patient: str | None = None) -> DataFrame:
    """(key, bundle, composition) as FHIR JSON; ``patient`` names the column with the patient of each note."""
    of = fhir.patient_of(patient, conf)
    return processed.select(
        key, fhir.bundle(F.col("entities"), F.col(key), of, conf).alias("bundle"), fhir.composition(F.col("summary"), F.col(key), of, conf).alias("composition"))
