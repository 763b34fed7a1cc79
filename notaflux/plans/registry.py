"""The registered queries of the core, each over its whole tables.

Entity queries read the notes over all orders; normalisation reads all documents; the clinical notes run through the
whole pipeline without SQL beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notaflux.conf import EngineConf
from notaflux.functions import patterns
from notaflux.functions.spans import exploded, spans
from notaflux.functions.vocab import ENTITY_TYPES, Abbreviations, Gazetteers
from notaflux.operators import abbreviations, entities, fhir, normalize, relations, summaries, tokens, units
from notaflux.plans import oracle, pipeline
from notaflux.sources.notes import order_notes
from notaflux.sources.tables import once, table

Query = Callable[[SparkSession, str], DataFrame]
#: Entries that a caller adds to the dictionary.
MERGED = {"DM2": "Diabetes tipo dois", "SC": "Por via subcutanea", "oral": "pela boca"}


def _document_query(change: Callable[[Column], Column]) -> Query:
    return lambda spark, root: table(spark, root, "documents").select("doc_id", change(F.col("text")).alias("text"))


def _span_query(*found: str) -> Query:
    def query(spark: SparkSession, root: str) -> DataFrame:
        all_spans = F.concat(*[spans(F.col("text"), p) for p in found])
        return exploded(order_notes(spark, root), "note_id", all_spans).select("note_id", "x.text", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"))

    return query


def _term_query(kind: str) -> Query:
    def query(spark: SparkSession, root: str) -> DataFrame:
        vocabulary = entities.vocabulary_table(spark).where(F.col("entity_type") == kind)
        return entities.gazetteer_join(order_notes(spark, root), vocabulary, "note_id").select("note_id", "text", "start_pos", "end_pos")

    return query


def _entities(spark: SparkSession, root: str) -> DataFrame:
    return entities.with_entities(order_notes(spark, root))


def _related(spark: SparkSession, root: str) -> DataFrame:
    return relations.with_relations(_entities(spark, root))


def _summed(spark: SparkSession, root: str) -> DataFrame:
    return _related(spark, root).withColumn("summary", summaries.summary(F.col("entities"), F.col("relations")))


def normalize_full(spark: SparkSession, root: str) -> DataFrame:
    return normalize.normalized(order_notes(spark, root))


def protected_measurements(spark: SparkSession, root: str) -> DataFrame:
    kept = order_notes(spark, root).select("note_id", normalize.protected(F.col("text")).alias("k"))
    return kept.select("note_id", *[F.array_join(F.get("k", F.lit(i)), "|").alias(name) for i, name in enumerate(("measurements", "per_unit", "dates", "times"))])


def abbreviations_inline(spark: SparkSession, root: str) -> DataFrame:
    return order_notes(spark, root).select("note_id", abbreviations.expand(F.col("text")).alias("text"))


def abbreviations_in_brackets(spark: SparkSession, root: str) -> DataFrame:
    return order_notes(spark, root).select("note_id", abbreviations.expand(F.col("text"), inline=False).alias("text"))


def abbreviations_merged(spark: SparkSession, root: str) -> DataFrame:
    """Expansion by the built-in dictionary with entries of the caller, which win."""
    known = Abbreviations.builtin().added(MERGED)
    return order_notes(spark, root).select("note_id", abbreviations.expand(F.col("text"), known).alias("text"))


def abbreviation_dictionary(spark: SparkSession, root: str) -> DataFrame:
    return abbreviations.dictionary(spark)


def abbreviation_lookup(spark: SparkSession, root: str) -> DataFrame:
    words = order_notes(spark, root).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("word")).distinct()
    return words.select("word", abbreviations.lookup(F.col("word")).alias("expansion"))


def abbreviation_frequency(spark: SparkSession, root: str) -> DataFrame:
    return abbreviations.found(order_notes(spark, root), "note_id").groupBy("abbreviation", "expansion").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("note_id").alias("notes"))


def token_query(spark: SparkSession, root: str) -> DataFrame:
    return tokens.token_rows(order_notes(spark, root), "note_id").drop("token_no")


def token_types(spark: SparkSession, root: str) -> DataFrame:
    return token_query(spark, root).groupBy("token_type").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("token").alias("distinct_tokens"))


def sentence_query(spark: SparkSession, root: str) -> DataFrame:
    return tokens.sentence_rows(order_notes(spark, root), "note_id").drop("sentence_no")


def document_sentences(spark: SparkSession, root: str) -> DataFrame:
    return tokens.sentence_rows(table(spark, root, "documents").select("doc_id", "text"))


def sentence_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Sentences with the number of their tokens, counted from the start of the sentence."""
    rows = exploded(order_notes(spark, root), "note_id", tokens.sentences(F.col("text"), with_tokens=True), "sentence_no")
    return rows.select("note_id", "sentence_no", F.size("x.tokens").alias("tokens"))


def entity_candidates(spark: SparkSession, root: str) -> DataFrame:
    rows = exploded(order_notes(spark, root), "note_id", entities.candidates(F.col("text")))
    return rows.select("note_id", "x.text", "x.entity_type", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"), "x.confidence", "x.source")


def entity_query(spark: SparkSession, root: str) -> DataFrame:
    return entities.entity_rows(_entities(spark, root), "note_id")


def entities_top(spark: SparkSession, root: str) -> DataFrame:
    """The limit of the extraction as a feature: the three longest entities of each note."""
    top = F.slice(entities.resolve(entities.candidates(F.col("text"))), 1, 3)
    rows = exploded(order_notes(spark, root), "note_id", top)
    return rows.select("note_id", "x.text", "x.entity_type", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"))


def entities_confident(spark: SparkSession, root: str) -> DataFrame:
    """Entities over a threshold that only one way of finding them reaches."""
    found = entities.with_entities(order_notes(spark, root), conf=EngineConf(confidence_threshold=0.87))
    return entities.entity_rows(found, "note_id")


def entity_stats(spark: SparkSession, root: str) -> DataFrame:
    s = _entities(spark, root).select("note_id", entities.stats(F.col("entities")).alias("s"))
    return s.select("note_id", F.col("s.total").cast("bigint").alias("total"), *[F.col("s.by_type").getItem(k).cast("bigint").alias(k.lower()) for k, *_ in ENTITY_TYPES], F.round("s.avg_confidence", 6).alias("avg_confidence"))


def entity_labels(spark: SparkSession, root: str) -> DataFrame:
    return entities.labelled(entity_query(spark, root)).groupBy("entity_type", "label_pt", "label_en", "color").agg(F.count(F.lit(1)).alias("entities"))


def relation_query(spark: SparkSession, root: str) -> DataFrame:
    return relations.relation_rows(_related(spark, root), "note_id")


def relations_by_type(spark: SparkSession, root: str) -> DataFrame:
    return relation_query(spark, root).groupBy("relation_type").agg(
        F.count(F.lit(1)).alias("relations"), F.count_distinct("note_id").alias("notes"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def medication_profiles(spark: SparkSession, root: str) -> DataFrame:
    return relations.profile_rows(_related(spark, root), "note_id").select(
        "note_id", "medication", F.array_join("dosages", "|").alias("dosages"), F.array_join("conditions", "|").alias("conditions"))


def summary_groups(spark: SparkSession, root: str) -> DataFrame:
    found = _entities(spark, root)
    groups = F.array(*[F.struct(F.lit(g).alias("entity_type"), summaries.distinct_texts(F.col("entities"), g).alias("texts")) for g in summaries.GROUPS])
    rows = exploded(found, "note_id", groups).where(F.size("x.texts") > 0)
    return rows.select("note_id", "x.entity_type", F.array_join("x.texts", "|").alias("texts"))


def summary_medications(spark: SparkSession, root: str) -> DataFrame:
    return exploded(_summed(spark, root), "note_id", F.col("summary.medicamentos"), "medication_no").select("note_id", "medication_no", "x.*")


def summary_json(spark: SparkSession, root: str) -> DataFrame:
    return _summed(spark, root).select("note_id", F.to_json("summary").alias("summary"))


def prompt_lines(spark: SparkSession, root: str) -> DataFrame:
    return _related(spark, root).select("note_id", summaries.entity_lines(F.col("entities"), F.col("relations")).alias("lines"))


def prompt_text(spark: SparkSession, root: str) -> DataFrame:
    return _related(spark, root).select("note_id", summaries.prompt(F.col("entities"), F.col("relations"), F.col("text")).alias("prompt"))


def generated_summaries(spark: SparkSession, root: str) -> DataFrame:
    """The call of a client for each prompt; this one answers with the length of what it is asked."""
    return summaries.generated(prompt_text(spark, root), lambda: lambda prompt: str(len(prompt)), key="note_id").select("note_id", "summary")


def _with_patient(notes: DataFrame) -> DataFrame:
    """A patient for each note, null for some."""
    return notes.withColumn("patient", F.when(F.col("note_id") % 97 > 0, F.concat(F.lit("pac-"), (F.col("note_id") % 97).cast("string"))))


def fhir_resource_json(spark: SparkSession, root: str) -> DataFrame:
    return fhir.resource_rows(_with_patient(_entities(spark, root)), "note_id", patient="patient").select("note_id", "entity_no", "resource")


def fhir_bundle_json(spark: SparkSession, root: str) -> DataFrame:
    made = _with_patient(_entities(spark, root))
    return made.select("note_id", fhir.bundle(F.col("entities"), F.col("note_id"), fhir.patient_of("patient")).alias("bundle"))


def fhir_composition_json(spark: SparkSession, root: str) -> DataFrame:
    made = _with_patient(_summed(spark, root))
    return made.select("note_id", fhir.composition(F.col("summary"), F.col("note_id"), fhir.patient_of("patient")).alias("composition"))


def fhir_resources(spark: SparkSession, root: str) -> DataFrame:
    at = lambda path: F.get_json_object("resource", path)
    return fhir.resource_rows(_entities(spark, root), "note_id").select(
        "note_id", "entity_no", "resource_type", at("$.status").alias("status"), F.coalesce(at("$.code.text"), at("$.medicationCodeableConcept.text")).alias("text"), at("$.note[0].text").alias("note"))


def fhir_bundle_counts(spark: SparkSession, root: str) -> DataFrame:
    bundles = _entities(spark, root).select(fhir.bundle(F.col("entities"), F.col("note_id")).alias("b"))
    entries = exploded(bundles, "b", F.from_json(F.get_json_object("b", "$.entry"), "array<struct<request:struct<url:string>>>"))
    return entries.groupBy(F.col("x.request.url").alias("resource_type")).agg(F.count(F.lit(1)).alias("entries"))


def fhir_sections(spark: SparkSession, root: str) -> DataFrame:
    made = _summed(spark, root).select("note_id", fhir.composition(F.col("summary"), F.col("note_id")).alias("c"))
    rows = exploded(made, "note_id", F.from_json(F.get_json_object("c", "$.section"), "array<struct<title:string,code:struct<text:string>,text:struct<div:string>>>"))
    return rows.select("note_id", "x.title", F.col("x.code.text").alias("code"), F.col("x.text.div").alias("div"))


def entity_overview(spark: SparkSession, root: str) -> DataFrame:
    rows = entities.entity_rows(pipeline.expanded(order_notes(spark, root)), "note_id")
    return rows.groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("note_id").alias("notes"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def _flow_counts(processed: DataFrame) -> DataFrame:
    found = F.concat(F.transform("entities", lambda e: F.struct(F.lit("entity").alias("part"), e.entity_type.alias("kind"))),
                     F.transform("relations", lambda r: F.struct(F.lit("relation").alias("part"), r.relation_type.alias("kind"))))
    return exploded(processed, "note_id", found).groupBy("x.part", "x.kind").agg(F.count(F.lit(1)).alias("n"))


def flow_report(spark: SparkSession, root: str) -> DataFrame:
    return _flow_counts(pipeline.report(order_notes(spark, root)))


def flow_expanded(spark: SparkSession, root: str) -> DataFrame:
    return _flow_counts(pipeline.expanded(order_notes(spark, root)))


def clinical_flow(spark: SparkSession, root: str) -> DataFrame:
    """The expanded flow over the clinical notes, each once, with all their scripts and dirt."""
    notes = once(table(spark, root, "clinical_texts"), "note_id", "received_at", "text", "note_name")
    done = pipeline.expanded(notes)
    return done.select("note_id", "note_name", F.size("entities").alias("entities"), F.size("relations").alias("relations"), F.to_json("summary").alias("summary"))


def clinical_bundles(spark: SparkSession, root: str) -> DataFrame:
    notes = once(table(spark, root, "clinical_texts"), "note_id", "received_at", "text", "patient_id")
    return pipeline.documents_of(pipeline.expanded(notes), "note_id", patient="patient_id")


def _common(spark: SparkSession, root: str) -> DataFrame:
    records = units.records_of(table(spark, root, "clinical_entities"), table(spark, root, "observations"))
    return units.to_common_units(records, table(spark, root, "quantities"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _common(spark, root).where("unit is not null and solution = 'unique'").select("source_table", "record_id", "quantity_id", "scaled_value")


def p5_common_units(spark: SparkSession, root: str) -> DataFrame:
    return _common(spark, root)


def queries() -> dict[str, Query]:
    named = (
        normalize_full, protected_measurements, abbreviations_inline, abbreviations_in_brackets, abbreviations_merged, abbreviation_dictionary, abbreviation_lookup, abbreviation_frequency,
        token_types, document_sentences, sentence_tokens, entity_candidates, entities_top, entities_confident, entity_stats, entity_labels, relations_by_type, medication_profiles,
        summary_groups, summary_medications, summary_json, prompt_lines, prompt_text, generated_summaries, fhir_resources, fhir_resource_json, fhir_bundle_json, fhir_composition_json, fhir_bundle_counts, fhir_sections, entity_overview,
        flow_report, flow_expanded, clinical_flow, clinical_bundles, p5_found, p5_common_units,
    )
    out: dict[str, Query] = {
        "normalize_symbols": _document_query(normalize.symbols), "normalize_controls": _document_query(normalize.strip_controls),
        "normalize_whitespace": _document_query(normalize.whitespace), "normalize_lower": _document_query(F.lower),
        "normalize_nfc": _document_query(normalize.nfc), "remove_accents": _document_query(normalize.remove_accents),
        "dosage_amounts": _span_query(patterns.DOSE_AMOUNT), "dosage_frequencies": _span_query(patterns.DOSE_FREQUENCY), "dosage_intervals": _span_query(patterns.DOSE_INTERVAL),
        "dosage_every": _span_query(patterns.DOSE_EVERY), "dosage_routes": _span_query(patterns.DOSE_ROUTE), "lab_values": _span_query(*patterns.LABS),
        "tokens": token_query, "sentences": sentence_query, "entities": entity_query, "relations": relation_query,
    }
    out |= {f"gazetteer_{kind.lower()}": _term_query(kind) for kind, _ in Gazetteers().by_type()}
    return out | {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
