"""FHIR R4 resources of entities and summaries, as JSON.

Ids are derived from what a resource describes and dates from the configured day, so a run can be repeated; the
configuration can ask for random ids and the clock instead. Dosages become no resource.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notaflux.conf import EngineConf
from notaflux.functions.spans import let

# Code systems, codes and texts of the resources.
CLINICAL_STATUS = ("http://terminology.hl7.org/CodeSystem/condition-clinical", "active", "Active")
VERIFICATION = ("http://terminology.hl7.org/CodeSystem/condition-ver-status", "confirmed", "Confirmed")
NOTE = "Extraido automaticamente por NLP (confianca: %.2f)"
COMPOSITION_CODE = ("http://loinc.org", "11488-4", "Consultation Note")
COMPOSITION_TITLE = "Resumo Clinico Gerado por NLP"
# The sections of a composition: title, code and what joins the items.
SECTIONS = (
    ("condicoes", "Condicoes Clinicas", "Conditions", ", "),
    ("medicamentos", "Medicamentos", "Medications", "; "),
    ("procedimentos", "Procedimentos", "Procedures", ", "),
    ("valores_laboratoriais", "Exames Laboratoriais", "Lab Results", "; "),
)
# The resource of each entity type.
RESOURCES = {"CONDICAO": "Condition", "MEDICAMENTO": "MedicationStatement", "PROCEDIMENTO": "Procedure", "VALOR_LABORATORIAL": "Observation"}


def _uuid(conf: EngineConf, *of: Column) -> Column:
    if conf.random_ids:
        return F.call_function("uuid")
    h = F.md5(F.concat_ws("|", *[c.cast("string") for c in of]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _day(conf: EngineConf) -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd") if conf.random_ids else F.lit(conf.as_of)


def _moment(conf: EngineConf) -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if conf.random_ids else F.lit(f"{conf.as_of}T00:00:00+00:00")


def _coding(values: tuple[str, str, str]) -> Column:
    system, code, display = values
    return F.struct(F.array(F.struct(F.lit(system).alias("system"), F.lit(code).alias("code"), F.lit(display).alias("display"))).alias("coding"))


def patient_of(column: str | None, conf: EngineConf | None = None) -> Column:
    """The patient of each note: a column, and the configured one where there is none or it is null."""
    fallback = F.lit((conf or EngineConf()).patient_id)
    return F.coalesce(F.col(column).cast("string"), fallback) if column else fallback


def resource_type(entity_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in RESOURCES.items() for x in pair]), entity_type)


def resource(entity: Column, key: Column, patient: Column, conf: EngineConf | None = None) -> Column:
    """The JSON of the resource of one entity; null for a dosage or an unknown type."""
    conf = conf or EngineConf()
    rid = _uuid(conf, key, entity.start, entity.end, entity.entity_type).alias("id")
    subject = F.struct(F.concat(F.lit("Patient/"), patient).alias("reference")).alias("subject")
    named = F.struct(entity.text.alias("text"))
    note = F.array(F.struct(F.format_string(NOTE, entity.confidence).alias("text"))).alias("note")
    kind = lambda k: F.lit(k).alias("resourceType")
    status = lambda s: F.lit(s).alias("status")
    condition = F.struct(kind("Condition"), rid, _coding(CLINICAL_STATUS).alias("clinicalStatus"), _coding(VERIFICATION).alias("verificationStatus"), named.alias("code"), subject, _day(conf).alias("recordedDate"), note)
    medication = F.struct(kind("MedicationStatement"), rid, status("active"), named.alias("medicationCodeableConcept"), subject, _day(conf).alias("effectiveDateTime"), note)
    procedure = F.struct(kind("Procedure"), rid, status("completed"), named.alias("code"), subject, _day(conf).alias("performedDateTime"), note)
    observation = F.struct(kind("Observation"), rid, status("final"), named.alias("code"), subject, _day(conf).alias("effectiveDateTime"), entity.text.alias("valueString"), note)
    of = entity.entity_type
    return (F.when(of == "CONDICAO", F.to_json(condition)).when(of == "MEDICAMENTO", F.to_json(medication))
            .when(of == "PROCEDIMENTO", F.to_json(procedure)).when(of == "VALOR_LABORATORIAL", F.to_json(observation)))


def bundle(entities: Column, key: Column, patient: Column | None = None, conf: EngineConf | None = None) -> Column:
    """The JSON of a transaction bundle with the resources of the entities, in their order."""
    conf = conf or EngineConf()
    patient = F.lit(conf.patient_id) if patient is None else patient

    def entry(e: Column) -> Column:
        kind = resource_type(e.entity_type)
        return let(resource(e, key, patient, conf), lambda json: F.when(json.isNotNull(), F.concat(
            F.lit('{"fullUrl":"'), F.lit(conf.fhir_base_url), F.lit("/"), kind, F.lit("/"), F.get_json_object(json, "$.id"), F.lit('","resource":'), json,
            F.lit(',"request":{"method":"POST","url":"'), kind, F.lit('"}}'))))

    entries = F.filter(F.transform(entities, entry), lambda j: j.isNotNull())
    return F.concat(F.lit('{"resourceType":"Bundle","id":"'), _uuid(conf, key, F.lit("Bundle")), F.lit('","type":"transaction","timestamp":"'), _moment(conf), F.lit('","entry":['), F.array_join(entries, ","), F.lit("]}"))


def sections(summary: Column) -> Column:
    """ARRAY<STRUCT<title, code, text>> of the sections that hold something."""
    meds = F.transform(summary.medicamentos, lambda m: F.concat(F.coalesce(m.nome, F.lit("")), F.coalesce(F.concat(F.lit(" - "), m.dosagem), F.lit(""))))
    built = []
    for field, title, code, joiner in SECTIONS:
        items = meds if field == "medicamentos" else summary.getField(field)
        body = F.struct(F.lit("generated").alias("status"), F.concat(F.lit("<div>"), F.array_join(items, joiner), F.lit("</div>")).alias("div"))
        built.append(F.when(F.size(items) > 0, F.struct(F.lit(title).alias("title"), F.struct(F.lit(code).alias("text")).alias("code"), body.alias("text"))))
    return F.filter(F.array(*built), lambda s: s.isNotNull())


def composition(summary: Column, key: Column, patient: Column | None = None, conf: EngineConf | None = None) -> Column:
    """The JSON of a composition of a structured summary."""
    conf = conf or EngineConf()
    patient = F.lit(conf.patient_id) if patient is None else patient
    return F.to_json(F.struct(
        F.lit("Composition").alias("resourceType"), _uuid(conf, key, F.lit("Composition")).alias("id"), F.lit("final").alias("status"), _coding(COMPOSITION_CODE).alias("type"),
        F.struct(F.concat(F.lit("Patient/"), patient).alias("reference")).alias("subject"), _moment(conf).alias("date"), F.lit(COMPOSITION_TITLE).alias("title"), sections(summary).alias("section")))


def resource_rows(notes: DataFrame, key: str = "doc_id", conf: EngineConf | None = None, patient: str | None = None) -> DataFrame:
    """(key, entity_no, resource_type, resource) of every entity that becomes a resource; ``patient`` as in ``patient_of``."""
    conf = conf or EngineConf()
    slim = notes.select(key, "entities", patient_of(patient, conf).alias("__patient"))
    rows = slim.select(key, "__patient", F.posexplode_outer("entities").alias("entity_no", "x")).where("entity_no is not null")
    return rows.select(key, "entity_no", resource_type(F.col("x.entity_type")).alias("resource_type"), resource(F.col("x"), F.col(key), F.col("__patient"), conf).alias("resource")).where("resource is not null")
