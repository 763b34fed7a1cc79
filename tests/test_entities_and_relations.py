"""Entities, relations, profiles, summaries and FHIR: hand-derived values and invariants."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from notaflux.conf import EngineConf
from notaflux.functions.vocab import Gazetteers
from notaflux.operators import entities, fhir, relations, summaries
from notaflux.plans import pipeline

SAMPLE = "Paciente com HAS em uso de Losartana 50mg 1x/dia. DM2 controlada com Metformina 850mg 2x/dia. Hemoglobina: 12,5 g/dL."


@pytest.fixture(scope="module")
def processed(spark):
    notes = spark.createDataFrame([(1, SAMPLE), (2, ""), (3, None)], "doc_id bigint, text string")
    return pipeline.expanded(notes).cache()


def test_pipeline_entities(processed):
    row = processed.where("doc_id = 1").first()
    assert [(e["entity_type"], e["text"], e["start"], e["end"], e["confidence"]) for e in row["entities"]] == [
        ("CONDICAO", "Hipertensao", 13, 24, 0.8), ("MEDICAMENTO", "losartana", 54, 63, 0.8), ("DOSAGEM", "50mg", 64, 68, 0.9), ("DOSAGEM", "1x/dia", 69, 75, 0.9),
        ("CONDICAO", "Diabetes", 77, 85, 0.8), ("MEDICAMENTO", "metformina", 117, 127, 0.8), ("DOSAGEM", "850mg", 128, 133, 0.9), ("DOSAGEM", "2x/dia", 134, 140, 0.9),
        ("VALOR_LABORATORIAL", "hemoglobina: 12,5 g/dl", 142, 164, 0.85)]
    for e in row["entities"]:
        assert row["expanded"][e["start"] : e["end"]] == e["text"]


def test_pipeline_relations(processed):
    rel = [(r["relation_type"], r["source"]["text"], r["target"]["text"], r["confidence"]) for r in processed.where("doc_id = 1").first()["relations"]]
    assert rel == [
        ("TREATS", "Hipertensao", "losartana", 0.8), ("TREATS", "Hipertensao", "metformina", 0.5), ("HAS_DOSAGE", "losartana", "50mg", 1.0), ("HAS_DOSAGE", "losartana", "1x/dia", 1.0),
        ("TREATS", "losartana", "Diabetes", 0.907), ("HAS_DOSAGE", "losartana", "850mg", 0.717), ("HAS_DOSAGE", "losartana", "2x/dia", 0.677), ("HAS_DOSAGE", "metformina", "50mg", 0.823),
        ("HAS_DOSAGE", "metformina", "1x/dia", 0.87), ("TREATS", "Diabetes", "metformina", 0.787), ("HAS_DOSAGE", "metformina", "850mg", 1.0), ("HAS_DOSAGE", "metformina", "2x/dia", 1.0)]
    assert processed.where("doc_id = 1").first()["relations"][0]["evidence"] == "paciente com Hipertensao Arterial Sistemica em uso de losartana 50mg 1x/dia. Diabet"


def test_empty_and_null_texts(processed):
    for r in processed.where("doc_id > 1").collect():
        assert r["entities"] == [] and r["relations"] == [] and r["summary"]["medicamentos"] == []


def test_summary_and_fhir(processed):
    row = processed.where("doc_id = 1").select(F.to_json("summary").alias("s"), fhir.bundle(F.col("entities"), F.col("doc_id")).alias("b"), fhir.composition(F.col("summary"), F.col("doc_id")).alias("c")).first()
    both = "50mg, 1x/dia, 850mg, 2x/dia"
    assert json.loads(row["s"]) == {
        "condicoes": ["Hipertensao", "Diabetes"], "procedimentos": [], "valores_laboratoriais": ["hemoglobina: 12,5 g/dl"],
        "medicamentos": [{"nome": m, "dosagem": both, "indicacao": "Hipertensao, Diabetes"} for m in ("losartana", "metformina")]}
    entries = json.loads(row["b"])["entry"]
    assert [e["request"]["url"] for e in entries] == ["Condition", "MedicationStatement", "Condition", "MedicationStatement", "Observation"]
    assert all(e["fullUrl"].endswith(e["resource"]["id"]) for e in entries) and entries[4]["resource"]["valueString"] == "hemoglobina: 12,5 g/dl"
    sections = json.loads(row["c"])["section"]
    assert [s["title"] for s in sections] == ["Condicoes Clinicas", "Medicamentos", "Exames Laboratoriais"]
    assert sections[1]["text"]["div"] == f"<div>losartana - {both}; metformina - {both}</div>"


def test_stats(processed):
    s = processed.where("doc_id = 1").select(entities.stats(F.col("entities")).alias("s")).first()["s"]
    assert s["total"] == 9 and s["by_type"] == {"MEDICAMENTO": 2, "DOSAGEM": 4, "CONDICAO": 2, "PROCEDIMENTO": 0, "VALOR_LABORATORIAL": 1} and s["avg_confidence"] == pytest.approx(0.85)
    assert processed.where("doc_id = 2").select(entities.stats(F.col("entities")).alias("s")).first()["s"]["by_type"] == {}


@pytest.mark.parametrize(("gap", "kinds", "wanted"), [
    (150, ("MEDICAMENTO", "CONDICAO"), ("TREATS", 0.5, "a")), (150, ("MEDICAMENTO", "DOSAGEM"), ("HAS_DOSAGE", 0.65, "a")), (151, ("MEDICAMENTO", "DOSAGEM"), None),
    (3, ("DOSAGEM", "MEDICAMENTO"), ("HAS_DOSAGE", 1.0, "b")), (3, ("VALOR_LABORATORIAL", "CONDICAO"), ("HAS_RESULT", 0.98, "a")), (3, ("CONDICAO", "VALOR_LABORATORIAL"), None), (3, ("CONDICAO", "CONDICAO"), None),
])
def test_window_and_orientation(spark, gap, kinds, wanted):
    pair = [("a", kinds[0], 0, 5, 0.8, "x", {}), ("b", kinds[1], 5 + gap, 9 + gap, 0.8, "x", {})]
    df = spark.createDataFrame([(pair, "t" * 300)], f"entities array<{entities.ENTITY}>, text string")
    got = df.select(relations.relations(F.col("entities"), F.col("text")).alias("r")).first()["r"]
    assert ([(r["relation_type"], r["confidence"], r["source"]["text"]) for r in got] or [None])[0] == wanted


def test_overlap_longest_wins_and_limit_takes_the_longest(spark):
    df = spark.createDataFrame([("paciente com creatinina: 1,2 mg/dL",), ("febre tosse 500mg dor insuficiencia renal",)], "text string")
    first, second = df.select(entities.extract(F.col("text")).alias("e")).collect()
    assert [(e["start"], e["end"]) for e in first["e"]] == [(0, 34)]
    assert [e["text"] for e in second["e"]] == ["febre", "tosse", "500mg", "dor", "insuficiencia renal"]
    limited = df.where("text like 'febre%'").select(entities.extract(F.col("text"), EngineConf(max_entities_per_text=2)).alias("e")).first()
    assert [e["text"] for e in limited["e"]] == ["500mg", "insuficiencia renal"] or [e["text"] for e in limited["e"]] == ["febre", "insuficiencia renal"]
    strict = df.where("text like 'febre%'").select(entities.extract(F.col("text"), EngineConf(confidence_threshold=0.85)).alias("e")).first()
    assert [e["text"] for e in strict["e"]] == ["500mg"]


def test_gazetteer_join_equals_patterns(spark):
    df = spark.createDataFrame([(1, "Sars-CoV-2 e covid-19, doenca pulmonar obstrutiva cronica; edema  de dor")], "doc_id bigint, text string")
    joined = {(r["text"], r["start_pos"]) for r in entities.gazetteer_join(df, entities.vocabulary_table(spark)).collect()}
    assert joined == {("Sars-CoV-2", 0), ("covid-19", 13), ("doenca pulmonar obstrutiva cronica", 23), ("edema", 59), ("dor", 69)}
    found = {(e["text"], e["start"]) for e in df.select(entities.extract(F.col("text")).alias("e")).first()["e"]}
    assert found == joined


def test_labels_of_unknown_types(spark):
    df = spark.createDataFrame([("x", "OUTRO"), ("y", "CONDICAO")], "text string, entity_type string")
    rows = {r["text"]: r for r in entities.labelled(df).collect()}
    assert rows["x"]["label_pt"] == "OUTRO" and rows["x"]["color"] == "#757575" and rows["y"]["label"] == "[CONDICAO] y"


def test_distinct_texts_keep_the_first_form(spark):
    es = [("Dor", "CONDICAO", 0, 3, 0.8, "x", {}), ("dor", "CONDICAO", 5, 8, 0.8, "x", {}), ("Febre", "CONDICAO", 9, 14, 0.8, "x", {}), ("dipirona", "MEDICAMENTO", 15, 23, 0.8, "x", {})]
    df = spark.createDataFrame([(es, [])], f"entities array<{entities.ENTITY}>, relations array<{relations.RELATION}>")
    s = df.select(summaries.summary(F.col("entities"), F.col("relations")).alias("s"), summaries.prompt(F.col("entities"), F.col("relations"), F.lit("z" * 3000)).alias("p")).first()
    assert s["s"]["condicoes"] == ["Dor", "Febre"] and s["s"]["medicamentos"][0]["nome"] == "dipirona" and s["s"]["medicamentos"][0]["dosagem"] is None
    assert "z" * 2000 in s["p"] and "z" * 2001 not in s["p"] and "\nCONDICAO:\n  - Dor\n  - Febre" in s["p"]


def test_generated_retries(spark, tmp_path):
    marker = str(tmp_path / "tried")

    def client():
        import os

        def call(prompt: str) -> str:
            if not os.path.exists(marker):
                open(marker, "w").close()
                raise RuntimeError("busy")
            return prompt.upper()

        return call

    df = spark.createDataFrame([(1, "abc")], "doc_id bigint, prompt string").coalesce(1)
    assert summaries.generated(df, client, wait=0.01).first()["summary"] == "ABC"


OVERLAPPING = Gazetteers(medications=("dipirona",), conditions=("dor aguda", "aguda persistente", "persistente grave e longa", "dor", "um dois tres quatro cinco", "e longa dor"), procedures=("dor aguda", "grave e"))


def by_hand(text, vocabulary):
    """Every place of every term, then the longest first."""
    found = [(m.start(), m.end(), k, kind) for k, (kind, words) in enumerate(vocabulary.by_type()) for w in words for m in re.finditer(rf"\b{re.escape(w)}\b", text.lower())]
    kept = []
    for c in sorted(found, key=lambda c: (c[0] - c[1], c[2], c[0])):
        if all(c[1] <= k[0] or c[0] >= k[1] for k in kept):
            kept.append(c)
    return found, sorted(kept)


@pytest.mark.parametrize("text", ["dor aguda persistente", "Dor aguda persistente grave e longa dor aguda", "um dois tres quatro cinco um dois", "", "dipirona"])
def test_overlapping_terms_are_all_candidates(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found, kept = by_hand(text, OVERLAPPING)
    row = df.select(entities.candidates(F.col("text"), OVERLAPPING).alias("c"), entities.extract(F.col("text"), vocabulary=OVERLAPPING).alias("e")).first()
    assert sorted((c["start"], c["end"], c["entity_type"]) for c in row["c"]) == sorted((s, e, kind) for s, e, _, kind in found)
    assert [(e["start"], e["end"], e["entity_type"]) for e in row["e"]] == [(s, e, kind) for s, e, _, kind in kept]
    joined = entities.gazetteer_join(df, entities.vocabulary_table(spark, OVERLAPPING)).collect()
    assert sorted((r["start_pos"], r["end_pos"], r["entity_type"]) for r in joined) == sorted((s, e, kind) for s, e, _, kind in found)


def test_resolution_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for n in (0, 1, 7, 60, 1500):
        spans = [(rng.randrange(4 * n), rng.randrange(1, 9)) for _ in range(n)]
        rows.append(([(k, "x" * size, "T", at, at + size, rng.choice([0.8, 0.9]), "s") for k, (at, size) in enumerate(spans)],))
    df = spark.createDataFrame(rows, "c array<struct<order:int,text:string,entity_type:string,start:int,end:int,confidence:double,source:string>>")
    for r in df.select("c", entities.resolve(F.col("c")).alias("k")).collect():
        kept = []
        for c in sorted(r["c"], key=lambda c: (c["start"] - c["end"], -c["confidence"], c["order"], c["start"])):
            if all(c["end"] <= k["start"] or c["start"] >= k["end"] for k in kept):
                kept.append(c)
        assert [(k["start"], k["end"], k["k3"]) for k in r["k"]] == [(k["start"], k["end"], k["order"]) for k in kept]


def test_a_long_note_takes_seconds(spark):
    text = "paciente com febre e dor, usa dipirona 500mg 6/6h. " * 6_000
    began = time.perf_counter()
    assert spark.createDataFrame([(text,)], "text string").select(F.size(entities.resolve(entities.candidates(F.col("text"))))).first()[0] == 24_000
    assert time.perf_counter() - began < 30
