"""Sources, sinks, configuration, the stream and the registry."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from notaflux import EngineConf
from notaflux.plans import pipeline, registry
from notaflux.sources import sinks, tables
from notaflux.streaming import notes as stream

SMALL = "/root/testdata/sf0.001"


def test_once_takes_the_first_and_settles_ties(spark):
    d = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, d, "b"), (1, d, "a"), (1, dt.datetime(2025, 1, 1), "0"), (2, None, None), (None, d, "x"), (None, d, "x"), (None, None, "y")], "id bigint, at timestamp, text string")
    assert sorted((str(r["id"]), str(r["text"])) for r in tables.once(df, "id", "at", "text").collect()) == [("1", "a"), ("2", "None"), ("None", "x"), ("None", "x"), ("None", "y")]
    assert tables.once(df.limit(0), "id", "at").count() == 0


def test_configuration(tmp_path, monkeypatch):
    assert EngineConf.from_yaml(tmp_path / "none.yaml") == EngineConf()
    assert EngineConf.from_mapping({"ner": {"confidence_threshold": 0.7, "unknown": 1}, "fhir": {"base_url": "http://x"}}).confidence_threshold == 0.7
    monkeypatch.setenv("NOTAFLUX_RELATION_WINDOW", "99")
    monkeypatch.setenv("NOTAFLUX_LOWERCASE", "no")
    conf = EngineConf.from_env()
    assert conf.relation_window == 99 and conf.lowercase is False


def test_sources_and_sinks(spark, tmp_path):
    notes = tables.texts_from_memory(spark, {"a": "Febre e tosse", "b": None})
    done, seen = sinks.counted(pipeline.expanded(notes, "text"))
    sinks.write_json(done.select("doc_id", "text", F.to_json("summary").alias("summary")), str(tmp_path / "json"))
    assert seen.get["rows"] == 2 and seen.get["entities"] == 2
    back = tables.texts_from_json(spark, str(tmp_path / "json"))
    assert sorted(r["doc_id"] for r in back.collect()) == [0, 1]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "n.txt").write_text("Dor\nFebre", encoding="utf-8")
    assert tables.texts_from_files(spark, str(tmp_path / "t")).first()["text"] == "Dor\nFebre"


def test_stream_equals_batch(spark, tmp_path):
    notes = spark.createDataFrame([(1, "Febre, losartana 50mg"), (2, "Sem queixas"), (3, None)], "note_id bigint, text string")
    notes.repartition(2).write.parquet(str(tmp_path / "in"))
    stream.write_entities(stream.note_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streamed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {tuple(r) for r in stream.entity_stream(notes).collect()} and len(streamed) == 3


def test_flows_are_shuffle_free(spark):
    notes = spark.createDataFrame([(1, "Febre")], "doc_id bigint, text string")
    for flow in (pipeline.report, pipeline.expanded):
        plan = flow(notes)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["entity_overview", "flow_report", "entities", "relations", "summary_json", "fhir_sections", "p5_found"])
def test_registered_queries_run(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_configured_dictionary_reaches_the_flow(spark, tmp_path):
    path = tmp_path / "more.json"
    path.write_text('{"XYZ": "Xis Ipsilon"}', encoding="utf-8")
    df = spark.createDataFrame([(1, "paciente XYZ")], "doc_id bigint, text string")
    conf = EngineConf.from_mapping({"preprocessing": {"abbreviation_dict_path": str(path), "lowercase": False}})
    assert pipeline.expanded(df, conf=conf).first()["expanded"] == "paciente Xis Ipsilon"
    assert pipeline.report(df, conf=conf).first()["expanded"] == "paciente XYZ (Xis Ipsilon)"


def test_patient_of_each_note(spark):
    df = spark.createDataFrame([(1, "p-7", "febre"), (2, None, "tosse")], "doc_id bigint, who string, text string")
    made = pipeline.documents_of(pipeline.expanded(df), patient="who").orderBy("doc_id").collect()
    assert ['"Patient/p-7"' in r["bundle"] and '"Patient/p-7"' in r["composition"] for r in made] == [True, False]
    assert '"Patient/synthetic-patient-001"' in made[1]["bundle"]
