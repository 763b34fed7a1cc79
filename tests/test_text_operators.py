"""Normalisation, abbreviations, tokens, sentences: exact values and hard texts."""

from __future__ import annotations

import json

import unicodedata

import pytest
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notaflux.conf import EngineConf
from notaflux.functions.spans import spans
from notaflux.functions.vocab import Abbreviations, Gazetteers
from notaflux.operators import abbreviations, normalize, tokens


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "wanted"), [
    ("Temperatura: 38°C – febre", "temperatura: 38 graus c - febre"),
    ("Hemoglobina 12,5 g/dL", "hemoglobina 12,5 g/dl"),
    ("Paciente   com\tdor", "paciente com dor"),
    ("50   MG de manhã", "50   MG de manhã"),
    ("a\n\n\n\n\nb", "a\n\nb"),
    ("a\x00b\x0bc", "abc"),
    ("Em 15/03/2024 as 14:30 VO", "em 15/03/2024 as 14:30 vo"),
    ("  \n\t ", ""), ("", ""), (None, None),
    ("Café “ok” • nº", "café \"ok\" - no"),
])
def test_normalize_exact(spark, text, wanted):
    assert one(spark, text, normalize.normalize(F.col("text"))) == wanted


def test_normalize_options(spark):
    conf = EngineConf(lowercase=False, normalize_accents=True, remove_extra_whitespace=False)
    assert one(spark, "Fração  de EJEÇÃO", normalize.normalize(F.col("text"), conf)) == "Fracao  de EJECAO"


@pytest.mark.parametrize(("text", "inline", "wanted"), [
    ("Paciente com HAS", True, "Paciente com Hipertensao Arterial Sistemica"),
    ("Paciente com HAS", False, "Paciente com HAS (Hipertensao Arterial Sistemica)"),
    ("HbA1c", True, "Hemoglobina Glicada"), ("hba1c", True, "hba1c"), ("rx", True, "Radiografia"), ("Rx", True, "Prescricao"), ("mg", True, "mg"),
    ("ÁHAS HAS_x HAS.", True, "ÁHAS HAS_x Hipertensao Arterial Sistemica."), ("CK-MB e CA-19.9", True, "Creatina Quinase MB e Antigeno CA 19.9"), ("", True, ""), (None, True, None),
])
def test_expand(spark, text, inline, wanted):
    assert one(spark, text, abbreviations.expand(F.col("text"), inline=inline)) == wanted


def test_dictionary_is_immutable_and_later_wins(spark, tmp_path):
    base = Abbreviations.builtin()
    assert len(base) == 176
    more = base.added({"TESTE": "Texto de Teste", "HAS": "Outra"})
    assert len(base) == 176 and len(more) == 177
    assert one(spark, "TESTE HAS", abbreviations.expand(F.col("text"), more)) == "Texto de Teste Outra"
    path = tmp_path / "more.json"
    path.write_text(json.dumps({"XYZ": "Xis"}), encoding="utf-8")
    assert abbreviations.load(str(path)).mapping["XYZ"] == "Xis"
    assert len(abbreviations.load(str(tmp_path / "none.json"))) == 176
    path.write_text("{broken", encoding="utf-8")
    assert len(abbreviations.load(str(path))) == 176
    with pytest.raises(FileNotFoundError):
        abbreviations.load(str(tmp_path / "none.json"), required=True)


def test_vocabulary_sizes():
    assert [len(words) for _, words in Gazetteers().by_type()] == [95, 85, 54]


def listed(rows):
    return [(r["text"], r["token_type"], r["start"], r["end"]) for r in rows]


def test_tokens_exact(spark):
    assert listed(one(spark, "Losartana 50mg 1x/dia.", tokens.tokens(F.col("text")))) == [
        ("Losartana", "word", 0, 9), ("50mg", "measurement", 10, 14), ("1", "unknown", 15, 16), ("x", "unknown", 16, 17), ("/", "punctuation", 17, 18), ("dia", "word", 18, 21), (".", "punctuation", 21, 22)]
    assert listed(one(spark, "PA 120x80 mmHg", tokens.tokens(F.col("text"))))[1] == ("120x80 mmHg", "measurement", 3, 14)
    assert one(spark, "", tokens.tokens(F.col("text"))) == [] and one(spark, None, tokens.tokens(F.col("text"))) == []


def test_sentences_exact(spark):
    got = one(spark, "Paciente estavel. Evolucao favoravel. Alta programada.", tokens.sentences(F.col("text")))
    assert [(s["start"], s["end"]) for s in got] == [(0, 17), (18, 37), (38, 54)]
    got = one(spark, "Queixa:\n  dor\n\nHistoria: nada", tokens.sentences(F.col("text"), with_tokens=True))
    assert [s["text"] for s in got] == ["Queixa:", "dor", "Historia: nada"]
    assert [t["start"] for t in got[2]["tokens"]] == [0, 8, 10]


def test_long_run_of_words_is_linear(spark):
    from notaflux.operators.entities import lab_values

    text = "palavra " * 20_000
    assert one(spark, text, F.size(lab_values(F.col("text")))) == 0


@settings(max_examples=25, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@example(texts=["1 %1", "1 \n%", "120x80  mmHg"])
@given(texts=st.lists(st.text(alphabet="aB é😀1,.\n\u0001³x%-", max_size=60), min_size=1, max_size=20))
def test_spans_and_tokens_cut_the_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", spans(F.col("text"), r"\p{L}+").alias("s"), tokens.tokens(F.col("text")).alias("t")).collect():
        for part in (*r["s"], *r["t"]):
            assert r["text"][part["start"] : part["end"]] == part["text"]
        covered = "".join("".join(t["text"].split()) for t in r["t"])  # a measurement may hold white space
        assert covered == "".join(r["text"].split())


@pytest.mark.parametrize(("text", "wanted"), [("a\u0001b", "ab"), ("a\u0004b\u0007 50\u0002MG", "ab 50mg"), ("\u0003", ""), ("x\u0008y", "xy")])
def test_controls_of_the_marks_are_stripped_too(spark, text, wanted):
    assert one(spark, text, normalize.normalize(F.col("text"))) == wanted


@pytest.mark.parametrize("text", ["สัปดาห์", "हिन्दी में", "ação ﬁm", "e\u0301", "Ḱ²", "кй"])
def test_accents_by_combining_class(spark, text):
    wanted = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    assert one(spark, text, normalize.remove_accents(F.col("text"))) == wanted


def test_expansion_keeps_control_characters(spark):
    text = "\u0001HAS\u0002\u0003 e \u0002\u0004DM2\u0001\u0003"
    assert one(spark, text, abbreviations.expand(F.col("text"))) == text.replace("HAS", "Hipertensao Arterial Sistemica").replace("DM2", "Diabetes Mellitus Tipo 2")
    assert one(spark, "\u0001\u0002\u0003\u0004", abbreviations.expand(F.col("text"), inline=False)) == "\u0001\u0002\u0003\u0004"
