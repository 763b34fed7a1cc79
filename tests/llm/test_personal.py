"""Personal information: typed spans, names by disclosure, traps left alone, readable output."""

from __future__ import annotations

import pytest

from notaflux.llm import personal as P


def typed(text):
    return [(k, text[s:e]) for k, s, e in P.typed_spans(text)]


@pytest.mark.parametrize(("text", "wanted"), [
    ("E-mail ana.b+c@mail.test.example. Fim", [("email", "ana.b+c@mail.test.example")]), ("a1 (at) zap.test ou b [arroba] lumi.invalid", [("email", "a1 (at) zap.test"), ("email", "b [arroba] lumi.invalid")]),
    ("tel. +55 29 97573-7436, (20) 9 2254-4348", [("phone", "+55 29 97573-7436"), ("phone", "(20) 9 2254-4348")]), ("((36) 3758-0245)", [("phone", "(36) 3758-0245")]), ("ligar 39.98472.0433 ou 030 3244 9256 ou 3238-1228", [("phone", "39.98472.0433"), ("phone", "030 3244 9256"), ("phone", "3238-1228")]),
    ("Protocolo 202418-5587 arquivado, guia 77.20141, lote 8893412", []), ("em 14.02.2024 e 12/03/24", []), ("CPF: 467.799.859-00. cpf n. 94866845618", [("identity", "467.799.859-00"), ("identity", "94866845618")]),
    ("Cartão SUS 672 8232 2740 4033; RG nº 28.705.284-3; passaporte ZW051456", [("identity", "672 8232 2740 4033"), ("identity", "28.705.284-3"), ("identity", "ZW051456")]),
    ("Reside em rua da Lua Branca, nº 1936, 00283-651. Telefone", [("address", "rua da Lua Branca, nº 1936, 00283-651")]), ("para Praça Beira-Rio Seco 141 - Parque Quirilo, aos cuidados", [("address", "Praça Beira-Rio Seco 141 - Parque Quirilo")]),
    ("em Av. Ipê-Manso n. 398 - apto 117, Jardim das Cancelas e deixou", [("address", "Av. Ipê-Manso n. 398 - apto 117, Jardim das Cancelas")]), ("R. do Sereno, 9, bl. B ap. 88 - CEP 00509-988. Nome", [("address", "R. do Sereno, 9, bl. B ap. 88 - CEP 00509-988")]),
    ("Paciente Nádia R. Verdu, 88 anos", []), ("Alameda Jandira 12, Parque Quirilo. Encaminhado", [("address", "Alameda Jandira 12, Parque Quirilo")]), ("500mg via oral", []),
])
def test_typed(text, wanted):
    assert typed(text) == wanted


NOTES = [
    "Encaminhado pelo Dr. Davi Quinnerosa para seguimento. Teste de Verdelis positivo.", "Acompanhado por Ana da Lumireira, tel. 3238-1228.", "Esposa (ana lumireira) refere melhora. Hospital Dona Quirila, setor Ala Jandira.",
    "Nome da mãe: Quinnerosa, Davi. Fim.", "Ontem Davi Quinnerosa voltou. Segundo Ana M. Lumireira, usa X.", "Paciente Febre Alta sem nome. febre alta febre alta febre alta febre alta febre alta",
]


def test_people_by_disclosure(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*NOTES, None, "", " "])], "note_id bigint, text string, kind string")
    found = sorted((r["note_id"], r["kind"], NOTES[r["note_id"]][r["start_pos"] : r["end_pos"]]) for r in P.personal_spans(df).collect())
    assert found == [
        (0, "person", "Davi Quinnerosa"), (1, "person", "Ana da Lumireira"), (1, "phone", "3238-1228"), (2, "person", "ana lumireira"), (3, "person", "Quinnerosa, Davi"),
        (4, "person", "Ana M. Lumireira"), (4, "person", "Davi Quinnerosa")]
    out = {r["note_id"]: r for r in P.sanitised(df, P.personal_spans(df)).collect()}
    assert out[1]["text"] == "Acompanhado por [PESSOA], tel. [TELEFONE]." and out[1]["n_spans"] == 2
    assert out[5]["text"] == NOTES[5] and out[6]["text"] is None and out[7]["text"] == "" and len(out) == 9


def test_a_single_revealing_name_is_removed(spark):
    texts = ["Nome da mãe: Ana Lumireira.", "Falar com Lumireira hoje.", "Ontem Lumireira voltou.", "Ontem Febre voltou."] + ["Paciente Febre refere. febre febre febre febre"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "note_id bigint, text string")
    found = {(r["note_id"], texts[r["note_id"]][r["start_pos"] : r["end_pos"]]) for r in P.personal_spans(df, alone=0.75).collect()}
    assert found == {(0, "Ana Lumireira"), (1, "Lumireira"), (2, "Lumireira")}
    assert (2, "Lumireira") not in {(r["note_id"], texts[r["note_id"]][r["start_pos"] : r["end_pos"]]) for r in P.personal_spans(df, alone=1.1).collect()}


def test_disclosure_of_every_class(spark):
    texts = ["Mora na rua Jandira, 12. Tel. 3238-1228", "Vive na rua Jandira, 40.", "Perto de Jandira ficou. Ver rua, rua e rua.", "CPF 467.799.859-00", "a@b.test.example", "Ontem Jandira fechou."]
    df = spark.createDataFrame(list(enumerate(texts)), "note_id bigint, text string")
    d = {(r["kind"], r["term"]): r for r in P.disclosures(P._scanned(df, "note_id", "text")).collect()}
    assert {k for k, _ in d} == {"address", "phone", "identity", "email"}
    assert d["phone", "32381228"]["disclosure"] == 1.0 == d["identity", "46779985900"]["disclosure"] == d["email", "a@btestexample"]["disclosure"] and d["address", "rua"]["disclosure"] < d["address", "jandira"]["disclosure"] < 1
    kinds = sorted(r["kind"] for r in P.personal_spans(df, threshold=0.99).collect())
    assert kinds == ["email", "identity", "phone"]
    out = {r["note_id"]: r["text"] for r in P.sanitised(df, P.personal_spans(df, threshold=0.4, alone=0.4, places=True)).collect()}
    assert out[2] == "Perto de [LOCAL] ficou. Ver rua, rua e rua."
    assert P.sanitised(df, P.personal_spans(df, threshold=0.4, alone=0.4, places=True)).where("note_id = 5").first()["text"] == "Ontem [LOCAL] fechou."
    assert out[0] == "Mora na [ENDERECO]. Tel. [TELEFONE]" and out[4] == "[EMAIL]"


def test_a_form_that_the_corpus_writes_elsewhere_is_no_entity(spark):
    texts = ["Contato 3238-1228"] + [f"Protocolo: 3238-1228 e guia 3238-1228, lote: 3238-1228 n{i}" for i in range(40)] + [f"tel. 9{i:04d}-{7000 + i}" for i in range(10, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "note_id bigint, text string")
    found = {r["note_id"] for r in P.personal_spans(df).collect()}
    assert 0 not in found and len(found) == 30


def test_empty_table(spark):
    df = spark.createDataFrame([], "note_id bigint, text string")
    assert P.personal_spans(df).count() == 0 and P.sanitised(df, P.personal_spans(df)).count() == 0


def test_long_text_is_scanned_whole():
    text = "palavra Comum " * 30_000 + "CPF 467.799.859-00"
    assert typed(text) == [("identity", "467.799.859-00")]


@pytest.mark.parametrize("name", ["Maria Aparecida de Souza da Silva dos Santos", "Ana " * 30 + "Lumireira"])
def test_long_names_are_one_run(name):
    text = f"Atendida pela Sra. {name}, sem queixas."
    found = [c for c in P.name_chains(text, []) if c[5]]
    assert text[found[0][3] : found[-1][4]] == name and len({c[0] for c in found}) == 1


def test_a_long_name_turned_round_is_one_run():
    text = "Nome da mãe: Silva dos Santos de Souza Lima Ferreira, Ana. Fim"
    found = [c for c in P.name_chains(text, []) if c[5]]
    assert text[found[0][3] : found[-1][4]] == "Silva dos Santos de Souza Lima Ferreira, Ana"
