"""Texts that look the same come to one form; texts that look different do not."""

from __future__ import annotations

import pytest

from notaflux.llm import lookalikes as L


@pytest.mark.parametrize(("a", "b"), [
    ("di‎minuído", "diminuído"), ("７ ｄｉａｓ", "7 dias"), ("caõ", "caõ"), ("a b", "a b"), ("ﬁm", "fim"), ("pre‑op", "pre-op"), ("so­lo", "solo"), ("5 µg", "5 μg"), ("a\r\nb", "a\nb"), (" x﻿", "x"),
])
def test_plain_form_joins(a, b):
    assert L.plain_form(a) == L.plain_form(b)


@pytest.mark.parametrize(("a", "b"), [("cm²", "cm2"), ("nº", "no"), ("é", "e"), ("A", "a"), ("1,5", "1.5"), ("a  b", "a b"), ("β", "ß"), ("–", "-"), ("à", "á")])
def test_plain_form_keeps_apart(a, b):
    assert L.plain_form(a) != L.plain_form(b)


def test_null_and_blank():
    assert L.plain_form(None) is None and L.plain_form(" ​ ") == "" and L.suspects(None) == []


def rows(spark, *texts):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "note_id bigint, text string, plain string")


def test_repair_needs_the_vocabulary(spark):
    # 0 and 1 look the same; 2 holds a word that nobody writes plainly; 3 and 4 agree on a word that only a further text holds
    df = rows(spark, "Paciente estável", "Pаciente estável", "qаzwx só", "zоrkul fim", "zorkуl fim".replace("у", "u").replace("o", "ο"), None, "", "β-lactâmico", "β-lactâmico")
    further = spark.createDataFrame([("um zorkul a mais",), (None,)], "text string")
    got = {r["note_id"]: r for r in L.canonical(df, corpus=further).collect()}
    assert {r["note_id"]: r["canonical"] for r in L.canonical(df).collect()}[3] == L.plain_form(df.where("note_id = 3").first()["text"])
    assert got[1]["canonical"] == "Paciente estável" and got[1]["repairs"] == 1
    assert got[2]["canonical"] == "qаzwx só" and got[2]["repairs"] == 0
    assert got[3]["canonical"] == got[4]["canonical"] == "zorkul fim"
    assert got[5]["canonical"] is None and got[6]["canonical"] == "" and got[7]["canonical"] == "β-lactâmico"
    pairs = sorted((r["note_id_a"], r["note_id_b"]) for r in L.look_same(L.canonical(df, corpus=further)).collect())
    assert pairs == [(0, 1), (3, 4)]  # equal texts are no pair


def test_pairs_against_brute_force(spark):
    base = ["alpha beta", "gama delta", "alpha  beta"]
    texts = [t for b in base for t in (b, b.replace("a", "а"), b.replace(" ", " "), b)]
    df = rows(spark, *texts)
    form = {r["note_id"]: r["canonical"] for r in L.canonical(df).collect()}
    wanted = {(i, j) for i in form for j in form if i < j and form[i] == form[j] and texts[i] != texts[j]}
    forms = L.canonical(df)
    for block in (1, 2, 512):
        found = L.look_same(forms, block=block).collect()
        assert {(r["note_id_a"], r["note_id_b"]) for r in found} == wanted and len(wanted) == len(found) == 15
    links = {r["note_id"]: r["links"] for r in L.classes(forms).collect()}
    assert links == {i: sum(i in p for p in wanted) for i in {x for p in wanted for x in p}}
    assert all(r["class_id"] <= r["variant"] <= r["note_id"] and r["variants"] <= r["notes"] for r in L.classes(forms).collect())


def test_empty_table(spark):
    assert L.look_same(L.canonical(rows(spark, "x").limit(0))).count() == 0


@pytest.mark.parametrize(("token", "within", "wanted"), [
    ("estаvel", "Latin", ["estavel"]),  # one Cyrillic letter in a Latin word
    ("cахар", None, ["сахар"]),  # one Latin letter in a Cyrillic word; its h-like letter has no Latin twin here
    ("пaциент", None, ["пациент"]), ("сор", None, []), ("сор", "Latin", ["cop"]), ("сор", "Cyrillic", []), ("abc", "Cyrillic", []), ("漢a", "Latin", []), ("αβ", None, []),
])
def test_readings_by_dominant_script(token, within, wanted):
    assert L.readings(token, within)[:1] == wanted[:1]


def test_dominance_is_of_the_token_not_of_the_note(spark):
    russian = "пациент принимает сахар и сор, жалоб нет"
    df = rows(spark, "A cop viu o paciente", "A сор viu o paciente", russian, russian.replace("сахар", "cахар"), "Em russo: сахар. E cахар.", "zona сор limpa")
    got = {r["note_id"]: r["canonical"] for r in L.canonical(df).collect()}
    assert got[3] == russian and got[4] == "Em russo: сахар. E сахар."
    assert got[1] == "A сор viu o paciente" and got[5] == "zona сор limpa"  # a word that a Russian text writes
    alone = {r["note_id"]: r["canonical"] for r in L.canonical(df.where("note_id < 2")).collect()}
    assert alone[1] == "A cop viu o paciente"


def test_private_characters_stay_and_nothing_invisible_is_added():
    assert L.plain_form("a\ue000b\ue001é") == "a\ue000b\ue001é"
    assert L.plain_form("क्\u200dष a\u200db\u200c") == "क्\u200dष ab"
