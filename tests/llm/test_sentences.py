"""Sentence boundaries by language and script, and the cover of the text."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notaflux.llm import sentences as S


def cut(text, lang=None, stems=frozenset()):
    return [text[a:b] for a, b in S.sentence_spans(text, lang, stems)]


@pytest.mark.parametrize(("text", "wanted"), [
    ("O Dr. Silva veio. Saiu às 3h.", 2), ("Diurese aprox. 2100 mL nas últimas 12 h., sem balanço. Evolui bem.", 2), ("Relatório de A. B. Mirtu em 11.03.2024. Fim.", 2),
    ("Sem resposta... aguarda nota.", 1), ("Sem resposta... Aguarda nota.", 2), ("Houve hipotensão?! Em uso.", 2), ("Filha pergunta \"ele vai? quando?\" e sai. Fim.", 2),
    ("Curativo (limpo. seco) ok. Fim", 2), ("“Dói muito!”, disse.", 1), ("linha um\nsegue aqui. Nova\nOutra", 3), ("Conduta:\n1. Rever\n2) Manter\n• Avisar", 4), ("íntegra.Suspenso já.", 2),
    ("sedado. conforme prot. inst. 3.2, ok.", 2), ("temp. de 38,5 °C. Fim.", 2), ("Aberto (sem fim. Outra frase.", 2), ("Um \"sem par. Outra frase.", 2), ("uso de X, etc. Pele boa.", 2), ("uso de X, etc. e pele.", 1),
    ("Dr. med. X wurde am 12. Tag extubiert. Kein Fieber seit dem 3. Dezember.", 2), ("Die Temp. lag, d. h. leicht, z. B. hier. Ja.", 2), ("Die Frau sagt: „Er isst. Nichts.“ und weint. Gut.", 2),
    ("Seen by J. R. Lee, M.D., at 6:53 a.m. and left. Ok.", 2), ("他说：“疼。睡不着！”离开。好。", 2), ("家族に説明した（同意あり。書面済み。）。次。", 2), ("रोगी ठीक है। दवा दी॥ डॉ. X आए।", 3), ("कहा, “सोए नहीं। दर्द है।” और गईं।", 1),
    ("قال: «لم ينم. كان يتألم.» ثم غادر. هل نام؟ زار د. علي.", 3), ("ผู้ป่วยดี ไม่มีไข้", 2), ("¿Duerme? Sí.", 2),
])
def test_counts(text, wanted):
    assert len(cut(text)) == wanted, cut(text)


@pytest.mark.parametrize(("text", "lang", "wanted"), [
    ("Sorologia para hepatite B. Paciente nega febre.", "pt", 2), ("Deficit de vitamina D. Paciente iniciou reposicao.", "pt", 2), ("Realizado exame abd. Normal.", "pt", 2), ("He was told no. Then left.", "en", 2),
    ("Lot no. 5 was given. Ok.", "en", 1 + 1), ("Gesehen d. h. heute. Ja.", "de", 2), ("Visto por A. B. Silva ontem. Fim.", "pt", 2), ("Avaliada pelo A. Lima. Fim.", None, 2),
    ("Dr. Lima u. Frau kamen. Gut.", "de", 2), ("Frase « uma. duas » e fim. Mais⸩ sim.", "pt", 2), ("Paciente estável e sem dor.\nSe tomaron, p. ej. dos frascos y el suero. Fim", "pt", 3), ("A" * 500 + "@x.Com veio. Fim.", "pt", 2),
])
def test_languages_apart(text, lang, wanted):
    assert len(cut(text, lang)) == wanted, cut(text, lang)


@pytest.mark.parametrize(("text", "lang", "wanted"), [
    ("Der Patient ist stabil und hat kein Fieber", "pt", "de"), ("Paciente estável e sem dor", "pt", "pt"), ("Paciente estável e sem dor", None, "pt"), ("The patient was seen and left", "xx", "en"), ("ผู้ป่วยดี", "pt", "th"),
    ("قال لم ينم", None, "ar"), ("", "pt", "pt"), ("123", None, None), ("Xyzzy", None, None), ("Xyzzy", "de", "de"), ("Seen by the team", "pt", "en"),
])
def test_language_of_the_text(text, lang, wanted):
    assert S.language_of(text, lang) == wanted


def test_far_words_count(spark):
    pad = " " * 200
    assert len(cut(f"seit dem{pad}3. Dezember stabil. Ja.", "de")) == 2 and len(cut(f"Visto por{pad}A. Silva. Fim.", "pt")) == 2


def test_stems_of_shortened_terms():
    stems = S.word_stems(["toracotomia exploradora", "pre-eclampsia leve", "grave"])
    assert cut("Feito por pre-e. leve em curso. Fim.", None, stems) == ["Feito por pre-e. leve em curso.", "Fim."]
    assert cut("Escore RASS -2. segue bem.", None, stems) == ["Escore RASS -2.", "segue bem."]
    assert cut("Feito torac. exploradora. fim aqui", None, stems) == ["Feito torac. exploradora.", "fim aqui"]


@pytest.mark.parametrize("text", [None, "", "  \n\t "])
def test_nothing_in_blank(text):
    assert S.sentence_spans(text) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB.!?\n \"“”()«»1,。ก अ।-…'", max_size=60))
def test_every_character_once(text):
    spans = S.sentence_spans(text)
    assert all(text[a:b] == text[a:b].strip() and a < b for a, b in spans)
    assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:], strict=False))
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())


def test_long_texts_in_linear_time():
    assert len(S.sentence_spans("palavra comum. Outra " * 20_000)) == 20_001
    assert len(S.sentence_spans("(" * 5_000 + "a. B" * 10)) >= 1


def test_operator(spark):
    df = spark.createDataFrame([(1, "Um. Dois.", "pt", "x"), (2, None, None, "y"), (3, " ", "pt", "z")], "note_id bigint, text string, lang string, start_pos string")
    rows = S.sentences(df, lang="lang").collect()
    assert [(r["note_id"], r["sentence_no"], r["start_pos"], r["end_pos"], r["sentence"]) for r in rows] == [(1, 0, 0, 3, "Um."), (1, 1, 4, 9, "Dois.")]
    assert S.sentences(df.limit(0)).count() == 0
