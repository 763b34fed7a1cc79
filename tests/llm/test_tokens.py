"""Encoding, packing and splitting: exact round trips and bounds."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notaflux.llm import encoding as E
from notaflux.llm import packing as P
from notaflux.llm import sentences
from notaflux.llm import splitting as S

TEXTS = ["", None, "   ", "Olá, mundo! It's 3.14 <|endoftext|>\r\n\n  fim ", "a" * 3000, "x y " * 900, "漢字かな交じり文。" * 200, "1234567890" * 150, "\n" * 400, "ação " * 500 + "'s 'll", "é" * 700 + "🙂" * 300, "don't! " * 300]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids int")


@pytest.mark.parametrize("chunk", [64, 500, 32_768])
def test_chunks_stitch_exactly(spark, documents, chunk):
    got = {r["doc_id"]: r["ids"] for r in E.encode(documents, chunk_chars=chunk, overlap_chars=40).collect()}
    whole = E.encoder()
    assert got == {i: whole.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}


SCRIPTS = ["रोगी ठीक है दवा दी गई ", "пациент стабилен без жалоб ", "ผู้ป่วยดีไม่มีไข้", "患者の状態は安定している、発熱なし。", "المريض بحالة جيدة ", "환자는 안정적이다. ", "don't 3kg ", "é3º½ª…"]


@pytest.mark.parametrize("script", SCRIPTS)
def test_places_to_meet_in_every_script(script):
    text = script * 200
    parts = [E.owned(c, first, last, 300, 60) for c, first, last in E.chunks_of(text, 300, 60)]
    assert all(before and after for *_, before, after in parts)


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.lists(st.sampled_from([*"aB1'²é \n\tªα漢かกี،。!-", "'s", "हि", "  ", "x" * 9, "\u200b", "\x1c", "🙂"]), max_size=120).map("".join), st.integers(3, 20))
def test_chunks_of_any_text_meet(text, size):
    parts = []
    for no, (c, first, last) in enumerate(E.chunks_of(text, size, 3)):
        s, e, before, after = E.owned(c, first, last, size, 3)
        parts.append({"no": no, "after": after, "ids": E.encoder().encode_ordinary(c[s:e]) if before and after else None, "raw": c[s:e]})
    assert E.joined_ids(parts, E.TOKENIZER_DIR, E.DEFAULT_TOKENIZER).tolist() == E.encoder().encode_ordinary(text)


def test_same_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{E.TOKENIZER_DIR}/{E.DEFAULT_TOKENIZER}.json")
    t.encode_special_tokens = True
    for text in filter(None, TEXTS):
        assert t.encode(text, add_special_tokens=False).ids == E.encoder().encode_ordinary(text)


def test_decoding_gives_the_text_back(spark, documents):
    got = {r["doc_id"]: r["text"] for r in E.decode(E.encode(documents)).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


def test_decoding_of_nulls_and_half_characters(spark):
    half = E.encoder().encode_ordinary("🙂")[:1]
    df = spark.createDataFrame([(1, None), (2, []), (3, half), (4, E.encoder().encode_ordinary("fim"))], "doc_id bigint, ids array<int>").coalesce(1)
    assert {r["doc_id"]: r["text"] for r in E.decode(df).collect()} == {1: None, 2: "", 3: "\ufffd", 4: "fim"}


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert E.encode(none).count() == 0 and S.split_texts(none).count() == 0 and P.pack(P.token_counts(none)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    sizes = np.array(random.Random(seed).choices(range(1, 101), k=400))
    where, fills = P.best_fit(sizes, 100)
    assert max(fills) <= 100 and [int(sizes[where == b].sum()) for b in range(len(fills))] == fills
    assert sum(1 for f in fills if f <= 50) <= 1 and len(fills) <= 1.1 * sizes.sum() / 100 + 2


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_packing_is_whole_and_tight(spark, parts):
    rng = random.Random(parts)
    sizes = [rng.choice([0, 5, 37, 60, 99, 100, 101, 250, 1000]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "key bigint, tokens int").repartition(parts)
    rows = P.pack(df, capacity=100, fan_in=3).collect()
    total, fill = {}, {}
    for r in rows:
        total[r["key"]] = total.get(r["key"], 0) + r["size"]
        fill[r["bin"]] = fill.get(r["bin"], 0) + r["size"]
    assert total == dict(enumerate(sizes)) and all(r["fill"] == fill[r["bin"]] for r in rows) and max(fill.values()) <= 100
    assert all((r["pieces"] > 1) == (sizes[r["key"]] > 100) for r in rows)
    used = [v for b, v in fill.items() if b != "0"]
    assert sum(1 for v in used if v <= 50) <= 1  # no two small bins are left apart


def test_null_and_huge_keys(spark):
    big = 2**62 + 1
    df = spark.createDataFrame([(None, 10), (big, 20), (big, None), (7, 250)], "key bigint, tokens int")
    rows = P.pack(df, capacity=100).collect()
    assert sorted((str(r["key"]), r["piece"], r["size"]) for r in rows) == sorted([("None", 0, 10), (str(big), 0, 20), (str(big), 0, 0), ("7", 0, 100), ("7", 1, 100), ("7", 2, 50)])


def test_items_that_never_meet(spark):
    df = spark.createDataFrame([(i, 51) for i in range(200)], "key bigint, tokens int").repartition(8)
    assert len({r["bin"] for r in P.pack(df, capacity=100, fan_in=2).collect()}) == 200


def test_pieces(spark, documents):
    rng = random.Random(3)
    words = ["contrato", "sentença", "prova", "juros", "pedido", "recurso"]
    prose = " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(300))
    df = documents.unionByName(spark.createDataFrame([(99, prose, 0)], "doc_id bigint, text string, ids int"))
    limit, overlap = 100, 10
    rows = S.split_texts(df, limit=limit, overlap=overlap, block=20, with_piece=True).collect()
    texts = dict(enumerate(TEXTS)) | {99: prose}
    long = {i for i, t in texts.items() if t and len(E.encoder().encode_ordinary(t)) > limit}
    assert {r["doc_id"] for r in rows} == long
    for i in long:
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece_no"])
        assert "".join(texts[i][r["own_pos"] : r["end_pos"]] for r in own) == texts[i]
        for r in own:
            assert r["pieces"] == len(own) and r["n_tokens"] <= limit and r["n_overlap"] <= overlap and r["piece"] == texts[i][r["start_pos"] : r["end_pos"]]
            assert len(E.encoder().encode_ordinary(r["piece"])) <= limit
    natural = [r for r in rows if r["doc_id"] == 99 and r["piece_no"]]
    assert natural and all(r["cut_at"] == "natural" and prose[r["own_pos"] - 1] == "." for r in natural)


def test_deepest_valley():
    # two topics; the cut must fall between them although other natural boundaries are nearer to the limit
    ids = np.array([1, 2, 3] * 20 + [4, 5, 6] * 20)
    direction = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (7, 16))
    at = np.array([30, 45, 60, 75, 90])
    similarity = S.valleys(ids, at, np.zeros(5, int), np.full(5, 120), direction, 24)
    depth = S.depths(similarity, np.array([0]))
    assert at[int(np.argmin(similarity))] == 60 == at[int(np.argmax(depth))]
    pieces = S.cuts_of(120, at, similarity, depth, at, np.ones(121, bool), 100, 0, 0.3)
    assert [p[1] for p in pieces] == [0, 60]


def test_valleys_are_exact_on_documents():
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist() if t and len(t) > 4000]
    wordy = S._traits(E.TOKENIZER_DIR, E.DEFAULT_TOKENIZER)[-1]
    parts = E.encode_arrays([*texts, "", "1 2 3 " * 400, "ação " * 300], E.TOKENIZER_DIR, E.DEFAULT_TOKENIZER)
    ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
    at = np.array([p for p in range(7, len(ids), 13) if p not in ends])
    doc = np.searchsorted(ends, at, "right")
    first, last = (ends - [len(x) for x in parts])[doc], ends[doc]
    wanted = []
    for p, a, b in zip(at, first, last, strict=True):
        left, right = (Counter(int(x) for x in ids[s:e] if np.any(wordy[x])) for s, e in ((max(a, p - 96), p), (p, min(b, p + 96))))
        scale = (sum(c * c for c in left.values()) * sum(c * c for c in right.values())) ** 0.5
        wanted.append(sum(c * right[t] for t, c in left.items()) / scale if scale else 0.0)
    assert len(texts) > 5 and np.allclose(S.valleys(ids, at, first, last, wordy, 96), wanted, atol=1e-6)


def climb(s, i, step):
    while 0 <= i + step < len(s) and s[i + step] >= s[i]:
        i += step
    return s[i]


def test_depth_is_the_climb_to_both_peaks():
    rng = random.Random(8)
    lists = [[rng.choice([0.0, 0.1, 0.25, 0.5, 0.75]) for _ in range(rng.randrange(0, 30))] for _ in range(40)]
    first = np.cumsum([0] + [len(x) for x in lists])[:-1]
    got = S.depths(np.array([v for x in lists for v in x]), first)
    assert got.tolist() == [climb(x, i, -1) + climb(x, i, 1) - 2 * x[i] for x in lists for i in range(len(x))]
    assert S.depths(np.zeros(0), np.zeros(1, int)).size == 0


def test_the_cut_is_the_deepest_valley_of_its_window(spark):
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t and len(t) > 6000][:60]
    seen = []
    real = S.cuts_of

    def watched(n, natural, similarity, depth, gaps, whole, limit, overlap, slack, ends):
        found = real(n, natural, similarity, depth, gaps, whole, limit, overlap, slack, ends)
        for (begin, own, _), (_, to, kind) in zip(found, found[1:], strict=False):
            far = begin + limit
            window = [k for k in range(len(natural)) if own + int((far - own) * slack) <= natural[k] <= far and ends(int(natural[k]))]
            if kind == "natural" and window and to >= own + int((far - own) * slack):
                deep = {int(natural[k]): climb(similarity, k, -1) + climb(similarity, k, 1) - 2 * similarity[k] for k in window}
                seen.append(deep[to] == max(deep.values()))
        return found

    S.cuts_of = watched
    try:
        work = S.cutter(1024, 64, 96, 0.5, False, E.TOKENIZER_DIR, E.DEFAULT_TOKENIZER)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(["pt"] * len(texts))], names=["key", "t", "l"])
        list(work(iter([batch])))
    finally:
        S.cuts_of = real
    assert len(seen) > 60 and all(seen)


def test_natural_cuts_are_ends_of_sentences_or_lines(spark):
    body = ["Vistos os autos, fls. 265 e 266, Processo n. 9393408, Rel. Des. Mirtumundes; juros: at p. 428 sim.", "O recurso foi provido (art. 5 e art. 6)!", "内容を確認した。次の段落です。"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(body) + rng.choice([" ", " ", "\n", "\n\n"]) for _ in range(150)) for _ in range(6)]
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text", "lang"]).to_pylist()
    rows = [(i, t, "pt") for i, t in enumerate(texts)] + [(100 + i, d["text"], d["lang"]) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    of = {i: (t, g) for i, t, g in rows}
    ends = {}
    got = S.split_texts(df, limit=128, overlap=8, block=24, lang="lang").where("cut_at = 'natural'").collect()
    for r in got:
        text, lang = of[r["doc_id"]]
        if r["doc_id"] not in ends:  # over the whole text, not by paragraph
            also = S._COURT.get(lang, S._COURT_ALL)
            ends[r["doc_id"]] = set(sentences._cuts(text, sentences._regions(text), 0, len(text), lambda _, lang=lang: lang, also=also))
        before = text[: r["own_pos"]]
        assert r["own_pos"] in ends[r["doc_id"]] or "\n" in before[len(before.rstrip()) :], text[r["own_pos"] - 30 : r["own_pos"] + 10]
        assert not before.endswith(("fls.", " n.", "Des.", " p.", "art.", ";", ":"))
    assert len(got) > 100
