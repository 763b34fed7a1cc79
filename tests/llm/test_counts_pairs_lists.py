"""Term counts, pairs and list matching against brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from notaflux.llm import canonical_list as C
from notaflux.llm import pairs as P
from notaflux.llm import term_counts as T


def test_term_counts_with_a_hot_term(spark):
    rng = random.Random(5)
    data = [(i, rng.randrange(40), "A" if i % 3 else None, " Hot " if i % 3 == 1 else rng.choice(["x", "Y", None, ""])) for i in range(900)]
    rows = spark.createDataFrame(data + data[:200], "entity_id bigint, note_id bigint, entity_type string, text string")
    got = {(r["entity_type"], r["term"]): (r["occurrences"], r["records"]) for r in T.term_counts(rows, "entity_type", "text", "note_id", "entity_id").collect()}
    n, notes = Counter(), defaultdict(set)
    for _, note, kind, text in data:
        if kind is not None and text is not None:
            n[kind, text.strip().lower()] += 1
            notes[kind, text.strip().lower()].add(note)
    assert got == {k: (n[k], len(notes[k])) for k in n}
    marks = {r["term"]: r["mark"] for r in T.marked(T.term_counts(rows, "entity_type", "text", "note_id", "entity_id"), rows, "note_id").collect()}
    assert marks["hot"] == "common"
    assert T.term_counts(rows.limit(0), "entity_type", "text", "note_id", "entity_id").count() == 0


def test_pair_counts_against_brute_force(spark):
    rng = random.Random(7)
    entities = [(i, i // 6, rng.choice(["A ", "a", "b", "c", "d", None])) for i in range(600)]
    relations = [(i, i // 6, 6 * (i // 6) + rng.randrange(6), 6 * (i // 6) + rng.randrange(6), rng.choice(["R", "S", None])) for i in range(600)]
    e = spark.createDataFrame(entities + entities[:50], "entity_id bigint, x bigint, text string")
    r = spark.createDataFrame(relations + relations[:50], "relation_id bigint, note_id bigint, source_entity_id bigint, target_entity_id bigint, relation_type string")
    baskets = defaultdict(set)
    for _, note, s, t, kind in relations:
        if kind:
            baskets[kind, note] |= {entities[x][2].strip().lower() for x in (s, t) if entities[x][2] is not None}
    both, single, total = Counter(), Counter(), Counter()
    for (kind, _), items in baskets.items():
        total[kind] += bool(items)
        single.update((kind, i) for i in items)
        both.update((kind, a, b) for a, b in itertools.combinations(sorted(items), 2))
    got = {(x["kind"], x["a"], x["b"]): (x["n_ab"], x["n_a"], x["n_b"], x["n"]) for x in P.pair_counts(P.baskets(r, e)).collect()}
    assert got == {k: (v, single[k[0], k[1]], single[k[0], k[2]], total[k[0]]) for k, v in both.items()}
    few = {(x["kind"], x["a"], x["b"]) for x in P.pair_counts(P.baskets(r, e), 5, 1.0).collect()}
    assert few == {k for k, v in both.items() if v >= 5 and v * total[k[0]] >= single[k[0], k[1]] * single[k[0], k[2]]}
    judged = P.surprise(P.baskets(r, e)).collect()
    assert len(judged) == len(both) and all(0 <= x["q_bound"] <= 1 and x["log10_p"] <= 0 and x["expected"] > 0 for x in judged)
    assert P.surprise(P.baskets(r.limit(0), e)).count() == 0


def test_null_keeps_frequencies_and_sizes():
    degree, items, size, n = np.array([1.0, 3.0, 10.0]), np.array([10.0, 5.0, 1.0]), np.array([2.0, 3.0]), np.array([10.0, 5.0])
    x, y, error = P.fit_null(degree, items, size, n)
    assert error < 1e-8 and P.fit_null(degree, items, size, n, rounds=1)[2] > 1e-3
    assert np.allclose(P.fit_null(degree, items, size, n, cells=2)[0], x)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert (p * n).sum(1) == pytest.approx(degree, rel=1e-6) and (p * items[:, None]).sum(0) == pytest.approx(size, rel=1e-6)


def test_mills_ratio():
    w = np.array([1e-6, 0.1, 0.7, 1.9, 2.1, 2.99, 3.01, 5.9, 6.1, 20.0, 37.0])
    wanted = [math.exp(v * v / 2) * math.sqrt(math.pi / 2) * math.erfc(v / math.sqrt(2)) for v in w]
    assert P._mills(w) == pytest.approx(wanted, rel=1e-8)


@pytest.mark.parametrize("block", [1, 2, 5, 512])
def test_a_large_basket_in_blocks(spark, block):
    rows = [("R", b, f"t{i}") for b in range(3) for i in range(12 + b)] + [("S", 0, "x"), ("S", 0, "y"), ("R", 9, "t1")]
    df = spark.createDataFrame(rows, "kind string, basket bigint, item string")
    wanted = Counter((k, *p) for k, b in {r[:2] for r in rows} for p in itertools.combinations(sorted({r[2] for r in rows if r[:2] == (k, b)}), 2))
    got = P.pair_counts(df, block=block).collect()
    assert {(r["kind"], r["a"], r["b"]): r["n_ab"] for r in got} == wanted and len(got) == len(wanted)


def test_surprise_needs_no_arrays_on_pairs(spark, monkeypatch):
    rng = random.Random(1)
    rows = list({(rng.choice("RS"), b, f"t{min(rng.randrange(30), rng.randrange(30))}") for b in range(150) for _ in range(rng.randrange(1, 7))})
    df = spark.createDataFrame(rows, "kind string, basket bigint, item string")
    one = {(r["kind"], r["a"], r["b"]): (r["log10_p"], r["q_bound"]) for r in P.surprise(df).collect()}
    monkeypatch.setattr(P, "_GROUP", 7)
    many = {(r["kind"], r["a"], r["b"]): (r["log10_p"], r["q_bound"]) for r in P.surprise(df).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in one)


def test_tail_against_convolution():
    rng = np.random.default_rng(0)
    chance, times, seen = rng.uniform(0.001, 0.2, (8, 3)), np.array([5.0, 9.0, 20.0]), np.array([9, 6, 9, 12, 11, 15, 8, 20])
    _, log_p = P.log_tail(seen, chance, times)
    for i in range(8):
        pmf = np.array([1.0])
        for c, k in zip(chance[i], times, strict=True):
            for _ in range(int(k)):
                pmf = np.convolve(pmf, [1 - c, c])
        assert log_p[i] == pytest.approx(np.log(pmf[seen[i] :].sum()), rel=0.02, abs=0.05)


LIST = [(1, "otite media serosa", "C"), (2, "calculose biliar", "C"), (3, "rinite vasomotora", "C"), (4, "tevpanidazol", "M"), (5, "tevpaniglinida", "M"), (6, "toracotomia exploradora", "C"), (7, "galquadazol", "M"), (8, "galquacilina", "M")]


def test_list_matching(spark):
    entries = spark.createDataFrame(LIST, "term_id bigint, term string, entity_type string")
    cases = {
        ("C", "Otite Média serosa (sic)"): 1, ("C", "biliar, calculose"): 2, ("C", "rinitevasomohora"): 3, ("M", "tevpanijlinida"): 5, ("M", "TEVPANIDAZOL COMP"): 4, ("C", "torac. exploradora"): 6, ("M", "galquaiclina"): 8,
        ("C", "mal do viajante noturno"): None, ("M", "wolctoquark"): None, ("C", "idem"): None, ("C", ""): None, ("C", "???"): None, ("M", "calculose biliar"): None, ("C", "provável calculose  biliar?"): 2, ("X", "otite media serosa"): None,
    }
    values = spark.createDataFrame([(k, v, "x") for k, v in [*cases, *cases, (None, "a"), ("C", None)]], "entity_type string, text string, term string")
    got = {(r["entity_type"], r["text"]): r["term_id"] for r in C.match_list(values, entries).collect()}
    assert got == cases
    assert all(r["term_id"] is None for r in C.match_list(values, entries.limit(0)).collect())
    assert C.match_list(values.limit(0), entries).count() == 0


def test_margin_rejects(spark):
    names = ["tomografia de cranio", "tomografia de torax", "insuficiencia cardiaca", "insuficiencia renal", "hiperuricemia assintomatica", "hematuria assintomatica", "dipirona"]
    entries = spark.createDataFrame([(i, n, "P") for i, n in enumerate(names)], "term_id bigint, term string, entity_type string")
    cases = {"tomografia de cranio e torax": None, "insuficiencia cardiaca renal": None, "tomografia de cranios": 0, "insuf cardiaca": 2, "hiper. assintomatica": 4, "xyzwvu": None, "dipirna": 6, "insuficiencia": None}
    values = spark.createDataFrame([("P", v) for v in cases], "entity_type string, text string")
    assert {r["text"]: r["term_id"] for r in C.match_list(values, entries).collect()} == cases


def test_remarks_are_learnt(spark):
    names = ["alfaxol", "betamina", "gamatina", "deltazol", "zetaril", "tetracin", "omegan forte"]
    listed = spark.createDataFrame([("M", i, n) for i, n in enumerate(names)], "g string, id bigint, name string")
    values = spark.createDataFrame([("M", f"{n} xpto") for n in names] + [("M", "alfaxol novo"), ("M", "omegan"), ("M", "beta forte")], "g string, v string")
    assert [r["word"] for r in C.remarks(values, listed, 0.1, 5).collect()] == ["xpto"]
    df = values.select(values.g.alias("entity_type"), values.v.alias("text"))
    got = {r["text"]: r["term_id"] for r in C.match_list(df, listed.select(listed.g.alias("entity_type"), listed.id.alias("term_id"), listed.name.alias("term"))).collect()}
    assert all(got[f"{n} xpto"] == i for i, n in enumerate(names)) and got["omegan"] == 6


@pytest.mark.parametrize("threshold", [0.1, 0.25, 0.6])
def test_rare_grams_lose_no_entry(spark, threshold):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcde", k=rng.randrange(3, 8))) for _ in range(60)]
    listed = spark.createDataFrame([("A", i, w) for i, w in enumerate(sorted(set(words)))], "g string, id bigint, name string")
    values = spark.createDataFrame([("A", "".join(rng.choices("abcdex", k=rng.randrange(2, 9)))) for _ in range(80)], "g string, v string").distinct()
    index, unseen = C._index(listed)
    got = {(r["v"], r["id"]): r["score"] for r in C._scores(values, index, unseen, threshold).where(f"score >= {threshold}").collect()}
    weight = {r["gram"]: r["w2"] for r in index.collect()}
    cut = {r["name"]: (r["id"], set(r["grams"])) for r in listed.select("id", "name", C.grams(listed.name).alias("grams")).collect()}
    other = unseen.first()["unseen"]
    wanted = {}
    for r in values.select("v", C.grams(values.v).alias("grams")).collect():
        own = set(r["grams"])
        for i, theirs in cut.values():
            dot = sum(weight[x] for x in own & theirs)
            score = dot / (sum(weight.get(x, other) for x in own) * sum(weight[x] for x in theirs)) ** 0.5
            if score >= threshold + 1e-6:
                wanted[r["v"], i] = score
    assert wanted.keys() <= got.keys() and len(wanted) > 3 and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in wanted.items())


def test_equal_candidates_give_none(spark):
    entries = spark.createDataFrame([(1, "abcdefgx", "M"), (2, "abcdefgy", "M")], "term_id bigint, term string, entity_type string")
    values = spark.createDataFrame([("M", "abcdefgz")], "entity_type string, text string")
    assert C.match_list(values, entries).first()["term_id"] is None


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_runs_meet_over_batches_and_ranges(spark, batch):
    rng = random.Random(batch)
    rows = [(rng.choice("AB"), rng.choice(["hot", " HOT ", "cold", "", None]), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(60)])) for _ in range(900)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        df = spark.createDataFrame(rows, "g string, t string, r bigint, i bigint").repartition(5)
        got = {(r["g"], r["term"]): (r["occurrences"], r["records"]) for r in T.term_counts(df, "g", "t", "r", "i").collect()}
    finally:
        spark.conf.set(key, old)
    once = {(g, t.strip().lower(), r, i) for g, t, r, i in rows if t is not None}
    keys = {x[:2] for x in once}
    assert got == {k: (sum(x[:2] == k for x in once), len({x[2] for x in once if x[:2] == k and x[2] is not None})) for k in keys}
