"""Quantities in common units against values worked out by hand."""

from __future__ import annotations

import math

import pytest

from notaflux.operators import units

QUANTITIES = [
    (1, "glicose", ["glicemia", "glicemia de jejum", "GLIC"], "mg/dL", 0, 180.16), (2, "creatinina", ["creatinina", "Cr", "creatinina sérica"], "mg/dL", 1, 113.12),
    (5, "plaquetas", ["plaquetas", "PLT"], "mil/mm3", 0, None), (7, "potássio", ["potássio", "K+"], "mmol/L", 1, 39.1), (10, "lactato", ["lactato"], "mmol/L", 1, 90.08),
    (14, "temperatura", ["Tax"], "°C", 1, None), (16, "altura", ["altura", "ALT"], "cm", 0, None), (17, "diurese", ["débito urinário 24h"], "mL", 0, None),
    (18, "pressão sistólica", ["PAS"], "mmHg", 0, None), (19, "dose", None, "mg", 3, None),
]


@pytest.fixture(scope="module")
def quantities(spark):
    return spark.createDataFrame(QUANTITIES, "quantity_id bigint, quantity string, aliases array<string>, common_unit string, decimals int, molar_mass double")


def solved(spark, quantities, rows):
    records = spark.createDataFrame([("t", i, text, implied) for i, (text, implied) in enumerate(rows)], "source_table string, record_id bigint, text string, implied string")
    return {r["record_id"]: r for r in units.to_common_units(records, quantities).collect()}


@pytest.mark.parametrize(("text", "quantity", "scaled"), [
    ("Glicemia de jejum: 4,50 mmol/l", 1, 81), ("GLIC = 1,88 g/L", 1, 188), ("glicemia : valor 58mg%, colhido às 6h", 1, 58), ("creatinina sérica (µmol/L) : 159", 2, 18), ("Cr 53mg/L - confirmado 2x", 2, 53),
    ("PLT 245.000/mm3", 5, 245), ("Plaquetas: 193 x10^9/L", 5, 193), ("plaquetas 5 300 por mm3", 5, 5), ("plaquetas, x10³/uL : 37", 5, 37), ("K+: 13,7 mg/dL", 7, 35), ("K+ 3,1mEq/L", 7, 31),
    ("lactato 1,5 mM", 10, 15), ("Tax = 97.7 °F", 14, 365), ("Tax: 38,8 graus Celsius", 14, 388), ("ALT 1.560 mm", 16, 156), ("altura:1.51 metros", 16, 151), ("Débito urinário 24h: 2.790mL", 17, 2790),
    ("débito urinário 24h:1,10L", 17, 1100), ("PAS (cmHg): 8.1", 18, 81), ("PAS cerca de 16,13 kPa", 18, 121), ("potássio em meq/l : 3,7", 7, 37), ("Ḱ+ 1 mg", None, None),
])
def test_stated_values(spark, quantities, text, quantity, scaled):
    got = solved(spark, quantities, [(text, None)])
    if quantity is None:
        assert got == {}
    else:
        assert (got[0]["quantity_id"], got[0]["scaled_value"], got[0]["solution"]) == (quantity, scaled, "unique")


@pytest.mark.parametrize("text", ["< 8,4 mg/dL de glicemia", "Cr: acima de 1,4mg/dL", "Cr: entre 3 e 7 mg/dL", "glicemia até 56 MG/DL", "92 mg/dL", "Zeliotina 3 mg/dL", "ALT 40 U/L", "creatinina pendente", "", "creatinina 1,2,3 mg/dL"])
def test_no_case(spark, quantities, text):
    assert all(r["solution"] != "unique" for r in solved(spark, quantities, [(text, None)]).values())


def test_doses_and_thousands(spark, quantities):
    got = solved(spark, quantities, [("12.500mcg", "dose"), ("0.025 mg", "dose"), ("1.000 MG", "dose"), ("0,5 grama", "dose"), ("2x/dia", "dose"), ("100 UI", "dose"), (None, "dose")])
    assert {i: r["scaled_value"] for i, r in got.items() if r["solution"] == "unique"} == {0: 12500, 1: 25, 2: 1_000_000, 3: 500_000}


def test_silent_units_are_inferred_or_flagged(spark, quantities):
    rows = [(f"glicemia {v} mg/dL", None) for v in (90, 100, 110, 120)] + [("glicemia 105", None)]
    got = solved(spark, quantities, rows)
    assert got[4]["solution"] in ("inferred", "ambiguous") and got[4]["value"] == pytest.approx(105)


def test_empty_tables_and_extra_columns(spark, quantities):
    entities = spark.createDataFrame([(1, "10 mg", "DOSAGEM", None, "z"), (1, "10 mg", "DOSAGEM", None, "z"), (2, None, "DOSAGEM", None, "z")], "entity_id bigint, text string, entity_type string, extracted_at timestamp, value string")
    observations = spark.createDataFrame([], "observation_id bigint, code_text string, value_string string, received_at timestamp, unit string")
    records = units.records_of(entities, observations)
    assert [(r["record_id"], r["scaled_value"]) for r in units.to_common_units(records, quantities).collect()] == [(1, 10_000)]
    assert units.to_common_units(records.limit(0), quantities).count() == 0


def test_density_bridges_volume_and_mass(spark):
    table = spark.createDataFrame([(1, "xarope", ["xarope"], "mg", 0, None, 1.25), (2, "soro", ["soro"], "mL", 1, None, None)], "quantity_id bigint, quantity string, aliases array<string>, common_unit string, decimals int, molar_mass double, density double")
    got = solved(spark, table, [("xarope 2 mL", None), ("xarope 500 mg", None), ("soro 10 mg", None), ("soro 0,5 l", None)])
    assert {i: r["scaled_value"] for i, r in got.items()} == {0: 2500, 1: 500, 3: 5000}


UNITS = {"mass": {"g": 1.0, "kg": 1000.0}, "density": {"g/mL": 1000.0, "g/L": 1.0}, "volume": {"L": 1.0, "mL": 0.001}}
MASS_IS = {"mass": 1, "density": -1, "volume": -1}


def test_columns_are_solved_by_their_identity(spark):
    rows = [
        ("a", 1250.0, 1.25, 1.0),  # g, g/mL, L
        ("b", 2.5, 1250.0, 2.0),  # kg, g/L, L
        ("b", 5.1, 1250.0, 4.0), ("b", None, 1.0, 1.0),
        ("c", 0.5, 1.0, 500.0),  # kg, g/mL, mL
        (None, 10.0, 1.0, 10.0), (None, -1.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "source string, mass double, density double, volume double")
    per_row = {(r["source"], r["mass"]): r for r in units.solve_columns(df, MASS_IS, UNITS, tolerance=0.01).collect()}
    assert len(per_row) == 7
    for (source, mass), r in per_row.items():
        usable = mass is not None and mass > 0
        assert (r["solution"] != "unsolved") == usable
        if usable:
            ways = [(abs(math.log10(mass * m / (r["density"] * d * r["volume"] * v))), um, ud, uv) for um, m in UNITS["mass"].items() for ud, d in UNITS["density"].items() for uv, v in UNITS["volume"].items()]
            assert r["residual"] == pytest.approx(min(ways)[0], abs=1e-6) and any(w[1:] == (r["mass_unit"], r["density_unit"], r["volume_unit"]) and w[0] == pytest.approx(min(ways)[0], abs=1e-9) for w in ways)
            assert (r["solution"] == "ambiguous") == (sum(w[0] <= min(ways)[0] + 0.01 for w in ways) > 1)


def test_a_source_keeps_its_units(spark):
    units_of = {"mass": {"g": 1.0, "kg": 1000.0}, "density": {"g/L": 1.0}, "volume": {"L": 1.0, "mL": 0.001}}
    rows = [(s, i, 800.0 * v * (1 if s == "x" else 0.001), 800.0, float(v)) for s in "xy" for i, v in enumerate((1, 2, 5, 7))] + [("x", 9, 8.0e5, 800.0, 1.0), ("z", 0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "source string, i int, mass double, density double, volume double")
    got = units.solve_columns(df, MASS_IS, units_of, by=("source",)).collect()
    assert {(r["source"], r["solution"]) for r in got} == {("x", "unique"), ("y", "ambiguous"), ("z", "unsolved")}
    assert {(r["source"], r["mass_unit"], r["volume_unit"]) for r in got if r["source"] == "x"} == {("x", "g", "L")}
    assert len(got) == len(rows) and units.solve_columns(df.limit(0), MASS_IS, units_of, by=("source",)).count() == 0
