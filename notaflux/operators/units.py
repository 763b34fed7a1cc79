"""Quantities recorded in different units, brought to one unit for each quantity.

The text of a record is read inside the JVM: which quantity it names, its one number and its unit. Units are vectors of
physical dimensions with a factor to the base unit, so two units convert if their dimensions agree, or if a physical
identity among the columns of the quantity bridges them: mass = amount of substance x molar mass, mass = density x volume.
Of all combinations of unit reading and identity that physics allows, the one with the least log residual against the
typical value of the quantity is chosen; where the next best is as near and differs, the record is flagged as ambiguous.
A number without a unit is solved in the same way, over all units of the quantity, and flagged as inferred.

``solve_columns`` does the same for quantities that stand in columns of their own: of all units that each column may be
in, it chooses the combination under which an identity among the columns (mass = density x volume) holds best.

Texts are read once each, however many records repeat them.

Defined results: null and empty texts, texts that name no quantity or several, hold no number or several, or state a
bound or range give no row; records delivered twice count once; an empty table gives no row.
"""

from __future__ import annotations

import math
import unicodedata
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notaflux.cluster import cut
from notaflux.functions.folding import fold_accents
from notaflux.functions.patterns import either
from notaflux.sources.tables import once

# Spellings (folded, lower case) of the base units and their prefixes.
MASS = {"kg": 1e3, "quilo": 1e3, "quilos": 1e3, "quilograma": 1e3, "quilogramas": 1e3, "g": 1.0, "grama": 1.0, "gramas": 1.0, "mg": 1e-3, "miligrama": 1e-3,
        "miligramas": 1e-3, "mcg": 1e-6, "ug": 1e-6, "micrograma": 1e-6, "microgramas": 1e-6, "ng": 1e-9, "pg": 1e-12}
VOLUME = {"l": 1.0, "litro": 1.0, "litros": 1.0, "dl": 1e-1, "ml": 1e-3, "mililitro": 1e-3, "mililitros": 1e-3, "cc": 1e-3, "cm3": 1e-3, "ul": 1e-6, "mm3": 1e-6}
AMOUNT = {"mol": 1.0, "mmol": 1e-3, "umol": 1e-6, "micromol": 1e-6, "nmol": 1e-9, "meq": 1e-3, "eq": 1.0}
LENGTH = {"m": 1.0, "metro": 1.0, "metros": 1.0, "cm": 1e-2, "centimetro": 1e-2, "centimetros": 1e-2, "mm": 1e-3, "milimetros": 1e-3}
PRESSURE = {"mmhg": 1.0, "mm hg": 1.0, "cmhg": 10.0, "cm hg": 10.0, "kpa": 7.500616827, "pa": 0.007500616827}
MOLARITY = {"m": 1.0, "mm": 1e-3, "um": 1e-6}
CELSIUS = ("c", "°c", "ºc", "oc", "℃", "graus c", "graus celsius", "grau c", "celsius")
FAHRENHEIT = ("f", "°f", "ºf", "graus f", "graus fahrenheit", "fahrenheit")
THOUSANDS = ("mil", "k", "x103", "x10^3", "10^3", "103")
#: Identities between dimensions: a product is the factor times a constant of the quantity, which a column gives in these
#: base units (g/mol, g/L). Per volume they hold as well.
IDENTITIES = (("mass", "amount", "molar_mass", 1.0), ("mass", "volume", "density", 1000.0))
# Wording of bounds and ranges, folded.
BOUNDS = r"[<>≤≥]|\b(?:ate|acima|abaixo|maior|menor|superior|inferior|entre|minimo|maximo|mais de|menos de|pelo menos|a partir)\b"
# Numbers that belong to a remark, folded.
REMARKS = r"\b\d+\s*x\b|\bas\s+\d{1,2}\s*[h:]\d{0,2}|\b\d{1,2}\s*h\b|\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b|\(repetido\)"
NUMBER = r"\d+(?:[.,]\d+|[    ]\d{3}(?!\d))*"


def unit_rows() -> list[tuple[str, str, float, float]]:
    """(spelling, dimension, factor, offset): value in base units = (value + offset) * factor, from the rules above."""
    rows: list[tuple[str, str, float, float]] = []
    for d, units in (("mass", MASS), ("volume", VOLUME), ("amount", AMOUNT), ("length", LENGTH), ("pressure", PRESSURE), ("amount/volume", MOLARITY)):
        rows += [(s, d, f, 0.0) for s, f in units.items()]
    volumes = ("l", "dl", "ml", "ul", "mm3")
    for top, kind in ((MASS, "mass"), (AMOUNT, "amount")):
        rows += [(f"{t}{by}{v}", f"{kind}/volume", f / VOLUME[v], 0.0) for t, f in top.items() if len(t) < 9 for v in volumes for by in ("/", " por ")]
    rows += [(f"{t}%", "mass/volume", f / VOLUME["dl"], 0.0) for t, f in MASS.items() if len(t) < 4]
    for v in ("mm3", "ul", "l", "ml"):
        for by in ("/", " por ", "por "):
            rows.append((f"{by}{v}".strip(), "count/volume", 1 / VOLUME[v], 0.0))
            rows += [(f"{k}{by}{v}", "count/volume", 1e3 / VOLUME[v], 0.0) for k in THOUSANDS]
            rows += [(f"{k}{by}{v}", "count/volume", 1e9 / VOLUME[v], 0.0) for k in ("x109", "x10^9", "10^9")]
    rows += [(s, "temperature", 1.0, 0.0) for s in CELSIUS] + [(s, "temperature", 5 / 9, -32.0) for s in FAHRENHEIT]
    return sorted(set(rows))


def folded(text: Column) -> Column:
    """Lower case, no accents, one sign for micro and for raised digits, no space around the bar of a unit."""
    plain = F.translate(fold_accents(F.lower(F.regexp_replace(text, "\\p{Cf}", ""))), "µμ²³", "uu23")
    return F.regexp_replace(F.regexp_replace(plain, r"\s*/\s*", "/"), r"x\s*10\s*\^?\s*(?=[39]\s*/)", "x10^")


def _folded(text: str) -> str:
    apart = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in apart if not unicodedata.combining(c))


def number(text: Column) -> Column:
    """The value of a written number: a mark or space before exactly three digits groups thousands, unless only a 0 stands
    before it; any other mark is the decimal one. Null where two decimal marks would be left."""
    small = text.rlike(r"^0[.,]\d{3}$")
    joined = F.regexp_replace(text, r"(?<=\d)[.,    ](?=\d{3}(?!\d))", "")
    return F.translate(F.when(small, text).otherwise(joined), ",", ".").try_cast("double")


def stated(texts: DataFrame, quantities: DataFrame, implied: str = "implied") -> DataFrame:
    """(text, implied, quantity_id, number, unit or null) of texts (text, implied); what states no quantity and one number
    gives no row.

    ``implied`` names the quantity of records that do not name theirs. The vocabulary of quantities is a table of fixed
    size (19 rows) and becomes part of the plan.
    """
    named = [(r["quantity_id"], r["quantity"], [_folded(a) for a in (r["aliases"] or []) if a]) for r in quantities.toLocalIterator()]
    alias_of = {a: q for q, _, aliases in named for a in aliases}
    implied_id = F.create_map(*[x for q, name, _ in named for x in (F.lit(name), F.lit(q))]) if named else F.lit(None).cast("map<string,bigint>")
    names = F.create_map(*[x for a, q in alias_of.items() for x in (F.lit(a), F.lit(q))]) if alias_of else F.lit(None).cast("map<string,bigint>")
    alias_re = rf"(?<![a-z0-9])(?:{either(alias_of or ['~'])})(?![a-z0-9])"
    unit_re = rf"(?<![a-z])(?:{either(u[0] for u in unit_rows())})(?![a-z0-9%/^])"

    text = texts.where(F.col("text").rlike("[0-9]")).select("text", implied, folded(F.col("text")).alias("t"))
    found = F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(f"({alias_re})"), F.lit(1)), lambda a: F.try_element_at(names, a)))
    read = text.where(~F.col("t").rlike(BOUNDS)).withColumn("q", found).withColumn("rest", F.regexp_replace("t", alias_re, " ; "))
    read = read.withColumn("quantity_id", F.when(F.size("q") == 1, F.get("q", F.lit(0))).when((F.size("q") == 0) & F.col(implied).isNotNull(), F.try_element_at(implied_id, F.col(implied))))
    read = read.where("quantity_id is not null")
    # a unit stands behind the number, or behind the sign or word that introduces it
    placed = rf"(?:(?<=\d)\s*|(?<=[(\[,])\s*|(?<=\bem)\s+|(?<=\d)\s+)({unit_re})"
    read = read.withColumn("units", F.array_distinct(F.regexp_extract_all("rest", F.lit(placed), F.lit(1))))
    bare = F.regexp_replace(F.regexp_replace(F.col("rest"), placed, " ; "), REMARKS, " ; ")
    read = read.withColumn("numbers", F.regexp_extract_all(bare, F.lit(rf"(?<![a-z\d^.,])({NUMBER})(?![a-z\d])"), F.lit(1)))
    one = read.where("size(numbers) = 1 and size(units) <= 1")
    return one.where(F.col(implied).isNull() | (F.size("units") == 1)).select("text", implied, "quantity_id", number(F.get("numbers", F.lit(0))).alias("number"), F.get("units", F.lit(0)).alias("unit")).where("number is not null")


def conversions(spark: SparkSession, quantities: DataFrame) -> DataFrame:
    """(quantity_id, unit, dimension, scale, shift, common, decimals): every unit of every quantity that physics allows.

    value in the common unit = (number + shift) * scale. Units convert within their dimension and by ``IDENTITIES``, of
    which each needs its constant in a column of ``quantities`` (``molar_mass`` in g/mol, ``density`` in g/mL; a column
    that is not there counts as null).
    """
    units = spark.createDataFrame(unit_rows(), "unit string, dimension string, factor double, shift double")
    goal = units.select(F.col("unit").alias("goal"), F.col("dimension").alias("goal_dimension"), F.col("factor").alias("goal_factor"), F.col("shift").alias("goal_shift"))
    constant = [(F.col(c) if c in quantities.columns else F.lit(None)).cast("double").alias(c) for *_, c, _ in IDENTITIES]
    wanted = quantities.select("quantity_id", "common_unit", "decimals", *constant, folded(F.col("common_unit")).alias("goal")).join(F.broadcast(goal), "goal")  # fixed tables
    bridge = F.when(F.col("dimension") == F.col("goal_dimension"), F.lit(1.0))
    for product, factor, column, base in IDENTITIES:
        for per in ("", "/volume"):
            if factor + per == "volume/volume":
                continue
            swap = lambda a, b, per=per: (F.col("dimension") == a + per) & (F.col("goal_dimension") == b + per)
            bridge = bridge.when(swap(factor, product), F.col(column) * base).when(swap(product, factor), 1 / (F.col(column) * base))
    return wanted.crossJoin(F.broadcast(units)).withColumn("bridge", bridge).where("bridge is not null").select(
        "quantity_id", "unit", "dimension", (F.col("factor") * F.col("bridge") / F.col("goal_factor")).alias("scale"), F.col("shift"), (-F.col("goal_shift")).alias("back"), "common_unit", "decimals")


def _log(c: Column) -> Column:
    return F.log10(F.greatest(F.abs(c), F.lit(1e-12)))


def nearest(ways: Column, tolerance: float) -> Column:
    """STRUCT<residual, value, unit, unique> of the way (residual, value, unit) of least residual; ``unique`` unless
    another within ``tolerance`` gives another value."""
    ordered = F.array_sort(ways)
    first = ordered[0]
    near = F.filter(ordered, lambda w: (w.residual <= first.residual + tolerance) & (F.abs(w.value - first.value) > 1e-9 * F.abs(w.value)))
    return F.struct(first.residual.alias("residual"), first.value.alias("value"), first.unit.alias("unit"), (F.size(near) == 0).alias("unique"))


def to_common_units(records: DataFrame, quantities: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """(source_table, record_id, quantity_id, number, unit, value, scaled_value, residual, solution) of each record.

    ``solution``: unique, inferred (no unit is stated, one fits best) or ambiguous (others are within ``tolerance`` of the
    least log residual with another value; the best is given).
    """
    records = cut(records.where(F.col("text").rlike("[0-9]")).select("source_table", "record_id", "text", "implied"))  # read twice
    known = cut(stated(records.groupBy("text", "implied").agg(F.count(F.lit(1)).alias("__n")).select("text", "implied"), quantities))
    counts = records.groupBy("text", "implied").agg(F.count(F.lit(1)).alias("times"))
    same_text = (F.col("a.text") == F.col("b.text")) & F.col("a.implied").eqNullSafe(F.col("b.implied"))
    amounts = known.alias("a").join(counts.alias("b"), same_text).groupBy("quantity_id", "number", "unit").agg(F.sum("times").alias("times"))
    solved = _solved(amounts, F.broadcast(conversions(records.sparkSession, quantities)), tolerance)  # units times quantities, both fixed
    by_text = known.join(solved.alias("s"), (known["quantity_id"] == F.col("s.quantity_id")) & (known["number"] == F.col("s.number")) & known["unit"].eqNullSafe(F.col("s.unit"))).select(known["text"], known["implied"], "s.*")
    return records.alias("a").join(by_text.alias("b"), same_text).select(
        "source_table", "record_id", *[F.col(f"b.{c}") for c in ("quantity_id", "number", "unit", "value", "scaled_value", "residual", "solution")])


def _solved(amounts: DataFrame, table: DataFrame, tolerance: float) -> DataFrame:
    """Each distinct (quantity_id, number, unit), with how many records state it, in the common unit."""
    amounts = cut(amounts)  # read by three branches
    value = (F.col("number") + F.col("shift")) * F.col("scale") + F.col("back")
    on = ["quantity_id", "number", "unit", "times"]
    spelled = amounts.where("unit is not null").join(table, ["quantity_id", "unit"]).select(*on, "decimals", value.alias("value"), F.col("unit").alias("as"), F.lit(True).alias("stated"))
    # typical value: readings with one solution only; a row per quantity
    plain = spelled.groupBy("quantity_id", "number", "unit").agg(F.min("value").alias("value"), F.max("value").alias("most"), F.first("times").alias("times")).where("value = most")
    typical = plain.groupBy("quantity_id").agg((F.sum(_log(F.col("value")) * F.col("times")) / F.sum("times")).alias("centre"))
    silent = amounts.where("unit is null").join(table.select(F.col("quantity_id"), F.col("unit").alias("as"), "scale", "shift", "back", "decimals").dropDuplicates(["quantity_id", "scale", "shift"]), "quantity_id").select(
        *on, "decimals", value.alias("value"), "as", F.lit(False).alias("stated"))
    readings = spelled.unionByName(silent).join(F.broadcast(typical), "quantity_id", "left")  # a row per quantity
    residual = F.round(F.abs(_log(F.col("value")) - F.coalesce("centre", _log(F.col("value")))), 9)
    best = readings.groupBy("quantity_id", "number", "unit", "decimals", "stated").agg(nearest(F.collect_set(F.struct(residual.alias("residual"), "value", F.col("as").alias("unit"))), tolerance).alias("b"))
    scaled = F.bround(F.round(F.col("b.value") * F.pow(F.lit(10.0), F.col("decimals")), 6), 0).cast("bigint")
    return best.select(
        "quantity_id", "number", "unit", F.col("b.value").alias("value"), scaled.alias("scaled_value"), F.col("b.residual").alias("residual"),
        F.when(~F.col("b.unique"), "ambiguous").when(F.col("stated"), "unique").otherwise("inferred").alias("solution"))


def solve_columns(df: DataFrame, identity: dict[str, int], units: dict[str, dict[str, float]], by: tuple[str, ...] = (), tolerance: float = 0.15) -> DataFrame:
    """``df`` with ``<column>_unit`` and ``<column>_base`` for each column of ``identity``, ``residual`` and ``solution``.

    ``identity``: the exponents with which the columns multiply to 1 in base units, as {"mass": 1, "density": -1,
    "volume": -1}; ``units``: the units that each column may be in, with their factors to the base unit. Of all
    combinations the one with the least log residual is taken: row by row, or, as a source keeps its units, once for each
    group of ``by`` (least mean residual; rows with a null group key form a group). ``solution`` is unique, ambiguous
    (another combination, with other values, is within ``tolerance``) or unsolved (a null or no positive number in one of
    the columns, or in all rows of the group).

    The residual of a combination is the row's own log residual plus a constant, so rows are never multiplied by
    combinations: groups meet them as columns of one aggregation, combined before the shuffle.
    """
    columns = list(identity)
    ways = [(names, [units[c][u] for c, u in zip(columns, names, strict=True)]) for names in product(*(units[c] for c in columns))]
    moves = [sum(identity[c] * math.log10(f) for c, f in zip(columns, factors, strict=True)) for _, factors in ways]
    usable = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in columns])
    own = F.when(usable, reduce(lambda a, b: a + b, [identity[c] * F.log10(F.col(c)) for c in columns]))
    residuals = [F.abs(own + m) for m in moves]
    if by:
        of_group = df.groupBy(*by).agg(F.array(*[F.avg(r) for r in residuals]).alias("__r"))
        met = df.alias("l").join(of_group.alias("r"), reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])).select("l.*", "__r")
    else:
        met = df.withColumn("__r", F.array(*residuals))
    least = F.array_min("__r")
    at = F.array_position("__r", least)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    # combinations of equal factors are one solution under several names
    alike = F.array(*[F.lit("|".join(f"{math.log10(f):.9f}" for f in factors)) for _, factors in ways])
    near = F.filter(F.arrays_zip(F.col("__r").alias("r"), alike.alias("w")), lambda x: (x.r <= least + tolerance) & (x.w != F.element_at(alike, at.cast("int"))))
    solved = least.isNotNull() & (usable if not by else F.lit(True))
    out = {}
    for i, c in enumerate(columns):
        out[f"{c}_unit"] = F.when(solved, pick([names[i] for names, _ in ways]))
        out[f"{c}_base"] = F.when(solved, F.col(c) * pick([factors[i] for _, factors in ways]))
    out["residual"] = F.when(solved, F.round(least, 9))
    out["solution"] = F.when(~solved, "unsolved").when(F.size(near) > 0, "ambiguous").otherwise("unique")
    return met.withColumns(out).drop("__r")


def records_of(entities: DataFrame, observations: DataFrame) -> DataFrame:
    """(source_table, record_id, text, implied) of entities and observations, each id once.

    The text of an observation is its code text and its value string, or one of them where both say the same.
    """
    lab = once(entities.where(F.col("entity_type").isin("VALOR_LABORATORIAL", "DOSAGEM") & F.col("text").isNotNull()), "entity_id", "extracted_at", "text", "entity_type")
    both = F.when(F.trim("code_text") == F.trim("value_string"), F.col("code_text")).otherwise(F.concat_ws(" : ", "code_text", "value_string"))
    seen = once(observations.where("code_text is not null or value_string is not null"), "observation_id", "received_at", "code_text", "value_string")
    return lab.select(F.lit("clinical_entities").alias("source_table"), F.col("entity_id").alias("record_id"), "text", F.when(F.col("entity_type") == "DOSAGEM", "dose").alias("implied")).unionByName(
        seen.select(F.lit("observations").alias("source_table"), F.col("observation_id").alias("record_id"), both.alias("text"), F.lit(None).cast("string").alias("implied")))
