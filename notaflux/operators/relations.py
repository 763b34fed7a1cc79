"""Relations between entities of one text by type and distance, and the medication profiles they give.

A theta join of the entities of a text with themselves: pairs in the order of the text whose types are related and whose
gap is within the window. It runs on the entity array of the row, so nothing is shuffled and no text meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notaflux.conf import EngineConf
from notaflux.functions.spans import exploded, let, strip
from notaflux.operators.entities import ENTITY

# Which pairs of types, in the order of the text, are related how.
RELATED = (
    ("MEDICAMENTO", "DOSAGEM", "HAS_DOSAGE"),
    ("DOSAGEM", "MEDICAMENTO", "HAS_DOSAGE"),
    ("MEDICAMENTO", "CONDICAO", "TREATS"),
    ("CONDICAO", "MEDICAMENTO", "TREATS"),
    ("PROCEDIMENTO", "CONDICAO", "INDICATED_BY"),
    ("CONDICAO", "PROCEDIMENTO", "INDICATED_BY"),
    ("VALOR_LABORATORIAL", "CONDICAO", "HAS_RESULT"),
)
# Confidence falls with the gap to a floor; dosages get a bonus.
FLOOR, BONUS = 0.5, 0.15
RELATION = f"struct<source:{ENTITY},target:{ENTITY},relation_type:string,confidence:double,evidence:string>"


def relations(entities: Column, text: Column, conf: EngineConf | None = None) -> Column:
    """ARRAY<STRUCT<source, target, relation_type, confidence, evidence>> in the order of the pairs."""
    conf = conf or EngineConf()
    window, context = conf.relation_window, conf.evidence_context
    kinds = F.create_map(*[x for a, b, r in RELATED for x in (F.lit(f"{a}>{b}"), F.lit(r))])
    kind = lambda a, b: F.try_element_at(kinds, F.concat(a.entity_type, F.lit(">"), b.entity_type))

    def related(a: Column, b: Column) -> Column:
        gap = b.start - a.end
        near = F.greatest(F.lit(FLOOR), 1 - gap / window)
        score = F.round(F.when(kind(a, b) == "HAS_DOSAGE", F.least(F.lit(1.0), near + BONUS)).otherwise(near), 3)
        begin, end = F.greatest(F.lit(0), a.start - context), F.least(F.length(text), b.end + context)
        turned = a.entity_type == "DOSAGEM"
        return F.struct(F.when(turned, b).otherwise(a).alias("source"), F.when(turned, a).otherwise(b).alias("target"), kind(a, b).alias("relation_type"),
                        score.alias("confidence"), strip(F.substring(text, begin + 1, end - begin)).alias("evidence"))

    def pairs(es: Column) -> Column:
        def fits(a: Column, b: Column) -> Column:
            return (b.start - a.end).between(0, window) & kind(a, b).isNotNull()

        return F.flatten(F.transform(es, lambda a, i: F.transform(
            F.filter(F.slice(es, i + 2, F.size(es)), lambda b: fits(a, b)), lambda b: related(a, b))))

    # entities come by start; a stable order for entities given otherwise
    by_start = F.transform(F.array_sort(F.transform(entities, lambda e, i: F.struct(e.start.alias("s"), i.alias("i")))), lambda x: F.get(entities, x.i))
    return F.coalesce(let(by_start, pairs), F.array().cast(f"array<{RELATION}>"))


def with_relations(notes: DataFrame, text: str = "text", conf: EngineConf | None = None) -> DataFrame:
    return notes.withColumn("relations", relations(F.col("entities"), F.col(text), conf))


def relation_rows(notes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, relation_no, source_text, source_type, target_text, target_type, relation_type, confidence, evidence)."""
    rows = exploded(notes, key, F.col("relations"), "relation_no")
    return rows.select(key, "relation_no", F.col("x.source.text").alias("source_text"), F.col("x.source.entity_type").alias("source_type"),
                       F.col("x.target.text").alias("target_text"), F.col("x.target.entity_type").alias("target_type"), "x.relation_type", "x.confidence", "x.evidence")


def medication_of(r: Column) -> Column:
    return F.when((r.relation_type == "HAS_DOSAGE") | (r.source.entity_type == "MEDICAMENTO"), r.source.text).otherwise(r.target.text)


def condition_of(r: Column) -> Column:
    return F.when(r.target.entity_type == "CONDICAO", r.target.text).otherwise(r.source.text)


def profiles(rels: Column, folded: bool = False) -> Column:
    """ARRAY<STRUCT<medication, dosages, conditions>> in the order in which medications first appear.

    ``folded``: one profile for all cases of a name, shown as first written; otherwise one for each spelling.
    """
    key = (lambda m: F.lower(m)) if folded else (lambda m: m)

    def build(rs: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(rs, lambda r: key(r.medication))), lambda k: let(
            F.filter(rs, lambda r: key(r.medication) == k), lambda own: F.struct(
                F.get(own, F.lit(0)).medication.alias("medication"),
                F.transform(F.filter(own, lambda r: r.kind == "HAS_DOSAGE"), lambda r: r.other).alias("dosages"),
                F.transform(F.filter(own, lambda r: r.kind == "TREATS"), lambda r: r.other).alias("conditions"))))

    slim = F.transform(F.filter(rels, lambda r: r.relation_type.isin("HAS_DOSAGE", "TREATS")), lambda r: F.struct(
        medication_of(r).alias("medication"), r.relation_type.alias("kind"), F.when(r.relation_type == "TREATS", condition_of(r)).otherwise(r.target.text).alias("other")))
    return let(slim, build)


def profile_rows(notes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, medication_no, medication, dosages, conditions)."""
    rows = exploded(notes, key, profiles(F.col("relations")), "medication_no")
    return rows.select(key, "medication_no", "x.medication", "x.dosages", "x.conditions")
