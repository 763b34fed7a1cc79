"""Structured summaries of the entities and relations of a text, and the prompt for a text-generation client.

Texts of one type are listed once whatever their case, as first written, in the order of the text. All of it is local to
the row. The client of the generated summary is the caller's own; nothing here calls a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notaflux.conf import EngineConf
from notaflux.functions.spans import let, strip
from notaflux.operators.relations import profiles

# The order in which groups are listed.
GROUPS = ("CONDICAO", "MEDICAMENTO", "DOSAGEM", "PROCEDIMENTO", "VALOR_LABORATORIAL")
# The wording of the prompt.
SYSTEM_PROMPT = """Voce e um assistente clinico especializado em processar prontuarios medicos em portugues brasileiro.
Gere resumos clinicos estruturados a partir das entidades extraidas.
Sempre organize por: Condicoes, Medicamentos com dosagens, Procedimentos e Valores Laboratoriais.
Responda apenas com informacoes presentes no texto original.
Nunca invente dados clinicos.
"""
PROMPT_ENTITIES = "Entidades clinicas extraidas:\n"
PROMPT_TEXT = "Texto clinico original:\n"
PROMPT_TASK = """Gere um resumo clinico estruturado organizado em:
1. Condicoes/Diagnosticos
2. Medicamentos e Dosagens
3. Procedimentos Realizados
4. Resultados Laboratoriais
5. Observacoes Clinicas
"""


def distinct_texts(entities: Column, entity_type: str) -> Column:
    """The texts of one type without repetitions in another case, as first written."""
    fold = lambda t: F.lower(strip(t))
    own = F.transform(F.filter(entities, lambda e: e.entity_type == entity_type), lambda e: e.text)
    return let(own, lambda ts: let(F.transform(ts, fold), lambda ks: F.filter(ts, lambda t, i: F.array_position(ks, fold(t)) == i + 1)))


def medications(entities: Column, rels: Column) -> Column:
    """ARRAY<STRUCT<nome, dosagem, indicacao>>: profiles from relations, then medications without any."""

    def complete(found: Column) -> Column:
        known = F.transform(found, lambda p: F.lower(p.medication))
        alone = F.transform(F.filter(entities, lambda e: e.entity_type == "MEDICAMENTO"), lambda e: e.text)
        first = let(alone, lambda ts: F.filter(ts, lambda t, i: F.array_position(F.transform(ts, F.lower), F.lower(t)) == i + 1))
        rest = F.transform(F.filter(first, lambda t: ~F.array_contains(known, F.lower(t))), lambda t: F.struct(
            t.alias("medication"), F.array().cast("array<string>").alias("dosages"), F.array().cast("array<string>").alias("conditions")))
        return F.concat(found, rest)

    joined = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", "))
    return F.transform(let(profiles(rels, folded=True), complete), lambda p: F.struct(
        p.medication.alias("nome"), joined(p.dosages).alias("dosagem"), joined(p.conditions).alias("indicacao")))


def summary(entities: Column, rels: Column) -> Column:
    """STRUCT<condicoes, medicamentos, procedimentos, valores_laboratoriais>; as JSON, absent fields are left out."""
    return F.struct(distinct_texts(entities, "CONDICAO").alias("condicoes"), medications(entities, rels).alias("medicamentos"),
                    distinct_texts(entities, "PROCEDIMENTO").alias("procedimentos"), distinct_texts(entities, "VALOR_LABORATORIAL").alias("valores_laboratoriais"))


def entity_lines(entities: Column, rels: Column) -> Column:
    """Entities by group and relations, a line each, as the prompt lists them."""
    none = F.array().cast("array<string>")

    def listed(group: str) -> Column:
        return let(distinct_texts(entities, group), lambda ts: F.when(F.size(ts) > 0, F.concat(
            F.array(F.lit(f"\n{group}:")), F.transform(ts, lambda t: F.concat(F.lit("  - "), t)))).otherwise(none))

    groups = [listed(g) for g in GROUPS]
    rel_lines = F.transform(rels, lambda r: F.concat(F.lit("  - "), r.source.text, F.lit(" --["), r.relation_type, F.lit("]--> "), r.target.text))
    related = F.when(F.size(rels) > 0, F.concat(F.array(F.lit("\nRelacoes:")), rel_lines)).otherwise(none)
    return F.array_join(F.concat(*groups, related), "\n")


def prompt(entities: Column, rels: Column, text: Column, conf: EngineConf | None = None) -> Column:
    """The whole prompt; the text is given up to the configured length."""
    most = (conf or EngineConf()).prompt_text_chars
    shown = F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit(PROMPT_TEXT), F.substring(text, 1, most), F.lit("\n\n")))
    return F.concat(F.lit(f"{SYSTEM_PROMPT}\n\n{PROMPT_ENTITIES}"), entity_lines(entities, rels), F.lit("\n\n"), shown, F.lit(PROMPT_TASK))


def generated(prompts: DataFrame, client: Callable[[], Callable[[str], str]], key: str = "doc_id", column: str = "prompt", attempts: int = 3, wait: float = 2.0, most_wait: float = 10.0) -> DataFrame:
    """(key, summary) by a text-generation client of the caller: ``client`` is made once a partition; a call that fails
    is repeated with growing waits, and the last failure is raised."""
    kind = prompts.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        call = client()
        for batch in batches:
            out = []
            for p in batch["prompt"]:
                for k in range(attempts):
                    try:
                        out.append(call(p))
                        break
                    except Exception:
                        if k + 1 == attempts:
                            raise
                        time.sleep(min(most_wait, wait * 2**k))
            yield pd.DataFrame({"k": batch["k"], "summary": out})

    return prompts.select(F.col(key).alias("k"), F.col(column).alias("prompt")).mapInPandas(work, f"k {kind}, summary string").withColumnRenamed("k", key)
