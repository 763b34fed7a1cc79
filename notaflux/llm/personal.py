"""Personal information in free text: found, typed and replaced, the rest kept readable.

Information-theoretic sanitisation. Places where the writing or the wording calls for a protected entity are candidates:
written forms of e-mail addresses, phones, identity numbers and street addresses, and for people what a title, "falar
com" or "Nome da mãe:" introduces. The corpus then tells for every term and every class of entity how strongly the term
reveals that class:

    disclosure(t, class) = PMI(t; class) / IC(class) = 1 + log p(class | t) / -log p(class)   (0: independent, 1: certain)

Counts run over all notes; the lexicon is joined, never collected. A candidate is removed, and a typed placeholder stands
in its place, if one of its terms is at or over ``threshold``; a place that called for an entity but holds only terms that
the corpus mostly writes elsewhere is left alone. Names are removed wherever they stand: two revealing terms next to each
other also without such wording, a single one from ``alone`` on. Terms that reveal an address and stand outside of any
("bairro" without a street) are generalised to a place when the text is written over.

Defined results: null and blank texts give no span (and stay as they are); spans of a note never overlap; the first kind
of address, email, identity, phone, person wins a place; repeated rows of one id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notaflux.cluster import cut

# What a replaced span reads.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[TELEFONE]", "identity": "[DOCUMENTO]", "address": "[ENDERECO]", "person": "[PESSOA]", "place": "[LOCAL]"}

_W = r"(?:(?:Profa?|Dra?|Cap|Cel|Gen|Sgt|Ten|Sta|Sto|Eng|Vd|Pe|Ver|Des|Mal|\p{Lu})\.|\p{Lu}[\p{L}\p{M}'’]*(?:-[\p{Lu}\p{Ll}][\p{L}\p{M}]*)*)"
_LINK = r"(?i:d[aeo]s?|e)"
_NAMEWORDS = rf"{_W}(?:\s+{_LINK}\s+{_W}|\s+{_W})*"
_PLACE = rf"(?:{_LINK}\s+)?{_NAMEWORDS}"
_UNIT = (
    r"(?i:(?:bl|bloco|torre)\.?\s*\w{1,3}(?:,?\s+(?:apto|apt|ap|apartamento)\.?\s*\d+\w?)?"
    r"|(?:apto|apt|ap|apartamento|casa|sala|cj|conjunto|loja|lote|quadra|qd|lt|km|andar)\b\.?\s*\d+\w?|fundos|sobrado|t[ée]rreo)"
)
_DISTRICT = rf"(?:(?i:bairro|jardim|jd\.|vila|parque|pq\.|n[úu]cleo|residencial|conjunto|distrito|cidade|setor|loteamento|ch[áa]cara)\s+{_PLACE}|Centro\b)"
_POSTAL = r"(?:(?i:cep):?\s*)?(?<!\d)\d{5}-?\d{3}(?!\d)"
_ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:(?i:rua|avenida|av\.|pra[çc]a|p[çc]a\.|travessa|trav\.|tv\.|estrada|estr\.|rodovia|rod\.|alameda|al\.|largo|beco|viela)|(?<!\b\p{{Lu}}[\p{{L}}]+\s)[Rr]\.)"
    rf"\s+{_PLACE}(?:,?\s+(?:(?i:n[º°o]?\.?|n[úu]mero)\s*)?\d{{1,6}}(?!\d|[.,/]\d|\s+anos)|,?\s+s/?n\b)"
    rf"(?:(?:\s*,|\s+[-–])\s*(?:{_UNIT}|{_DISTRICT}|{_POSTAL}))*"
)
_EMAIL = regex.compile(
    r"(?<![\w.+-])[\w.+-]*\w(?:\s?@\s?|\s?[(\[{]\s?(?:at|arroba)\s?[)\]}]\s?|\s(?:at|arroba)\s(?=[\w-]+(?:\.|\s?[(\[{]?\s?(?:dot|ponto)\b)))"
    r"[\w-]+(?:(?:\.|\s?[(\[{]\s?(?:dot|ponto)\s?[)\]}]\s?|\s(?:dot|ponto)\s)[\w-]+)+",
    regex.I,
)
_CPF = r"\d{3}[ .]?\d{3}[ .]?\d{3}[ .\-/]?\d{2}"
_CNS = r"\d{3}[ .]?\d{4}[ .]?\d{4}[ .]?\d{4}"
_RG = r"\d{1,2}\.?\d{3}\.?\d{3}-?[\dXx]"
_LABEL = (
    r"(?i:\b(?:c\.?p\.?f|c\.?n\.?s|r\.?g|cart[ãa]o\s+(?:nacional\s+)?(?:do\s+|de\s+)?(?:sus|sa[úu]de)|passaporte|documento|doc|identidade|cnh|nis|pis)\b"
    r"\.?\s*(?:n(?:[úu]mero|[º°o]|\b)?\.?)?\s*[:.]?\s*)"
)
_LABELLED = regex.compile(rf"{_LABEL}(?P<id>{_CNS}|{_CPF}|{_RG}|[A-Z]{{2}}[ -]?\d{{6,7}}|\d[\d.\-]{{4,18}}[\dXx])(?![\d]|-\d)")
_BARE_ID = regex.compile(rf"(?<![\d.\-/])(?:(?P<cpf>\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}})|(?P<rg>\d{{2}}\.\d{{3}}\.\d{{3}}-[\dXx])|(?P<cns>[12789]\d{{2}} \d{{4}} \d{{4}} \d{{4}}))(?![\d]|-\d)")
_PHONE = regex.compile(
    r"(?<![\d.\-/+\p{L}])(?:"
    r"(?:\+?55[ .\-]?)?\(0?\d{2}\)[ ]?(?:9[ .\-]?\d{4}|[2-5]\d{3})[ .\-]?\d{4}"
    r"|\+55[ .\-]?\d{2}[ .\-]?9?[ .\-]?\d{4}[ .\-]?\d{4}"
    r"|0?\d{2}[ .\-](?:9[ ]?\d{4}|[2-5]\d{3})[ .\-]\d{4}"
    r"|9[ ]?\d{4}-\d{4}|[2-5]\d{3}-\d{4}"
    r")(?![\d]|[.\-/,]\d)"
)
_NOT_PHONE = regex.compile(r"(?i)(?:protocolo|guia|lote|processo|atendimento|pedido|prontu[áa]rio|registro|n[º°])\s*:?\s*$")

_TITLE = r"(?:sr|sra|srta|dr|dra|drs|dras|prof|profa|enf|enfª|exmo|exma)\.(?:\s+(?:dr|dra|prof|profa)\.)*"
_CUE = regex.compile(
    rf"(?i)\b(?:{_TITLE}\s+|nome\s+(?:d[aeo]\s+\p{{L}}+|completo|social)?\s*:\s*|(?:acompanhad[oa]|assinad[oa]|atendid[oa]|avaliad[oa]|trazid[oa])\s+por\s+|falar\s+com\s+|conversei\s+com\s+|aos\s+cuidados\s+d[eoa]\s+"
    r"|(?:cuidadora?|respons[áa]vel|acompanhante|contato|m[ãa]e|pai|filh[oa]|espos[oa]|marido|irm[ãa]o?|c[ôo]njuge|vizinh[oa])\s*[:(]\s*|dados\s*:\s*|quem\s+assina\s+[ée]\s+|segundo\s+|paciente:?\s+|chama-se\s+)"
)
_TOKEN = regex.compile(r"[\p{L}][\p{L}\p{M}'’]*(?:-[\p{L}][\p{L}\p{M}]*)*")
_LINKS = frozenset("da de do das dos e".split())
# Words before a capitalised name that make it a place, institution, ward, test or product.
_NO_PERSON_BEFORE = frozenset(
    "hospital hosp santa são sao dona ala setor teste sinal escala índice indice fator unidade clínica clinica instituto núcleo nucleo bairro vila jardim parque "
    "síndrome sindrome doença doenca mal método metodo manobra produto marca farmácia farmacia laboratório laboratorio maternidade upa ubs posto enfermaria de do da dos das".split()
)
_STOP = frozenset(
    "mora refere sobre em para antes e usa tel telefone portador portadora residente que com sem anos nega relata informa a o as os ao no na por foi está esta é ou diz disse "
    "comparece retorna trouxe ficou deixou pede aceita autoriza ciente acompanha segue vem veio".split()
)
_NOT_TERM = regex.compile(r"[^\p{L}\p{N}@]+")
# terms of the text around: words, and numbers without the signs that group their digits
_WORDS, _NUMBERS = r"(\p{L}[\p{L}\p{M}'’]*(?:-\p{L}[\p{L}\p{M}]*)*)", r"(\p{N}(?:[\p{N}]|[ .\-/](?=\p{N}))*)"
TYPED = "array<struct<kind:string,start_pos:bigint,end_pos:bigint,terms:array<string>>>"
CHAINS = "array<struct<chain:int,token:int,term:string,start_pos:bigint,end_pos:bigint,cue:boolean,capital:boolean>>"


def typed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what has a written form of its own, without overlaps."""
    taken: list[tuple[str, int, int]] = []

    def free(s: int, e: int) -> bool:
        return all(e <= a or s >= b for _, a, b in taken)

    for m in _EMAIL.finditer(text):
        taken.append(("email", m.start(), m.end()))
    for m in _ADDRESS.finditer(text):
        if free(m.start(), m.end()):
            taken.append(("address", m.start(), m.end()))
    for m in _LABELLED.finditer(text):
        if free(m.start("id"), m.end("id")):
            taken.append(("identity", m.start("id"), m.end("id")))
    for m in _BARE_ID.finditer(text):
        if free(m.start(), m.end()):
            taken.append(("identity", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if free(m.start(), m.end()) and not _NOT_PHONE.search(text, max(0, m.start() - 20), m.start()):
            taken.append(("phone", m.start(), m.end()))
    return sorted(taken, key=lambda x: x[1])


def name_chains(text: str, typed: list[tuple[str, int, int]]) -> list[tuple[int, int, str, int, int, bool, bool]]:
    """(chain, token, term, start, end, cue, capital): runs of words that could name a person.

    ``cue``: the wording before the run calls for a person. Within a run only a space, a link word, an initial or,
    after such wording, the comma of a name turned round stands between two words.
    """
    covered = bytearray(len(text) + 1)
    for _, s, e in typed:
        covered[s:e] = b"\x01" * (e - s)
    cues = set()
    for m in _CUE.finditer(text):
        if not covered[m.start()]:
            cues.add(m.end())
            covered[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    out: list[tuple[int, int, str, int, int, bool, bool]] = []
    words = [m for m in _TOKEN.finditer(text) if not covered[m.start()]]
    chain = -1
    i = 0
    while i < len(words):
        m = words[i]
        cue = m.start() in cues
        w = m[0]
        before = words[i - 1][0].lower() if i and text[words[i - 1].end() : m.start()].isspace() else ""
        lower_name = cue and w[0].islower() and w.lower() not in _STOP and w.lower() not in _LINKS
        if not (w[0].isupper() or lower_name) or (not cue and before in _NO_PERSON_BEFORE):
            i += 1
            if not cue and before in _NO_PERSON_BEFORE and w[0].isupper():  # the whole capitalised run is the place's
                while i < len(words) and words[i][0][0].isupper() and text[words[i - 1].end() : words[i].start()].isspace():
                    i += 1
            continue
        chain += 1
        run = [m]
        j = i + 1
        inverted = False
        while j < len(words):
            gap = text[run[-1].end() : words[j].start()]
            v = words[j][0]
            capital = v[0].isupper()
            if gap.strip() == "" and gap and v.lower() in _LINKS and j + 1 < len(words) and text[words[j].end() : words[j + 1].start()].isspace():
                nxt = words[j + 1][0]
                if v.lower() != "e" and (nxt[0].isupper() or lower_name and nxt.lower() not in _STOP):
                    run.append(words[j])
                    j += 1
                    continue
                break
            fits = capital or lower_name and v.lower() not in _STOP
            if fits and (gap.isspace() or gap.strip() == "." and len(run[-1][0]) == 1 and gap != "."):
                run.append(words[j])
            elif fits and cue and not inverted and gap.rstrip() == "," and gap != "," and (lower_name or capital):
                inverted = True
                run.append(words[j])
            else:
                break
            j += 1
        for k, t in enumerate(run):
            out.append((chain, k, t[0].lower(), t.start(), t.end(), cue, t[0][0].isupper()))
        i = max(j, i + 1)
    return out


def terms_of(kind: str, span: str) -> list[str]:
    """What can reveal an entity: the words of an address; the whole of an e-mail address or a number, without its signs."""
    if kind == "address":
        return [m[0].lower() for m in _TOKEN.finditer(span)]
    return [_NOT_TERM.sub("", span.lower())]


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        typed_col, chain_col, rest_col = [], [], []
        for text in texts:
            if text is None or text.isspace() or not text:
                typed_col.append([])
                chain_col.append([])
                rest_col.append("")
                continue
            typed = typed_spans(text)
            typed_col.append([{"kind": k, "start_pos": s, "end_pos": e, "terms": terms_of(k, text[s:e])} for k, s, e in typed])
            chain_col.append([dict(zip(("chain", "token", "term", "start_pos", "end_pos", "cue", "capital"), c, strict=True)) for c in name_chains(text, typed)])
            parts, at = [], 0
            for _, s, e in typed:
                parts.append(text[at:s])
                at = e
            rest_col.append(" ".join((*parts, text[at:])).lower())
        yield pd.DataFrame({"typed": typed_col, "chains": chain_col, "rest": rest_col})


def disclosures(scanned: DataFrame) -> DataFrame:
    """(kind, term, occurrences, in_class, disclosure) of every term that stands where an entity of a class may stand."""
    count = F.count(F.lit(1))
    numbers = F.transform(F.regexp_extract_all("rest", F.lit(_NUMBERS), F.lit(1)), lambda n: F.regexp_replace(n, r"[^\p{N}]", ""))
    around = cut(scanned.select(F.explode(F.concat(F.regexp_extract_all("rest", F.lit(_WORDS), F.lit(1)), numbers)).alias("term")).groupBy("term").agg(count.alias("n")))  # read twice
    typed = scanned.select(F.explode("typed").alias("s")).select("s.kind", F.explode("s.terms").alias("term")).groupBy("kind", "term").agg(count.alias("in_class"))
    people = scanned.select(F.explode("chains").alias("c")).where("c.cue").groupBy(F.col("c.term").alias("term")).agg(count.alias("in_class"))
    classed = typed.unionByName(people.where(~F.col("term").isin(*_LINKS)).select(F.lit("person").alias("kind"), "term", "in_class"))
    # the text around holds the places of people, but no written forms; those of other classes say nothing about this one
    written = F.when(F.col("kind") == "person", 0).otherwise(F.col("in_class"))
    met = classed.join(around, "term", "left").withColumn("occurrences", F.coalesce("n", F.lit(0)) + written)
    total = around.agg(F.sum("n").alias("around"))  # one row
    sizes = classed.groupBy("kind").agg(F.sum("in_class").alias("size"), F.sum(written).alias("beside")).crossJoin(F.broadcast(total))  # a row per class
    p_t = F.least(F.lit(1.0), F.col("in_class") / F.col("occurrences"))
    share = F.col("size") / (F.coalesce("around", F.lit(0)) + F.col("beside"))
    ic = -F.log(F.least(F.lit(1 - 1e-12), F.greatest(share, F.lit(1e-12))))
    return met.join(F.broadcast(sizes), "kind").select("kind", "term", "occurrences", "in_class", F.greatest(F.lit(0.0), 1 + F.log(p_t) / ic).alias("disclosure"))


def _scanned(notes: DataFrame, key: str, text: str) -> DataFrame:
    scan = F.pandas_udf(_scan, f"struct<typed:{TYPED},chains:{CHAINS},rest:string>")
    some = notes.where(F.length(F.trim(F.col(f"`{text}`"))) > 0)
    return cut(some.select(F.col(f"`{key}`").alias("__key"), scan(F.col(f"`{text}`")).alias("__s")).select("__key", "__s.*"))


def _judged(scanned: DataFrame, threshold: float, alone: float) -> tuple[DataFrame, DataFrame]:
    """(__key, kind, start_pos, end_pos) of what is removed, and of the places outside addresses that are generalised."""
    lexicon = cut(disclosures(scanned).where(F.col("disclosure") >= threshold).select("kind", "term", "disclosure"))
    tokens = scanned.select("__key", F.explode("chains").alias("c")).select("__key", "c.*")
    of = lambda kind: lexicon.where(F.col("kind") == kind).select("term", F.col("disclosure").alias(kind))
    marked = tokens.join(of("person"), "term", "left").withColumn("person", F.when(F.length("term") > 1, F.col("person")))
    reveals = F.col("person").isNotNull()
    chains = marked.groupBy("__key", "chain").agg(
        F.bool_or("cue").alias("cue"), F.count_if(reveals).alias("hits"), F.bool_or("capital").alias("capital"), F.max(F.when(F.col("capital"), F.col("person"))).alias("best"),
        F.min("start_pos").alias("first"), F.max("end_pos").alias("last"),
        F.min(F.when(reveals, F.col("start_pos"))).alias("first_hit"), F.max(F.when(reveals, F.col("end_pos"))).alias("last_hit"),
    )
    whole = F.col("cue") & F.col("capital")  # the wording names the whole run; in other runs and in lower case only what reveals counts
    named = (F.col("hits") > 1) | F.col("cue") & (F.col("hits") > 0) | F.coalesce(F.col("best") >= alone, F.lit(False))
    persons = chains.where(named).select(
        "__key", F.lit("person").alias("kind"), F.when(whole, F.col("first")).otherwise(F.col("first_hit")).alias("start_pos"),
        F.when(whole, F.col("last")).otherwise(F.col("last_hit")).alias("end_pos"))
    spans = scanned.select("__key", F.explode("typed").alias("s")).select("__key", "s.kind", "s.start_pos", "s.end_pos", F.explode("s.terms").alias("term"))
    typed = spans.join(lexicon.select("kind", "term"), ["kind", "term"], "left_semi").select("__key", "kind", "start_pos", "end_pos").distinct()
    lone = tokens.where("capital and not cue").join(of("address").where(F.col("address") >= alone), "term").join(of("person"), "term", "left").where(F.col("person").isNull() & (F.length("term") > 1))
    places = lone.select("__key", F.lit("place").alias("kind"), "start_pos", "end_pos")
    return typed.unionByName(persons), places


def personal_spans(notes: DataFrame, key: str = "note_id", text: str = "text", threshold: float = 0.6, alone: float = 0.9, places: bool = False) -> DataFrame:
    """(key, kind, start_pos, end_pos) of each piece of personal information; ``key`` must be distinct.

    ``threshold``: the least disclosure at which a term is removed where an entity may stand; ``alone``: at which a single
    term is, without anything that calls for it. ``places`` adds the terms that are generalised, as kind ``place``.
    """
    found, general = _judged(_scanned(notes, key, text), threshold, alone)
    return (found.unionByName(general) if places else found).select(F.col("__key").alias(key), "kind", "start_pos", "end_pos")


def _write_over(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, found in batches:
        out = []
        for text, spans in zip(texts, found, strict=True):
            if text is None or spans is None or not len(spans):
                out.append(text)
                continue
            parts, at = [], 0
            for x in sorted(spans, key=lambda x: (x["start_pos"], x["kind"] == "place", -x["end_pos"])):
                if x["start_pos"] < at:
                    continue
                parts += [text[at : x["start_pos"]], PLACEHOLDERS[x["kind"]]]
                at = x["end_pos"]
            out.append("".join((*parts, text[at:])))
        yield pd.Series(out, dtype=object)


def sanitised(notes: DataFrame, spans: DataFrame, key: str = "note_id", text: str = "text") -> DataFrame:
    """(key, text, n_spans) with a typed placeholder in the place of each span; every note comes out, also without any."""
    write = F.pandas_udf(_write_over, "string")
    per_note = spans.groupBy(key).agg(F.collect_list(F.struct("kind", "start_pos", "end_pos")).alias("__spans"))
    return notes.select(key, text).join(per_note, key, "left").select(
        key, write(F.col(text), F.col("__spans")).alias(text), F.coalesce(F.size("__spans"), F.lit(0)).alias("n_spans"))
