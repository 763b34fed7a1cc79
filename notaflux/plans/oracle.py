"""The registered queries in SQL of another engine, written from the rules of the operators and not from their plans.

Its regular expressions know no look-around and ASCII word boundaries only, so entity queries run over ASCII notes.
"""

from __future__ import annotations

from notaflux.functions.vocab import ENTITY_TYPES, Abbreviations, Gazetteers
from notaflux.operators import fhir, relations, summaries
from notaflux.sources.notes import NOTE_TEXT

#: Entries that a caller adds to the dictionary.
MERGED = {"DM2": "Diabetes tipo dois", "SC": "Por via subcutanea", "oral": "pela boca"}
NUM = r"\d+[.,]?\d*"
_MEASURE = r"mg|ml|mcg|g|kg|mm|cm|mmHg|bpm|UI|mEq|mmol|L|dL|mL|ug|ng|pg|U|%|x103|/mm3"
_LAB = r"mg/dL|g/dL|mmol/L|mEq/L|U/L|ng/mL|pg/mL|mcg/dL|mm3|/mm3|%|mil/mm3|x103/uL"
_BARE = r"mg/dL|g/dL|mmol/L|mEq/L|U/L|ng/mL|pg/mL|mcg/dL|/mm3|mil/mm3|x103/uL"
PROTECT = (rf"(?i:\b{NUM}\s*(?:{_MEASURE})\b)", rf"(?i:\b{NUM}\s*/\s*(?:mm3|dL|L|mL)\b)", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\b")
DOSE = {
    "dosage_amounts": rf"(?i:\b{NUM}\s*(?:mg|ml|mcg|g|kg|ui|meq|gotas?|gt|cp|cpr|amp|comp)\b)",
    "dosage_frequencies": r"(?i:\b\d+\s*(?:x|vez(?:es)?)\s*/?\s*(?:ao\s+)?(?:dia|d)\b)",
    "dosage_intervals": r"(?i:\bde\s+\d+\s*/\s*\d+\s*h(?:oras?)?\b)",
    "dosage_every": r"(?i:\ba\s+cada\s+\d+\s*h(?:oras?)?\b)",
    "dosage_routes": r"(?i:\b(?:via\s+oral|vo|ev|im|sc|sl|intramuscular|endovenoso|subcutaneo|sublingual|topico)\b)",
}
LAB = (rf"(?i:\b[A-Z][a-z]+(?:\s+[a-z]+)*\s*[:=]\s*{NUM}\s*(?:{_LAB})\b)", rf"(?i:\b{NUM}\s*(?:{_BARE})\b)")
TOKENS = (
    ("measurement", rf"(?i:\b{NUM}\s*(?:{_MEASURE})\b)"), ("measurement", rf"(?i:\b{NUM}\s*/\s*(?:mm3|dL|L|mL)\b)"), ("measurement", r"(?i:\b\d+x\d+\s*mmHg\b)"),
    ("number", r"\b\d+[.,]\d+\b"), ("number", r"\b\d+\b"), ("word", r"\b[A-Za-z][A-Za-z'-]*\b"), ("punctuation", r"[^\s\w]"), ("unknown", r"\S"),
)
NOTES = f"notes AS (SELECT o_orderkey AS note_id, {NOTE_TEXT} AS text FROM orders)"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _q(text: str) -> str:
    return text.replace("'", "''")


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _parts(text: str, pattern: str) -> str:
    return f"string_split_regex(regexp_replace({text}, '{_q(pattern)}', chr(1) || '\\0' || chr(2), 'g'), '[' || chr(1) || chr(2) || ']')"


def _before(i: str, parts: str = "p") -> str:
    return f"coalesce(list_sum(list_transform({parts}[1:{i} - 1], lambda x: length(x))), 0)"


def _matches(source: str, pattern: str) -> str:
    """(note_id, t, s, e) of every match."""
    return (f"SELECT note_id, p[i] AS t, CAST({_before('i')} AS INTEGER) AS s, CAST({_before('i')} + length(p[i]) AS INTEGER) AS e "
            f"FROM (SELECT note_id, p, unnest(generate_series(2, len(p), 2)) AS i FROM (SELECT note_id, {_parts('text', pattern)} AS p FROM {source}))")


def _terms(words: tuple[str, ...], n: int) -> str | None:
    own = sorted((w for w in words if len(w.replace("-", " ").split()) == n), key=len, reverse=True)
    return rf"(?i:\b(?:{'|'.join(own)})\b)" if own else None


def _candidates(source: str) -> str:
    parts = []
    for k, p in enumerate(DOSE.values()):
        parts.append(f"SELECT *, 'DOSAGEM' AS entity_type, CAST(0.9 AS DOUBLE) AS confidence, 'pattern' AS source, {k} AS ord FROM ({_matches(source, p)})")
    for k, p in enumerate(LAB):
        parts.append(f"SELECT *, 'VALOR_LABORATORIAL', CAST(0.85 AS DOUBLE), 'pattern', {10 + k} FROM ({_matches(source, p)})")
    for k, (kind, words) in enumerate(Gazetteers().by_type()):
        for n in range(1, 5):
            if pattern := _terms(words, n):
                parts.append(f"SELECT *, '{kind}', CAST(0.8 AS DOUBLE), 'gazetteer', {20 + k} FROM ({_matches(source, pattern)})")
    return " UNION ALL ".join(parts)


def _entities(source: str) -> str:
    """CTEs cand, kept, ent(note_id, no, t, entity_type, s, e, confidence, source) over a source (note_id, text)."""
    kinds = " ".join(f"WHEN '{a}>{b}' THEN '{r}'" for a, b, r in relations.RELATED)
    return f"""
cand AS ({_candidates(source)}),
lists AS (SELECT note_id, list([{{'t': t, 'entity_type': entity_type, 's': s, 'e': e, 'confidence': confidence, 'source': source, 'ord': ord}}] ORDER BY s - e, -confidence, ord, s) AS l FROM cand GROUP BY note_id),
kept AS (SELECT note_id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.s < x[1].e AND x[1].s < k.e)) > 0 THEN acc ELSE acc || x END) AS l FROM lists),
flat AS (SELECT note_id, unnest(l, recursive := true) FROM kept),
ent AS (SELECT note_id, CAST(row_number() OVER (PARTITION BY note_id ORDER BY s, -e) - 1 AS INTEGER) AS no, t, entity_type, s, e, confidence, source FROM flat),
pair AS (SELECT a.note_id, a.no AS ia, b.no AS ib, a.t AS ta, a.entity_type AS ka, a.s AS sa, a.e AS ea, b.t AS tb, b.entity_type AS kb, b.s AS sb, b.e AS eb,
  CASE a.entity_type || '>' || b.entity_type {kinds} END AS relation_type FROM ent a JOIN ent b ON a.note_id = b.note_id AND a.no < b.no AND b.s - a.e BETWEEN 0 AND 150),
rel AS (SELECT pair.note_id, CAST(row_number() OVER (PARTITION BY pair.note_id ORDER BY ia, ib) - 1 AS INTEGER) AS relation_no,
  CASE WHEN ka = 'DOSAGEM' THEN tb ELSE ta END AS source_text, CASE WHEN ka = 'DOSAGEM' THEN kb ELSE ka END AS source_type,
  CASE WHEN ka = 'DOSAGEM' THEN ta ELSE tb END AS target_text, CASE WHEN ka = 'DOSAGEM' THEN ka ELSE kb END AS target_type, relation_type,
  round(CASE WHEN relation_type = 'HAS_DOSAGE' THEN least(1.0, greatest(0.5, 1 - CAST(sb - ea AS DOUBLE) / 150) + 0.15) ELSE greatest(0.5, 1 - CAST(sb - ea AS DOUBLE) / 150) END, 3) AS confidence,
  {_strip("substring(text, greatest(0, sa - 20) + 1, least(length(text), eb + 20) - greatest(0, sa - 20))")} AS evidence
  FROM pair JOIN {source} USING (note_id) WHERE relation_type IS NOT NULL),
med AS (SELECT note_id, relation_no, relation_type, CASE WHEN relation_type = 'HAS_DOSAGE' OR source_type = 'MEDICAMENTO' THEN source_text ELSE target_text END AS m,
  CASE WHEN relation_type = 'HAS_DOSAGE' THEN target_text WHEN target_type = 'CONDICAO' THEN target_text ELSE source_text END AS other FROM rel WHERE relation_type IN ('HAS_DOSAGE', 'TREATS')),
firsts AS (SELECT note_id, entity_type, t, no FROM ent QUALIFY row_number() OVER (PARTITION BY note_id, entity_type, lower({_strip('t')}) ORDER BY no) = 1),
medsum AS (
  SELECT note_id, lower(m) AS k, min(relation_no) AS seq, arg_min(m, relation_no) AS nome,
    string_agg(other, ', ' ORDER BY relation_no) FILTER (relation_type = 'HAS_DOSAGE') AS dosagem, string_agg(other, ', ' ORDER BY relation_no) FILTER (relation_type = 'TREATS') AS indicacao
  FROM med GROUP BY note_id, lower(m)
  UNION ALL SELECT note_id, lower(t), 1000000 + no, t, NULL, NULL FROM firsts WHERE entity_type = 'MEDICAMENTO' AND (note_id, lower(t)) NOT IN (SELECT (note_id, lower(m)) FROM med))
"""


def _on_notes(select: str) -> str:
    return f"WITH {NOTES}, {_entities('notes')} {select}"


def _abbreviation_map(more: dict[str, str] | None = None) -> str:
    known = Abbreviations.builtin().mapping | (more or {})
    keys, values = (", ".join(f"'{_q(x)}'" for x in xs) for xs in (known.keys(), known.values()))
    return f"MAP([{keys}], [{values}])"


def _expand(text: str, inline: bool, more: dict[str, str] | None = None) -> str:
    words = sorted(Abbreviations.builtin().mapping | (more or {}), key=len, reverse=True)
    pattern = rf"(?i:\b(?:{'|'.join(w.replace('.', '[.]') for w in words)})\b)"
    new = "coalesce(m[p[i]], m[upper(p[i])], p[i])" if inline else "p[i] || coalesce(' (' || coalesce(m[p[i]], m[upper(p[i])]) || ')', '')"
    return (f"(SELECT array_to_string(list_transform(generate_series(1, len(p)), lambda i: CASE WHEN i % 2 = 0 THEN {new} ELSE p[i] END), '') "
            f"FROM (SELECT {_parts(text, pattern)} AS p, {_abbreviation_map(more)} AS m))")


def _kept(text: str) -> str:
    """(note_id, k0 .. k3, t0 .. t4): what the four patterns protect, and the text that each leaves."""
    inner = f"(SELECT note_id, {text} AS t0 FROM notes)"
    for k, p in enumerate(PROTECT):
        inner = f"(SELECT *, regexp_extract_all(t{k}, '{_q(p)}') AS k{k}, regexp_replace(t{k}, '{_q(p)}', '_' || chr({k + 4}) || '_', 'g') AS t{k + 1} FROM {inner})"
    return inner


def _normalized(text: str) -> str:
    """SQL of the normalisation of ASCII notes."""
    inner = _kept(text)
    body = f"lower({_strip(r"regexp_replace(regexp_replace(t4, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")})"
    inner = f"(SELECT *, {body} AS r0 FROM {inner})"
    for k in range(4):
        parts = f"string_split(r{k}, '_' || chr({k + 4}) || '_')"
        inner = f"(SELECT *, array_to_string(list_transform(generate_series(1, len({parts})), lambda i: {parts}[i] || coalesce(k{k}[i], '')), '') AS r{k + 1} FROM {inner})"
    return f"SELECT note_id, r4 AS text FROM {inner}"


def _uid(*of: str) -> str:
    h = "md5(" + " || '|' || ".join(of) + ")"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"


def _resource_json() -> str:
    """(note_id, no, kind, id, j) of the resources of ent, as JSON; dates are those of the fixed day."""
    rid = _uid("note_id", "s", "e", "entity_type")
    subject = """',"subject":{"reference":"Patient/' || CASE WHEN note_id % 97 > 0 THEN 'pac-' || (note_id % 97) ELSE 'synthetic-patient-001' END || '"}'"""
    note = """',"note":[{"text":"Extraido automaticamente por NLP (confianca: ' || printf('%.2f', confidence) || ')"}]}'"""
    text = "CAST(to_json(t) AS VARCHAR)"
    coding = lambda system, code, display: f'{{"coding":[{{"system":"http://terminology.hl7.org/CodeSystem/{system}","code":"{code}","display":"{display}"}}]}}'
    head = lambda kind: f"""'{{"resourceType":"{kind}","id":"' || {rid} || '"'"""
    condition = f"""{head('Condition')} || ',"clinicalStatus":{coding('condition-clinical', 'active', 'Active')},"verificationStatus":{coding('condition-ver-status', 'confirmed', 'Confirmed')},"code":{{"text":' || {text} || '}}' || {subject} || ',"recordedDate":"2024-01-01"' || {note}"""
    other = lambda kind, status, named, dated, more="''": f"""{head(kind)} || ',"status":"{status}","{named}":{{"text":' || {text} || '}}' || {subject} || ',"{dated}":"2024-01-01"' || {more} || {note}"""
    value = f"""',"valueString":' || {text}"""
    return f"""SELECT note_id, no, CASE entity_type WHEN 'CONDICAO' THEN 'Condition' WHEN 'MEDICAMENTO' THEN 'MedicationStatement' WHEN 'PROCEDIMENTO' THEN 'Procedure' ELSE 'Observation' END AS kind, {rid} AS id,
        CASE entity_type WHEN 'CONDICAO' THEN {condition} WHEN 'MEDICAMENTO' THEN {other('MedicationStatement', 'active', 'medicationCodeableConcept', 'effectiveDateTime')}
        WHEN 'PROCEDIMENTO' THEN {other('Procedure', 'completed', 'code', 'performedDateTime')} ELSE {other('Observation', 'final', 'code', 'effectiveDateTime', value)} END AS j FROM ent WHERE entity_type <> 'DOSAGEM'"""


_RESOURCE_JSON = _resource_json()
_BUNDLE_JSON = f"""'{{"resourceType":"Bundle","id":"' || {_uid("note_id", "'Bundle'")} || '","type":"transaction","timestamp":"2024-01-01T00:00:00+00:00","entry":[' ||
    string_agg('{{"fullUrl":"http://localhost:8080/fhir/' || kind || '/' || id || '","resource":' || j || ',"request":{{"method":"POST","url":"' || kind || '"}}}}', ',' ORDER BY no) || ']}}'"""
_GROUP_ORDER = " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(summaries.GROUPS))
_RESOURCE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fhir.RESOURCES.items())
_STATUS = "CASE entity_type WHEN 'MEDICAMENTO' THEN 'active' WHEN 'PROCEDIMENTO' THEN 'completed' WHEN 'VALOR_LABORATORIAL' THEN 'final' END"
_TYPES = ", ".join(f"('{k}', {i}, '{pt}', '{en}', '{c}')" for i, (k, pt, en, c, _) in enumerate(ENTITY_TYPES))
_LISTS = "SELECT note_id, entity_type, list(t ORDER BY no) AS texts FROM firsts GROUP BY ALL"


def _overview(source: str) -> str:
    return (f"WITH {NOTES}, {source}, {_entities('src')} SELECT entity_type, count(*) AS entities, count(DISTINCT note_id) AS notes, round(avg(confidence), 6) AS avg_confidence FROM ent GROUP BY ALL")


def _flow_counts(source: str) -> str:
    return (f"WITH {NOTES}, {source}, {_entities('src')} SELECT 'entity' AS part, entity_type AS kind, count(*) AS n FROM ent GROUP BY ALL "
            "UNION ALL SELECT 'relation', relation_type, count(*) FROM rel GROUP BY ALL")


_SRC_REPORT = f"src AS ({_normalized('text')})"
_SRC_EXPANDED = f"norm AS ({_normalized('text')}), src AS (SELECT note_id, {_expand('norm.text', True)} AS text FROM norm)"


def oracle_sql() -> dict[str, str]:
    entity_columns = "note_id, no AS entity_no, t AS text, entity_type, s AS start_pos, e AS end_pos, confidence, source"
    out = {
        "normalize_symbols": "SELECT doc_id, replace(translate(text, '–—‘’“”•ºª²³', '--''''\"\"-oa23'), '°', ' graus ') AS text FROM documents",
        "normalize_controls": r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS text FROM documents",
        "normalize_whitespace": f"SELECT doc_id, {_strip(r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM documents",
        "normalize_lower": "SELECT doc_id, lower(text) AS text FROM documents",
        "normalize_nfc": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
        "normalize_full": f"WITH {NOTES} {_normalized('text')}",
        "protected_measurements": f"WITH {NOTES} SELECT note_id, " + ", ".join(f"array_to_string(k{k}, '|') AS {name}" for k, name in enumerate(("measurements", "per_unit", "dates", "times"))) + f" FROM {_kept('text')}",
        "abbreviations_merged": f"WITH {NOTES} SELECT note_id, {_expand('notes.text', True, MERGED)} AS text FROM notes",
        "entities_confident": _on_notes(f"SELECT note_id, CAST(row_number() OVER (PARTITION BY note_id ORDER BY no) - 1 AS INTEGER) AS entity_no, t AS text, entity_type, s AS start_pos, e AS end_pos, confidence, source FROM ent WHERE confidence >= 0.87"),
        "fhir_resource_json": _on_notes(f"SELECT note_id, no AS entity_no, j AS resource FROM ({_RESOURCE_JSON})"),
        "fhir_bundle_json": _on_notes(f"SELECT note_id, {_BUNDLE_JSON} AS bundle FROM ({_RESOURCE_JSON}) GROUP BY note_id"),
        "abbreviations_inline": f"WITH {NOTES} SELECT note_id, {_expand('notes.text', True)} AS text FROM notes",
        "abbreviations_in_brackets": f"WITH {NOTES} SELECT note_id, {_expand('notes.text', False)} AS text FROM notes",
        "abbreviation_dictionary": f"SELECT unnest(map_keys(m)) AS abbreviation, unnest(map_values(m)) AS expansion FROM (SELECT {_abbreviation_map()} AS m)",
        "abbreviation_lookup": f"WITH {NOTES}, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM notes) SELECT word, coalesce(m[word], m[upper(word)]) AS expansion FROM w, (SELECT {_abbreviation_map()} AS m)",
        "abbreviation_frequency": f"WITH {NOTES}, w AS (SELECT note_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM notes), x AS (SELECT note_id, word, coalesce(m[word], m[upper(word)]) AS expansion FROM w, (SELECT {_abbreviation_map()} AS m)) "
        "SELECT word AS abbreviation, expansion, count(*) AS occurrences, count(DISTINCT note_id) AS notes FROM x WHERE expansion IS NOT NULL GROUP BY ALL",
        "sentences": f"WITH {NOTES}, q AS (SELECT note_id, string_split_regex(regexp_replace(text, '([.!?])(\\s+)([A-Z])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), '[' || chr(1) || chr(2) || ']') AS p FROM notes), "
        f"i AS (SELECT note_id, p, unnest(generate_series(1, len(p), 2)) AS i FROM q) SELECT note_id, p[i] AS sentence, CAST({_before('i')} AS INTEGER) AS start_pos, CAST({_before('i')} + length(p[i]) AS INTEGER) AS end_pos FROM i",
        "entity_candidates": _on_notes("SELECT note_id, t AS text, entity_type, s AS start_pos, e AS end_pos, confidence, source FROM cand"),
        "entities": _on_notes(f"SELECT {entity_columns} FROM ent"),
        "entities_top": _on_notes("SELECT note_id, t AS text, entity_type, s AS start_pos, e AS end_pos FROM flat QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY s - e, -confidence, ord, s) <= 3"),
        "entity_stats": _on_notes("SELECT note_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (entity_type = '{k}') AS {k.lower()}" for k, *_ in ENTITY_TYPES) + ", round(avg(confidence), 6) AS avg_confidence FROM ent GROUP BY note_id"),
        "entity_labels": _on_notes(f"SELECT entity_type, label_pt, label_en, color, count(*) AS entities FROM ent JOIN (VALUES {_TYPES}) v(entity_type, ordinal, label_pt, label_en, color) USING (entity_type) GROUP BY ALL"),
        "relations": _on_notes("SELECT * FROM rel"),
        "relations_by_type": _on_notes("SELECT relation_type, count(*) AS relations, count(DISTINCT note_id) AS notes, round(avg(confidence), 6) AS avg_confidence FROM rel GROUP BY ALL"),
        "medication_profiles": _on_notes("SELECT note_id, m AS medication, coalesce(string_agg(other, '|' ORDER BY relation_no) FILTER (relation_type = 'HAS_DOSAGE'), '') AS dosages, coalesce(string_agg(other, '|' ORDER BY relation_no) FILTER (relation_type = 'TREATS'), '') AS conditions FROM med GROUP BY ALL"),
        "summary_groups": _on_notes("SELECT note_id, entity_type, array_to_string(texts, '|') AS texts FROM (" + _LISTS + ")"),
        "summary_medications": _on_notes("SELECT note_id, CAST(row_number() OVER (PARTITION BY note_id ORDER BY seq) - 1 AS INTEGER) AS medication_no, nome, dosagem, indicacao FROM medsum"),
        "prompt_lines": _on_notes(f"""SELECT note_id, coalesce(g, '') || CASE WHEN g IS NOT NULL AND r IS NOT NULL THEN chr(10) ELSE '' END || coalesce(r, '') AS lines FROM
            (SELECT note_id, string_agg(chr(10) || entity_type || ':' || chr(10) || array_to_string(list_transform(texts, lambda t: '  - ' || t), chr(10)), chr(10) ORDER BY CASE entity_type {_GROUP_ORDER} END) AS g FROM ({_LISTS}) GROUP BY note_id)
            LEFT JOIN (SELECT note_id, chr(10) || 'Relacoes:' || chr(10) || string_agg('  - ' || source_text || ' --[' || relation_type || ']--> ' || target_text, chr(10) ORDER BY relation_no) AS r FROM rel GROUP BY note_id) USING (note_id)"""),
        "prompt_text": "",
        "fhir_resources": _on_notes(f"SELECT note_id, no AS entity_no, CASE entity_type {_RESOURCE} END AS resource_type, {_STATUS} AS status, t AS text, 'Extraido automaticamente por NLP (confianca: ' || printf('%.2f', confidence) || ')' AS note FROM ent WHERE entity_type <> 'DOSAGEM'"),
        "fhir_bundle_counts": _on_notes(f"SELECT CASE entity_type {_RESOURCE} END AS resource_type, count(*) AS entries FROM ent WHERE entity_type <> 'DOSAGEM' GROUP BY ALL"),
        "fhir_sections": _on_notes(f"""SELECT note_id, title, code, '<div>' || body || '</div>' AS div FROM (
            SELECT note_id, CASE entity_type WHEN 'CONDICAO' THEN 'Condicoes Clinicas' WHEN 'PROCEDIMENTO' THEN 'Procedimentos' ELSE 'Exames Laboratoriais' END AS title,
              CASE entity_type WHEN 'CONDICAO' THEN 'Conditions' WHEN 'PROCEDIMENTO' THEN 'Procedures' ELSE 'Lab Results' END AS code, CASE entity_type WHEN 'VALOR_LABORATORIAL' THEN array_to_string(texts, '; ') ELSE array_to_string(texts, ', ') END AS body
            FROM ({_LISTS}) WHERE entity_type NOT IN ('DOSAGEM', 'MEDICAMENTO')
            UNION ALL SELECT note_id, 'Medicamentos', 'Medications', string_agg(nome || coalesce(' - ' || dosagem, ''), '; ' ORDER BY seq) FROM medsum GROUP BY note_id)"""),
        "entity_overview": _overview(_SRC_EXPANDED),
        "flow_report": _flow_counts(_SRC_REPORT),
        "flow_expanded": _flow_counts(_SRC_EXPANDED),
    }
    out["summary_json"] = _on_notes(f"""SELECT notes.note_id, '{{"condicoes":' || coalesce(c.j, '[]') || ',"medicamentos":' || coalesce(m.j, '[]') || ',"procedimentos":' || coalesce(p.j, '[]') || ',"valores_laboratoriais":' || coalesce(v.j, '[]') || '}}' AS summary
        FROM notes LEFT JOIN (SELECT note_id, CAST(to_json(texts) AS VARCHAR) AS j FROM ({_LISTS}) WHERE entity_type = 'CONDICAO') c USING (note_id)
        LEFT JOIN (SELECT note_id, CAST(to_json(texts) AS VARCHAR) AS j FROM ({_LISTS}) WHERE entity_type = 'PROCEDIMENTO') p USING (note_id)
        LEFT JOIN (SELECT note_id, CAST(to_json(texts) AS VARCHAR) AS j FROM ({_LISTS}) WHERE entity_type = 'VALOR_LABORATORIAL') v USING (note_id)
        LEFT JOIN (SELECT note_id, '[' || string_agg('{{"nome":"' || nome || '"' || coalesce(',"dosagem":"' || dosagem || '"', '') || coalesce(',"indicacao":"' || indicacao || '"', '') || '}}', ',' ORDER BY seq) || ']' AS j FROM medsum GROUP BY note_id) m USING (note_id)""")
    head, tail = (_q(t).replace("\n", "' || chr(10) || '") for t in (f"{summaries.SYSTEM_PROMPT}\n\n{summaries.PROMPT_ENTITIES}", summaries.PROMPT_TASK))
    out["prompt_text"] = (f"WITH l AS ({out['prompt_lines']}), {NOTES} SELECT note_id, '{head}' || lines || chr(10) || chr(10) || '{_q(summaries.PROMPT_TEXT.strip())}' || chr(10) || "
                          f"substring(text, 1, 2000) || chr(10) || chr(10) || '{tail}' AS prompt FROM l JOIN notes USING (note_id)")
    out["generated_summaries"] = f"SELECT note_id, CAST(length(prompt) AS VARCHAR) AS summary FROM ({out['prompt_text']})"
    sections = out["fhir_sections"].rpartition("SELECT note_id, title, code,")
    out["fhir_composition_json"] = f"""{sections[0]} SELECT notes.note_id, '{{"resourceType":"Composition","id":"' || {_uid("notes.note_id", "'Composition'")} ||
        '","status":"final","type":{{"coding":[{{"system":"http://loinc.org","code":"11488-4","display":"Consultation Note"}}]}},"subject":{{"reference":"Patient/' ||
        CASE WHEN notes.note_id % 97 > 0 THEN 'pac-' || (notes.note_id % 97) ELSE 'synthetic-patient-001' END || '"}},"date":"2024-01-01T00:00:00+00:00","title":"Resumo Clinico Gerado por NLP","section":[' || coalesce(j, '') || ']}}' AS composition
        FROM notes LEFT JOIN (SELECT note_id, string_agg('{{"title":"' || title || '","code":{{"text":"' || code || '"}},"text":{{"status":"generated","div":' || CAST(to_json(div) AS VARCHAR) || '}}}}', ','
          ORDER BY CASE title WHEN 'Condicoes Clinicas' THEN 1 WHEN 'Medicamentos' THEN 2 WHEN 'Procedimentos' THEN 3 ELSE 4 END) AS j FROM ({sections[1]}{sections[2]}) GROUP BY note_id) USING (note_id)"""
    for name, pattern in DOSE.items():
        out[name] = f"WITH {NOTES} SELECT note_id, t AS text, s AS start_pos, e AS end_pos FROM ({_matches('notes', pattern)})"
    out["lab_values"] = f"WITH {NOTES} " + " UNION ALL ".join(f"SELECT note_id, t AS text, s AS start_pos, e AS end_pos FROM ({_matches('notes', p)})" for p in LAB)
    for kind, words in Gazetteers().by_type():
        listed = ", ".join(f"'{w}'" for w in words)
        # neighbouring runs of word characters, one to four of them, joined back from the text
        out[f"gazetteer_{kind.lower()}"] = (
            f"WITH {NOTES}, w AS ({_matches('notes', '[A-Za-z0-9_]+')}), k AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY s) AS i FROM w), "
            f"g AS (SELECT a.note_id, a.s, b.e, substring(text, a.s + 1, b.e - a.s) AS t FROM k a JOIN k b ON a.note_id = b.note_id AND b.i BETWEEN a.i AND a.i + 3 JOIN notes ON notes.note_id = a.note_id) "
            f"SELECT note_id, t AS text, s AS start_pos, e AS end_pos FROM g WHERE lower(t) IN ({listed})")
    scan = "|".join(f"({p})" for _, p in TOKENS)
    marks = " || chr(3) || ".join(f"'\\{k + 1}'" for k in range(len(TOKENS)))
    names = ", ".join(f"'{n}'" for n, _ in TOKENS)
    out["tokens"] = (
        f"WITH {NOTES}, q AS (SELECT note_id, string_split(regexp_replace(text, '{_q(scan)}', chr(1) || {marks} || chr(1), 'g'), chr(1)) AS g FROM notes), "
        f"r AS (SELECT note_id, g, list_transform(g, lambda x: replace(x, chr(3), '')) AS p FROM q), i AS (SELECT note_id, g, p, unnest(generate_series(2, len(p), 2)) AS i FROM r) "
        f"SELECT note_id, p[i] AS token, CAST({_before('i')} AS INTEGER) AS start_pos, CAST({_before('i')} + length(p[i]) AS INTEGER) AS end_pos, "
        f"[{names}][list_position(list_transform(string_split(g[i], chr(3)), lambda x: x <> ''), true)] AS token_type FROM i")
    split = out["sentences"].replace("AS sentence, CAST", "AS text, CAST((i - 1) / 2 AS INTEGER) AS sentence_no, CAST")
    out["sentence_tokens"] = (f"WITH s AS ({split}) SELECT note_id, sentence_no, CAST((len(string_split(regexp_replace(text, '{_q(scan)}', chr(1) || {marks} || chr(1), 'g'), chr(1))) - 1) / 2 AS INTEGER) AS tokens FROM s")
    out["token_types"] = f"SELECT token_type, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM ({out['tokens']}) GROUP BY ALL"
    return out
