"""The registered queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notaflux.llm import canonical_list, encoding, lookalikes, packing, pairs, personal, sentences, splitting, term_counts
from notaflux.sources.tables import once, table

LISTED = ("MEDICAMENTO", "CONDICAO", "PROCEDIMENTO")


def _stems(spark: SparkSession, root: str) -> frozenset[str]:
    """Stems of the canonical list, a table of fixed size (228 rows)."""
    return sentences.word_stems(r[0] for r in table(spark, root, "reference_terms").where("term is not null").select("term").toLocalIterator())


def _sentences(spark: SparkSession, root: str) -> DataFrame:
    notes = sentences.notes_of(table(spark, root, "clinical_texts"), "evolucao_uti")
    return sentences.sentences(notes, lang="lang", truncations=_stems(spark, root))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _sentences(spark, root).select("note_id", "start_pos", "end_pos")


def p1_sentences(spark: SparkSession, root: str) -> DataFrame:
    return _sentences(spark, root)


def _forms(spark: SparkSession, root: str) -> DataFrame:
    texts = table(spark, root, "clinical_texts")
    others = texts.where(F.col("note_name").isNull() | (F.col("note_name") != "internacao_pneumologia")).select("text")
    return lookalikes.canonical(sentences.notes_of(texts, "internacao_pneumologia").select("note_id", "text"), corpus=others)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalikes.look_same(_forms(spark, root))


def p2_classes(spark: SparkSession, root: str) -> DataFrame:
    return lookalikes.classes(_forms(spark, root))


def p2_canonical(spark: SparkSession, root: str) -> DataFrame:
    return _forms(spark, root).select("note_id", F.col("canonical").alias("text"), "repairs")


def _consultations(spark: SparkSession, root: str) -> DataFrame:
    return sentences.notes_of(table(spark, root, "clinical_texts"), "consulta_cardiologia").select("note_id", "text")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return personal.personal_spans(_consultations(spark, root)).select("note_id", "kind", "start_pos", "end_pos")


def p3_sanitised(spark: SparkSession, root: str) -> DataFrame:
    notes = _consultations(spark, root)
    return personal.sanitised(notes, personal.personal_spans(notes, places=True))


def _matched(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    listed = table(spark, root, "reference_terms")
    typed = table(spark, root, "clinical_entities").where(F.col("entity_type").isin(*LISTED) & F.col("text").isNotNull()).select("entity_id", "text", "entity_type")
    exact = listed.select("entity_type", F.col("term").alias("text"))
    free = typed.join(exact, ["entity_type", "text"], "left_anti")
    return free.dropDuplicates(["entity_id"]), listed, canonical_list.match_list(free, listed)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    free, _, matched = _matched(spark, root)
    return free.join(matched.select("entity_type", "text", "term_id"), ["entity_type", "text"], "left").select("entity_id", F.coalesce("term_id", F.lit(0)).cast("bigint").alias("term_id"))


def p4_unmatched(spark: SparkSession, root: str) -> DataFrame:
    """Values without an entry, with how many entities write them: the report of what the list lacks."""
    free, _, matched = _matched(spark, root)
    return free.join(matched.where("term_id is null"), ["entity_type", "text"]).groupBy("entity_type", "text").agg(F.count(F.lit(1)).alias("entities"), F.max("score").alias("best_score"))


def _baskets(spark: SparkSession, root: str) -> DataFrame:
    return pairs.baskets(table(spark, root, "clinical_relations"), table(spark, root, "clinical_entities"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    judged = pairs.surprise(_baskets(spark, root), least=5, ratio=3.0)
    return judged.where("q_bound <= 1").select(F.col("kind").alias("relation_type"), F.col("a").alias("text_a"), F.col("b").alias("text_b"))


def p6_surprise(spark: SparkSession, root: str) -> DataFrame:
    return pairs.surprise(_baskets(spark, root)).withColumnRenamed("kind", "relation_type")


def _counts(spark: SparkSession, root: str) -> DataFrame:
    entities = table(spark, root, "clinical_entities")
    return term_counts.marked(term_counts.term_counts(entities, "entity_type", "text", "note_id", "entity_id"), entities, "note_id")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _counts(spark, root).where("mark is not null").select("entity_type", "term", "mark")


def p7_counts(spark: SparkSession, root: str) -> DataFrame:
    return _counts(spark, root)


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return encoding.encode(table(spark, root, "documents"))


def p8_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, same): whether decoding the ids gives the text back."""
    docs = table(spark, root, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("sent"))
    back = encoding.decode(encoding.encode(table(spark, root, "documents"))).select("doc_id", F.md5("text").alias("came"))
    return docs.join(back, "doc_id").select("doc_id", (F.col("sent") == F.col("came")).alias("same"))


def _packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, root, "documents")))


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root).select(F.col("key").alias("doc_id"), "piece", "pieces", F.col("size").alias("tokens"), F.col("bin").alias("container"), F.col("fill").alias("container_tokens"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root).where("pieces > 1 and piece = 0").select(F.col("key").alias("doc_id"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_texts(table(spark, root, "documents"), lang="lang").where("piece_no = 0 and pieces > 1").select("doc_id")


def p10_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_texts(table(spark, root, "documents"), with_piece=True, lang="lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_sentences, p2_found, p2_classes, p2_canonical, p3_found, p3_sanitised, p4_found, p4_unmatched, p6_found, p6_surprise,
        p7_found, p7_counts, p8_ids, p8_round_trip, p9_found, p9_containers, p10_found, p10_pieces,
    )}


_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
_STRIP = rf"lower(regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g'))"
_COUNTS = f"""
WITH one AS (SELECT DISTINCT entity_id, note_id, entity_type, {_STRIP} AS term FROM clinical_entities WHERE entity_type IS NOT NULL AND text IS NOT NULL),
total AS (SELECT count(DISTINCT note_id) AS n FROM clinical_entities),
counted AS (SELECT entity_type, term, count(*) AS occurrences, count(DISTINCT note_id) AS records FROM one GROUP BY ALL)
SELECT entity_type, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > n * 0.05 THEN 'common' END AS mark FROM counted, total
"""
_PAIRS = f"""
WITH rel AS (SELECT DISTINCT relation_type, note_id, source_entity_id, target_entity_id FROM clinical_relations WHERE relation_type IS NOT NULL AND note_id IS NOT NULL),
ends AS (SELECT relation_type, note_id, source_entity_id AS entity_id FROM rel UNION SELECT relation_type, note_id, target_entity_id FROM rel),
item AS (SELECT DISTINCT relation_type, note_id, {_STRIP} AS t FROM ends JOIN clinical_entities e USING (entity_id) WHERE text IS NOT NULL),
""".replace("SELECT DISTINCT relation_type, note_id, lower", "SELECT DISTINCT relation_type, ends.note_id, lower") + """
freq AS (SELECT relation_type, t, count(*) AS c FROM item GROUP BY ALL),
total AS (SELECT relation_type, count(DISTINCT note_id) AS n FROM item GROUP BY ALL),
both_ AS (SELECT a.relation_type, a.t AS ta, b.t AS tb, count(*) AS n_ab FROM item a JOIN item b ON a.relation_type = b.relation_type AND a.note_id = b.note_id AND a.t < b.t GROUP BY ALL)
SELECT relation_type, ta AS text_a, tb AS text_b FROM both_ JOIN total USING (relation_type)
JOIN freq fa ON fa.relation_type = both_.relation_type AND fa.t = ta JOIN freq fb ON fb.relation_type = both_.relation_type AND fb.t = tb
WHERE n_ab >= 5 AND n_ab * n >= 3 * fa.c * fb.c
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _PAIRS,
        "p7_counts": _COUNTS,
        "p7_found": f"SELECT entity_type, term, mark FROM ({_COUNTS}) WHERE mark IS NOT NULL",
        "p8_round_trip": "SELECT doc_id, true AS same FROM documents",
    }
