"""Named entities of note texts: dosages and laboratory values by pattern, terms by gazetteer, overlaps resolved.

Everything is local to the row: candidates are arrays, the resolution is a fold, nothing is shuffled. Large vocabularies
that do not fit a pattern go through ``gazetteer_join``, a join of word n-grams with the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notaflux.conf import EngineConf
from notaflux.functions.patterns import DOSE_EDGES, DOSE_FORMS, LABS, edges, either
from notaflux.functions.spans import WORD, exploded, let, running, spans, tagged
from notaflux.functions.vocab import DEFAULT_COLOR, ENTITY_TYPES, Gazetteers

ENTITY = "struct<text:string,entity_type:string,start:int,end:int,confidence:double,source:string,metadata:map<string,string>>"
# Confidence of each way of finding an entity.
DOSAGE_CONFIDENCE, LAB_CONFIDENCE, TERM_CONFIDENCE = 0.90, 0.85, 0.80


Kinds = list[tuple[str, str, float, str, int]]


def _entities(text: Column, kinds: Kinds, before: str = "", after: str = "") -> Column:
    """Entities of one scan with several patterns: (pattern, type, confidence, source, order) each."""
    kind, confidence, source, order = (F.array(*[F.lit(k[n]) for k in kinds]) for n in (1, 2, 3, 4))
    return F.transform(tagged(text, [k[0] for k in kinds], before, after), lambda s: F.struct(
        F.get(order, s.tag).alias("order"), s.text.alias("text"), F.get(kind, s.tag).alias("entity_type"), s.start.alias("start"), s.end.alias("end"),
        F.get(confidence, s.tag).alias("confidence"), F.get(source, s.tag).alias("source")))


def apart(terms: tuple[str, ...]) -> list[list[str]]:
    """Terms in classes of which no two can share a word of a text, so that one scan finds every place of each term.

    Terms of one word come first, as they cannot overlap each other.
    """
    classes: list[tuple[int, list[str], set, set]] = []
    for t in terms:
        words = tuple(t.lower().replace("-", " ").split())
        heads, tails = ({w for k in range(1, len(words) + 1) for w in [cut(k)]} for cut in (lambda k: words[:k], lambda k: words[-k:]))
        fits = (c for c in classes if c[0] == len(words) and not heads & c[3] and not tails & c[2])
        home = next(fits, None)
        if home is None:
            home = (len(words), [], set(), set())
            classes.append(home)
        home[1].append(t)
        home[2].update(heads)
        home[3].update(tails)
    return [own for _, own, *_ in sorted(classes, key=lambda c: c[0])]


def dosages(text: Column) -> Column:
    """One scan: the five forms of a dosage never share a character."""
    return _entities(text, [(p, "DOSAGEM", DOSAGE_CONFIDENCE, "pattern", k) for k, p in enumerate(DOSE_FORMS)], *DOSE_EDGES)


def lab_values(text: Column) -> Column:
    """A scan for each pattern: a bare value lies inside a named one."""
    return F.concat(*[_entities(text, [(p, "VALOR_LABORATORIAL", LAB_CONFIDENCE, "pattern", 10 + k)]) for k, p in enumerate(LABS)])


def terms(text: Column, vocabulary: Gazetteers | None = None) -> Column:
    """A scan for each class of terms that cannot overlap, over all types, so overlapping terms are all candidates; terms
    of several words are scanned only in texts that hold one."""
    listed = (vocabulary or Gazetteers()).by_type()
    scans: list[tuple[list[str], Kinds, bool]] = []
    for k, (kind, words) in enumerate(listed):
        for own in apart(words):
            single = len(own[0].replace("-", " ").split()) == 1
            # a class joins a scan of other types whose terms it cannot overlap
            home = next((s for s in scans if s[2] == single and len(apart((*s[0], *own))) == 1), None)
            if home is None:
                home = ([], [], single)
                scans.append(home)
            home[0].extend(own)
            home[1].append((either(own), kind, TERM_CONFIDENCE, "gazetteer", 20 + k))
    none = F.array().cast("array<struct<order:int,text:string,entity_type:string,start:int,end:int,confidence:double,source:string>>")
    found = []
    for own, kinds, single in scans:
        before, after = edges(own)
        scan = _entities(text, kinds, before, after)
        found.append(scan if single else F.when(text.rlike(f"{before}(?:{'|'.join(k[0] for k in kinds)}){after}"), scan).otherwise(none))
    return F.concat(none, *found)


def candidates(text: Column, vocabulary: Gazetteers | None = None) -> Column:
    """All candidates: dosages, laboratory values, medications, conditions, procedures."""
    return F.concat(dosages(text), lab_values(text), terms(text, vocabulary))


_BY_RANK = ("k1", "k2", "k3", "start", "end", "text", "entity_type", "confidence", "source")
_RANKED = "struct<k1:int,k2:double,k3:int,start:int,end:int,text:string,entity_type:string,confidence:double,source:string>"
_FEW = 24


def _in_order(found: Column, fields: tuple[str, ...]) -> Column:
    return F.transform(found, lambda e: F.struct(*[e.getField(f).alias(f) for f in fields]))


def _clusters(placed: Column) -> Column:
    """ARRAY<ARRAY> of candidates in the order of their starts: one ends where the next begins after all before have ended."""
    until = running(F.transform(placed, lambda e: e.end), -1, lambda a, b: F.greatest(a, b))
    first = let(until, lambda u: F.array_compact(F.transform(placed, lambda e, i: F.when(e.start >= F.get(u, i), i))))
    return let(first, lambda at: F.transform(at, lambda b, i: F.slice(placed, b + 1, F.coalesce(F.get(at, i + 1), F.size(placed)) - b)))


def resolve(found: Column) -> Column:
    """The candidates that remain, longest first, then most confident, then in the order of the patterns and of the text;
    one that shares a character with a kept one goes.

    Candidates are judged in clusters of overlapping ones, so the work grows with their number.
    """
    placed = F.sort_array(F.transform(found, lambda e: F.struct(
        e.start.alias("start"), e.end.alias("end"), (e.start - e.end).alias("k1"), (-e.confidence).alias("k2"), e.order.alias("k3"), e.text.alias("text"),
        e.entity_type.alias("entity_type"), e.confidence.alias("confidence"), e.source.alias("source"))))
    none = F.array().cast(f"array<{_RANKED}>")

    def judged(cluster: Column) -> Column:
        """Of one cluster what is kept; most clusters are single."""
        ranked = _in_order(cluster, _BY_RANK)
        return F.when(F.size(cluster) < 2, ranked).otherwise(F.aggregate(F.sort_array(ranked), none, lambda kept, e: F.when(
            F.exists(kept, lambda k: (k.start < e.end) & (e.start < k.end)), kept).otherwise(F.concat(kept, F.array(e)))))

    # a handful of candidates is one cluster: the same result without looking for the places where nothing overlaps
    return let(placed, lambda p: F.when(F.size(p) <= _FEW, judged(p)).otherwise(F.sort_array(F.flatten(F.transform(_clusters(p), judged)))))


def extract(text: Column, conf: EngineConf | None = None, vocabulary: Gazetteers | None = None) -> Column:
    """ARRAY<STRUCT> of the entities of a text, by start and then longest first. Confidence is filtered after overlaps
    are resolved, and the limit keeps the longest."""
    conf = conf or EngineConf()
    kept = F.slice(F.filter(resolve(candidates(text, vocabulary)), lambda e: e.confidence >= conf.confidence_threshold), 1, conf.max_entities_per_text)
    placed = F.sort_array(F.transform(kept, lambda e: F.struct(e.start.alias("start"), (-e.end).alias("k"), e.end.alias("end"), e.text.alias("text"),
                                                               e.entity_type.alias("entity_type"), e.confidence.alias("confidence"), e.source.alias("source"))))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.transform(placed, lambda e: F.struct(e.text.alias("text"), e.entity_type.alias("entity_type"), e.start.alias("start"), e.end.alias("end"),
                                                  e.confidence.alias("confidence"), e.source.alias("source"), none.alias("metadata")))


def with_entities(notes: DataFrame, text: str = "text", conf: EngineConf | None = None, vocabulary: Gazetteers | None = None) -> DataFrame:
    return notes.withColumn("entities", extract(F.col(text), conf, vocabulary))


def entity_rows(with_entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, entity_no, text, entity_type, start_pos, end_pos, confidence, source): the entities as a table."""
    rows = exploded(with_entities, key, F.col("entities"), "entity_no")
    return rows.select(key, "entity_no", "x.text", "x.entity_type", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"), "x.confidence", "x.source")


def gazetteer_join(notes: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, entity_type, start_pos, end_pos) of the terms of a vocabulary table (term, entity_type) of any size.

    Each word of a text meets the terms that begin with it in one equi-join, which Spark broadcasts if the vocabulary's
    size allows; the words that follow are compared after it. A row of a word carries the words up to the length of the
    longest term and not the text. Terms of any number of words are found.
    """
    runs = lambda c: F.regexp_extract_all(c, F.lit(f"({WORD}+)"), F.lit(1))
    begun = vocabulary.select("term", "entity_type", F.get(runs(F.col("term")), F.lit(0)).alias("first"), F.size(runs(F.col("term"))).alias("n"))
    most = begun.agg(F.coalesce(F.max("n"), F.lit(0)).alias("__most"))  # one row
    words = notes.select(F.col(key).alias("__key"), F.col(text).alias("__t"), spans(F.col(text), rf"{WORD}+").alias("w")).crossJoin(F.broadcast(most))

    def ahead(a: Column, i: Column) -> Column:
        return let(F.transform(F.slice(F.col("w"), i + 1, F.col("__most")), lambda b: b.end), lambda ends: F.struct(
            F.lower(a.text).alias("first"), a.start.alias("start"), ends.alias("ends"), F.substring(F.col("__t"), a.start + 1, F.element_at(ends, -1) - a.start).alias("lead")))

    rows = words.where("__most > 0").select("__key", F.explode_outer(F.transform("w", ahead)).alias("g")).select("__key", "g.*")
    met = rows.join(begun, "first").withColumn("end", F.get("ends", F.col("n") - 1))
    own = F.substring(F.col("lead"), F.lit(1), F.col("end") - F.col("start"))
    return met.where(F.lower(own) == F.col("term")).select(F.col("__key").alias(key), own.alias("text"), "entity_type", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


def vocabulary_table(spark: SparkSession, vocabulary: Gazetteers | None = None) -> DataFrame:
    return spark.createDataFrame([(t, kind) for kind, words in (vocabulary or Gazetteers()).by_type() for t in words], "term string, entity_type string")


def stats(entities: Column) -> Column:
    """STRUCT<total, by_type, avg_confidence>: counts of all types, also of those without entity; no types when empty."""
    kinds = F.array(*[F.lit(k) for k, *_ in ENTITY_TYPES])
    counts = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(entities, lambda e: e.entity_type == k))))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    mean = F.aggregate(entities, F.lit(0.0), lambda s, e: s + e.confidence) / F.size(entities)
    return F.struct(F.size(entities).alias("total"), F.when(F.size(entities) > 0, counts).otherwise(none).alias("by_type"),
                    F.when(F.size(entities) > 0, mean).otherwise(0.0).alias("avg_confidence"))


def type_table(spark: SparkSession) -> DataFrame:
    """(entity_type, ordinal, label_pt, label_en, color, fhir_resource)."""
    return spark.createDataFrame([(k, i, pt, en, c, f) for i, (k, pt, en, c, f) in enumerate(ENTITY_TYPES)],
                                 "entity_type string, ordinal int, label_pt string, label_en string, color string, fhir_resource string")


def labelled(entities: DataFrame) -> DataFrame:
    """Entities with labels and colour; an unknown type is its own label."""
    dim = type_table(entities.sparkSession).select("entity_type", "label_pt", "label_en", "color")
    joined = entities.join(F.broadcast(dim), "entity_type", "left")  # five rows
    return joined.withColumns({"label_pt": F.coalesce("label_pt", "entity_type"), "label_en": F.coalesce("label_en", "entity_type"), "color": F.coalesce("color", F.lit(DEFAULT_COLOR)),
                               "label": F.concat(F.lit("["), "entity_type", F.lit("] "), "text")})
