"""Values typed freely, mapped to the entry of a canonical list that is meant, or reported as having none.

Distinct values only are matched. A value is normalised (case, accents, signs), rid of the remarks that people write
around values, cut into character 2- and 3-grams and looked up in an inverted index of the list; the index weighs each
gram by its rarity in the list, and candidates are scored by weighted cosine. The best is taken at or above ``threshold``
if no other candidate comes within ``margin`` of it; among candidates within the margin an exact edit distance over the
letters decides, if it singles out one that is near enough, else the value has no match. Below the threshold nothing is
taken.

Remarks are learnt and not listed: a word that is in no entry and stands in values beside many different words of the
list says nothing about which entry is meant.

The index is asked for a value's rarest grams first, and only for as many as an entry within the margin of the threshold
must share: entries that share none of them are below that by the Cauchy-Schwarz bound. So the long lists of common grams
are not read to find candidates; the candidates' scores are then completed from the other grams, and are exact.

Defined results: null values and null groups are left out; a value that equals an entry letter for letter maps to it;
an empty list gives no match for any value; entries of equal score and distance give no match, as nothing tells which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notaflux.cluster import cut
from notaflux.functions.folding import fold_accents

def normalised(value: Column) -> Column:
    """Folded letters and digits in single-spaced words."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(F.regexp_replace(value, "\\p{Cf}", ""))), "[^a-z0-9]+", " "))


def grams(folded: Column) -> Column:
    """The distinct 2- and 3-grams of the letters run together, with marks at both ends: word order and lost or doubled
    spaces change few of them."""
    joined = F.concat(F.lit("^"), F.regexp_replace(folded, " ", ""), F.lit("$"))
    size = F.length(joined)
    return F.array_distinct(F.concat(
        F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(joined, i, F.lit(2))),
        F.when(size > 2, F.transform(F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), lambda i: F.substring(joined, i, F.lit(3)))).otherwise(F.array().cast("array<string>")),
    ))


def remarks(values: DataFrame, listed: DataFrame, share: float, least: int) -> DataFrame:
    """(g, word) of the remark words of values (g, v): words of no entry (g, name) that stand beside at least ``share`` of
    the words of the list, and ``least`` of them."""
    word = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("word")
    entry_words = listed.select("g", word("name")).distinct()
    enough = entry_words.groupBy("g").agg(F.greatest(F.lit(least), F.ceil(F.count(F.lit(1)) * share)).alias("enough"))  # a row per group
    words = values.select("g", "v", word("v")).join(entry_words.withColumn("known", F.lit(True)), ["g", "word"], "left")
    beside = words.groupBy("g", "v").agg(F.collect_set(F.when(F.col("known"), F.col("word"))).alias("known"), F.collect_set(F.when(F.col("known").isNull(), F.col("word"))).alias("odd"))
    met = beside.where(F.size("known") > 0).select("g", F.explode("odd").alias("word"), "known").select("g", "word", F.explode("known").alias("by")).distinct()
    return met.groupBy("g", "word").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(enough), "g").where("n >= enough").select("g", "word")


def _cleaned(distinct: DataFrame, listed: DataFrame, share: float, least: int) -> DataFrame:
    """(g, raw, v) with v the value without remarks; a value of remarks alone stays as it is."""
    folded = cut(distinct.withColumn("full", normalised(F.col("raw"))))
    plain = folded.where("full <> ''").select("g", F.col("full").alias("v")).distinct()
    said = remarks(plain, listed, share, least)
    words = plain.select("g", "v", F.posexplode(F.split("v", " ")).alias("at", "word"))
    left = words.join(said, ["g", "word"], "left_anti").groupBy("g", "v").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    bare = left.select("g", F.col("v").alias("full"), F.array_join("words.word", " ").alias("bare"))
    return folded.join(bare, ["g", "full"], "left").select("g", "raw", F.coalesce("bare", "full").alias("v"))


def match_list(
    values: DataFrame, entries: DataFrame, value: str = "text", group: str = "entity_type", entry_id: str = "term_id", entry: str = "term",
    threshold: float = 0.3, margin: float = 0.1, edits: float = 0.2, remark_share: float = 0.1, remark_least: int = 5,
) -> DataFrame:
    """(group, value, entry_id or null, score, margin, edits, candidates) for each distinct (group, value) of ``values``.

    ``threshold``: the least cosine; ``margin``: how far behind the next candidate must be; ``edits``: among candidates
    within the margin, the share of its letters (two letters at least) by which the nearest may differ. ``candidates``
    counts those within the margin.
    """
    listed = entries.select(F.col(group).alias("g"), F.col(entry_id).alias("id"), normalised(F.col(entry)).alias("name")).where("g is not null and name <> ''").dropDuplicates(["g", "id"])
    index, unseen = _index(listed)

    distinct = values.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("raw")).distinct()
    cleaned = cut(_cleaned(distinct, listed, remark_share, remark_least))
    # an entry within the margin of one at the threshold is a rival, so candidates are complete down to there
    scored = _scores(cleaned.where("v <> ''").select("g", "v").distinct(), index, unseen, threshold - margin)
    top = F.max("score").over(W.partitionBy("g", "v"))
    near = scored.withColumn("top", top).where((F.col("top") >= threshold) & (F.col("score") > F.col("top") - margin))
    letters = lambda c: F.regexp_replace(c, " ", "")
    ordered = lambda c: F.array_join(F.array_sort(F.split(c, " ")), "")
    edited = F.least(F.levenshtein(letters(F.col("v")), letters(F.col("name"))), F.levenshtein(ordered(F.col("v")), ordered(F.col("name"))))
    minus = (-F.col("score")).alias("minus")
    best = near.withColumn("edits", edited).groupBy("g", "v").agg(
        F.min(F.struct("edits", minus, "id", "name")).alias("closest"),
        F.min(F.struct("edits", minus, (-F.col("id")).alias("other"))).alias("last"),
        F.max("score").alias("score"), F.min("score").alias("low"), F.count(F.lit(1)).alias("near"),
    )
    tie = F.col("closest.id") != -F.col("last.other")
    few = F.col("closest.edits") <= F.greatest(F.lit(2), F.floor(F.length(letters(F.col("closest.name"))) * edits))
    chosen = best.select(
        "g", "v", F.when((F.col("near") == 1) | few & ~tie, F.col("closest.id")).alias("id"), "score", (F.col("score") - F.col("low")).alias("margin"), F.col("closest.edits").alias("edits"), F.col("near").alias("candidates"))
    return cleaned.join(chosen, ["g", "v"], "left").select(
        F.col("g").alias(group), F.col("raw").alias(value), F.col("id").alias(entry_id), "score", "margin", "edits", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def _scores(plain: DataFrame, index: DataFrame, unseen: DataFrame, threshold: float) -> DataFrame:
    """(g, v, id, name, score) of every entry whose cosine with a value is ``threshold`` or more; found through the rare
    grams of the value, without one of which no entry can reach it."""
    numbered = cut(plain.withColumn("no", F.monotonically_increasing_id()))  # what is shuffled carries numbers, not texts
    weights = index.select("g", "gram", "w2").distinct()
    of_value = F.sum("w2").over(W.partitionBy("no"))
    so_far = F.sum("w2").over(W.partitionBy("no").orderBy(F.desc("w2"), "gram").rowsBetween(W.unboundedPreceding, W.currentRow))
    grammed = numbered.select("no", "g", F.explode(grams(F.col("v"))).alias("gram")).join(weights, ["g", "gram"], "left").join(F.broadcast(unseen), "g")  # a row per group
    # what is left after the rare grams weighs less than threshold^2 of the whole: |rest| |entry| < threshold |value| |entry|
    ranked = cut(grammed.select("no", "g", "gram", F.col("w2").isNotNull().alias("listed"), F.coalesce("w2", "unseen").alias("w2")).withColumn("all", of_value).withColumn(
        "rare", F.col("all") - so_far + F.col("w2") >= F.col("all") * threshold * threshold * (1 - 1e-9)).where("listed").select("no", "g", "gram", "w2", "all", "rare"))
    found = ranked.where("rare").join(index.select("g", "gram", "id", "norm"), ["g", "gram"]).groupBy("no", "id", "norm", "all").agg(F.sum("w2").alias("dot"))
    # an entry that cannot reach the threshold with all the rest of the value is left
    rest = ranked.where("not rare").groupBy("no").agg(F.sum("w2").alias("rest"))
    whole = F.sqrt("all") * F.col("norm")
    open_ = found.join(rest, "no", "left").where((F.col("dot") + F.coalesce("rest", F.lit(0.0))) >= threshold * whole * (1 - 1e-9)).drop("rest")
    more = ranked.where("not rare").select("no", "g", "gram").join(open_.select("no", "id"), "no").join(index.select("g", "gram", "id", "w2"), ["g", "gram", "id"]).groupBy("no", "id").agg(F.sum("w2").alias("more"))
    scored = open_.join(more, ["no", "id"], "left").select("no", "id", F.round((F.col("dot") + F.coalesce("more", F.lit(0.0))) / whole, 9).alias("score")).where(F.col("score") >= threshold)
    return scored.join(numbered, "no").join(index.select("g", "id", "name").distinct(), ["g", "id"]).select("g", "v", "id", "name", "score")


def _index(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverted index (g, gram, w2, id, name, norm), written once, and (g, unseen): the weight of a gram that no entry
    of the group holds."""
    sizes = listed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    posted = listed.select("g", "id", "name", F.explode(grams(F.col("name"))).alias("gram"))
    rarity = posted.groupBy("g", "gram").agg(F.count(F.lit(1)).alias("df")).join(sizes, "g").select("g", "gram", F.pow(F.log(1 + F.col("n") / F.col("df")), F.lit(2)).alias("w2"))
    weighed = cut(posted.join(rarity, ["g", "gram"]))
    norms = weighed.groupBy("g", "id").agg(F.sqrt(F.sum("w2")).alias("norm"))
    return cut(weighed.join(norms, ["g", "id"])), cut(sizes.select("g", F.pow(F.log(1 + F.col("n")), F.lit(2)).alias("unseen")))
