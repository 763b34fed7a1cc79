"""Items that appear together: exact pair counts against chance.

Chance is the bipartite configuration null: item i and basket k meet with probability x_i y_k / (1 + x_i y_k), fitted so
that every item keeps its frequency and every basket its size in expectation. Items of one frequency share x and baskets
of one size share y, so the fit runs over two histograms. The baskets that hold both items of a pair follow a
Poisson-binomial law; its upper tail (saddlepoint approximation, continuity corrected) is the p-value, and the
Benjamini-Hochberg step-up over all pairs of items controls the false discoveries.

Exact pruning before any pair is built: a pair counts at most as often as its rarer item, so items under ``least``
baskets are in no reported pair; with a wanted ratio, n_ab n / (n_a n_b) <= n / max(n_a, n_b), so items over n / ratio are
in none either. What is left is joined by basket, large baskets in blocks; the pairs of one task are combined before
they are shuffled.

Defined results: null types, null baskets and null texts are left out; items are stripped of white space and
lower-cased, an empty text is an item; an item counts once a basket; an empty table gives no pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notaflux.cluster import cut
from notaflux.functions.folding import strip_space

_GROUP = 20_000  # distinct profiles of a group that is judged at once


def baskets(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (kind, basket, item): the entity texts that are source or target of a relation of one kind in one note."""
    ends = relations.where(F.col("relation_type").isNotNull() & F.col("note_id").isNotNull()).select(
        F.col("relation_type").alias("kind"), F.col("note_id").alias("basket"), F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id"))
    named = entities.where(F.col("text").isNotNull()).select("entity_id", F.lower(strip_space(F.col("text"))).alias("item")).distinct()
    return ends.distinct().join(named, "entity_id").select("kind", "basket", "item").distinct()


def _numbered(items: DataFrame, least: int, ratio: float) -> tuple[DataFrame, DataFrame]:
    """Items that can be in a reported pair (kind, item, no, n_item, n), written once so that their numbers stay, and the
    baskets of those items (kind, basket, no)."""
    per_item = items.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n_item"))
    totals = items.groupBy("kind").agg(F.count_distinct("basket").alias("n"))  # a row per kind
    kept = per_item.join(F.broadcast(totals), "kind").where((F.col("n_item") >= least) & (F.col("n_item") * ratio <= F.col("n")))
    kept = cut(kept.withColumn("no", F.monotonically_increasing_id()))
    return kept, items.join(kept.select("kind", "item", "no"), ["kind", "item"]).select("kind", "basket", "no")


def halves(members: DataFrame, keys: list[str], member: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join that lets the members of each group (``keys``) meet, on ``keys``, low and high.

    Groups of more than ``block`` members are dealt out in blocks and every two blocks meet under a key of their own; two
    members of one block meet both ways round, two of different blocks once. Few groups are that large; the others keep
    one block and one key.
    """
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > block)
    blocks = F.ceil(F.coalesce(F.col("__size"), F.lit(1)) / block).cast("int")
    dealt = members.join(sizes, keys, "left").withColumn("__blocks", blocks).withColumn("__own", F.pmod(F.xxhash64(member), F.col("__blocks")).cast("int"))
    plain = members.columns
    a = dealt.select(*plain, F.col("__own").alias("low"), F.explode(F.sequence("__own", F.col("__blocks") - 1)).alias("high"))
    return a, dealt.select(*plain, F.explode(F.sequence(F.lit(0), "__own")).alias("low"), F.col("__own").alias("high"))


def pair_counts(items: DataFrame, least: int = 1, ratio: float = 0.0, block: int = 512) -> DataFrame:
    """(kind, a, b; a < b, n_ab, n_a, n_b, n) of the pairs in at least ``least`` baskets and with at least ``ratio`` times chance.

    Pairs are built from numbers and get their texts when they are counted. A basket of more than ``block`` items is
    dealt out in blocks, and every two blocks meet under a key of their own, so no task pairs a whole large basket.
    """
    kept, slim = _numbered(items, least, ratio)
    a, b = halves(slim, ["kind", "basket"], "no", block)
    a, b = a.withColumnRenamed("no", "a"), b.withColumnRenamed("no", "b")
    met = a.join(b, ["kind", "basket", "low", "high"]).where((F.col("a") < F.col("b")) | (F.col("low") < F.col("high")))
    both = met.groupBy("kind", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= least)
    of = lambda no, end: kept.select(F.col("no").alias(no), F.col("item").alias(f"t_{end}"), F.col("n_item").alias(f"n_{end}"), *(["n"] if end == "x" else []))
    counted = both.join(of("x", "x"), "x").join(of("y", "y"), "y")
    # in whole numbers where the ratio is one, so that a bound is met exactly
    counted = counted.where(F.col("n_ab") * F.col("n") >= F.lit(ratio) * F.col("n_x") * F.col("n_y"))
    first = F.col("t_x") < F.col("t_y")
    way = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return counted.select("kind", way("t_x", "t_y").alias("a"), way("t_y", "t_x").alias("b"), "n_ab", way("n_x", "n_y").alias("n_a"), way("n_y", "n_x").alias("n_b"), "n")


def fit_null(
    degree: np.ndarray, items: np.ndarray, size: np.ndarray, n_baskets: np.ndarray, rounds: int = 2000, tolerance: float = 1e-9, cells: int = 1 << 20,
) -> tuple[np.ndarray, np.ndarray, float]:
    """x by item frequency, y by basket size, and the largest relative error of the frequencies and sizes that they keep
    in expectation (fixed-point iteration, ended by ``tolerance``). Distinct frequencies meet distinct sizes ``cells`` at
    a time, so memory does not grow with their product."""
    total = float((degree * items).sum()) or 1.0
    x, y = degree / np.sqrt(total), size / np.sqrt(total)
    step = max(1, cells // max(1, len(size)))

    def kept(x: np.ndarray, y: np.ndarray, of_items: bool) -> np.ndarray:
        out = np.zeros(len(x) if of_items else len(y))
        for at in range(0, len(x), step):
            p = np.outer(x[at : at + step], y)
            p /= 1 + p
            if of_items:
                out[at : at + step] = p @ n_baskets
            else:
                out += items[at : at + step] @ p
        return out

    error = np.inf if len(degree) and len(size) else 0.0
    for _ in range(rounds):
        if error <= tolerance:
            break
        got = kept(x, y, True)
        x = x * np.divide(degree, got, out=np.ones_like(got), where=got > 0)
        held = kept(x, y, False)
        off = np.divide(size, held, out=np.ones_like(held), where=held > 0)
        y = y * off
        error = float(max(np.abs(off - 1).max(), np.abs(got / degree - 1).max()))
    return x, y, error


def log_tail(seen: np.ndarray, chance: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, natural log of P(X >= seen)) of sums of Binomial(times_k, chance_ik), one row i for each pair.

    Lugannani-Rice saddlepoint for seen over the mean, with the lattice correction; 0 (P = 1) is not exceeded.
    """
    chance = np.clip(chance, 0.0, 1 - 1e-12)
    mean = (chance * times).sum(1)
    k = np.maximum(seen.astype(float), 0)
    most = (times * (chance > 0)).sum(1)
    s = np.log(np.maximum(k, 0.5) / np.maximum(mean, 1e-300))
    for _ in range(60):
        e = chance * np.exp(np.minimum(s, 60))[:, None]
        q = e / (1 - chance + e)
        k1, k2 = (times * q).sum(1), (times * q * (1 - q)).sum(1)
        step = np.clip((k1 - np.minimum(k, most - 0.5)) / np.maximum(k2, 1e-12), -2, 2)
        s = s - step
        if np.all(np.abs(step) < 1e-10):
            break
    e = chance * np.expm1(np.minimum(s, 60))[:, None]
    k0 = (times * np.log1p(e)).sum(1)
    q = chance * np.exp(np.minimum(s, 60))[:, None] / (1 + e)
    k2 = np.maximum((times * q * (1 - q)).sum(1), 1e-12)
    w = np.sign(s) * np.sqrt(np.maximum(2 * (s * k - k0), 0))
    u = -np.expm1(-s) * np.sqrt(k2)
    safe = s > 1e-4
    log_phi = -0.5 * w * w - 0.5 * np.log(2 * np.pi)
    ws, us = np.where(safe, w, 1.0), np.where(safe, u, 1.0)
    # 1 - Phi(w) = phi(w) * mills(w)
    tail = _mills(ws) + (1 / us - 1 / ws)
    out = np.where(safe, log_phi + np.log(np.maximum(tail, 1e-300)), 0.0)
    return mean, np.minimum(out, 0.0)


def _mills(w: np.ndarray) -> np.ndarray:
    """(1 - Phi(w)) / phi(w) for w > 0: the series of the distribution function under 3, the continued fraction above;
    both to about 1e-10."""
    w = np.asarray(w, float)
    low = np.minimum(w, 3.0)
    term, total = low.copy(), low.copy()
    for k in range(1, 60):
        term = term * low * low / (2 * k + 1)
        total += term
    near = np.sqrt(np.pi / 2) * np.exp(low * low / 2) - total
    far = np.maximum(w, 3.0)
    tail = far.copy()
    for k in range(60, 0, -1):
        tail = far + k / tail
    return np.where(w < 3, near, 1 / tail)


_PROFILE = "kind string, n_ab bigint, n_a bigint, n_b bigint, expected double, log10_p double, all_items double, null_error double"


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    i, b = pdf[pdf.side == "item"].sort_values("v"), pdf[pdf.side == "basket"].sort_values("v")
    x, y, error = fit_null(i.v.to_numpy(float), i.c.to_numpy(float), b.v.to_numpy(float), b.c.to_numpy(float))
    return pd.DataFrame({"kind": pdf.kind.iloc[0], "degrees": [i.v.tolist()], "x": [x.tolist()], "y": [y.tolist()], "times": [b.c.tolist()], "all_items": float(i.c.sum()), "null_error": error})


def _judge(profiles: pd.DataFrame, null: pd.DataFrame) -> pd.DataFrame:
    """Tails of the distinct (n_ab, n_a, n_b) of one kind; some thousand cells of profiles and basket sizes at a time."""
    if not len(profiles):
        return pd.DataFrame({c: pd.Series(dtype=object if kind == "string" else float) for c, kind in (f.split() for f in _PROFILE.split(", "))})
    n = null.iloc[0]
    degrees, x, y, times = (np.asarray(n[c], float) for c in ("degrees", "x", "y", "times"))
    xa, xb, seen = (x[np.searchsorted(degrees, profiles.n_a)], x[np.searchsorted(degrees, profiles.n_b)], profiles.n_ab.to_numpy())
    mean, log_p = np.zeros(len(profiles)), np.zeros(len(profiles))
    step = max(1, (1 << 18) // max(1, len(y)))
    for at in range(0, len(profiles), step):
        fa, fb = (np.outer(v[at : at + step], y) for v in (xa, xb))
        mean[at : at + step], log_p[at : at + step] = log_tail(seen[at : at + step], fa / (1 + fa) * fb / (1 + fb), times)
    counts = {c: profiles[c].to_numpy() for c in ("n_ab", "n_a", "n_b")}
    kinds = np.full(len(profiles), str(n.kind), object)
    return pd.DataFrame({"kind": kinds, **counts, "expected": mean, "log10_p": log_p / np.log(10), "all_items": n.all_items, "null_error": n.null_error})


def surprise(items: DataFrame, least: int = 1, ratio: float = 0.0) -> DataFrame:
    """``pair_counts`` with expected, ratio, log10_p, q_bound (the least false-discovery rate at which the pair counts) and
    null_error (how far the fitted null is from the frequencies and sizes it has to keep).

    Tests are all pairs of items of a kind, met or not. Ranks come from counts per thousandth of log10 p, so the step-up
    is over a bounded table; a bin takes the rate of its upper end, which can only overstate q (by 0.23 per cent at most).
    With ``least`` or ``ratio`` ranks are among the pairs that are left, which overstates q too.

    A tail depends on the counts of a pair alone, so it is worked out once for each distinct (n_ab, n_a, n_b); these
    meet the null of their kind in groups, and neither they nor the pairs carry its arrays.
    """
    items = cut(items)
    pairs = cut(pair_counts(items, least, ratio))
    per_item = items.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("v")).groupBy("kind", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("side", F.lit("item"))
    per_basket = items.groupBy("kind", "basket").agg(F.count(F.lit(1)).alias("v")).groupBy("kind", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("side", F.lit("basket"))
    null = per_item.unionByName(per_basket).groupBy("kind").applyInPandas(_fit, "kind string, degrees array<bigint>, x array<double>, y array<double>, times array<bigint>, all_items double, null_error double")
    profiles = cut(pairs.groupBy("kind", "n_ab", "n_a", "n_b").agg(F.count(F.lit(1)).alias("pairs")))
    groups = 1 + profiles.count() // _GROUP  # one number
    dealt = profiles.withColumn("g", F.pmod(F.xxhash64("n_ab", "n_a", "n_b"), F.lit(groups)))
    everywhere = null.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    tails = cut(dealt.groupBy("kind", "g").cogroup(everywhere.groupBy("kind", "g")).applyInPandas(_judge, _PROFILE))
    on = ["kind", "n_ab", "n_a", "n_b"]
    binned = tails.join(profiles, on).withColumn("bin", F.ceil(F.greatest(F.col("log10_p"), F.lit(-400.0)) * 1000))

    def step_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        tests = pdf.all_items.iloc[0] * (pdf.all_items.iloc[0] - 1) / 2
        rate = tests * 10.0 ** (pdf.bin / 1000) / pdf.c.cumsum()
        return pdf[["kind", "bin"]].assign(q_bound=np.minimum(rate[::-1].cummin()[::-1], 1.0))

    rates = binned.groupBy("kind", "bin").agg(F.sum("pairs").alias("c"), F.first("all_items").alias("all_items")).groupBy("kind").applyInPandas(step_up, "kind string, bin bigint, q_bound double")
    judged = binned.join(rates, ["kind", "bin"]).select(*on, "expected", "log10_p", "q_bound", "null_error")
    return pairs.join(judged, on).select(
        "kind", "a", "b", "n_ab", "n_a", "n_b", "n", "expected", (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("ratio"), "log10_p", "q_bound", "null_error")
