"""Ranking within a row: top-k with ties, beams over heads, priors, soft targets, losses.

Scores of a row's heads are arrays in the row, so a beam is built where the row is: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def scored(scores: str | Column) -> Column:
    """[(score, id)] of an array of scores."""
    return F.transform(scores, lambda x, i: F.struct(x.cast("double").alias("s"), i.cast("long").alias("i")))


def top_k(scores: str | Column, k: int) -> Column:
    """Ids of the k largest scores, ties to the smaller id."""
    order = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x.cast("double")).alias("s"), i.cast("long").alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda t: t["i"])


def top_k_soft(scores: str | Column, k: int) -> Column:
    """The variant that adds (classes - id) * 1e-6 to each score, which can reorder scores closer than that."""
    n = F.size(scores)
    return top_k(F.transform(scores, lambda x, i: x.cast("double") + (n - i) * 1e-6), k)


def k_smallest(values: str | Column, k: int) -> Column:
    order = F.array_sort(F.transform(values, lambda x, i: F.struct(x.cast("double").alias("s"), i.cast("long").alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda t: t["i"])


def near_best(scores: str | Column, k: int, margin: float) -> Column:
    """Ids within a margin of the best, then ids of the overall order until there are k (repeats possible)."""
    order = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x.cast("double")).alias("s"), i.cast("long").alias("i"))))
    best = F.array_max(F.transform(scores, lambda x: x.cast("double")))
    ids = lambda a: F.transform(a, lambda t: t["i"])
    return F.slice(F.concat(ids(F.filter(order, lambda t: -t["s"] >= best - margin)), ids(order)), 1, k)


def log_softmax(scores: str | Column) -> Column:
    s = F.transform(scores, lambda x: x.cast("double"))
    best = F.array_max(s)
    total = F.log(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - best)))
    return F.transform(s, lambda x: x - best - total)


def beam(rows: DataFrame, key: str, heads: dict[str, tuple[str, int]], keep: int, soft: bool = False) -> DataFrame:
    """The `keep` best tuples of each row: (key, rank from 1, tuple_rank, score).

    Each head (predictor, cf_perm, cf_primary, cf_secondary, reorder, interleave) gives its top few
    classes; their cross product (bounded by the widths) is scored by the sum. Ties go to the smaller
    tuple rank; `soft` adds (12287 - rank) * 1e-6 to the score instead, as a tie-break that can
    reorder close scores. Each stage explodes in the row, and only ids and scores move on.
    """
    def first(scores: str, k: int) -> Column:
        return F.transform(top_k(scores, k), lambda i: F.struct(i.alias("i"), F.get(F.col(scores), i.cast("int")).cast("double").alias("s")))

    def crossed(tuples: Column, head: str) -> Column:
        return F.flatten(F.transform(tuples, lambda t: F.transform(F.col(head), lambda a: F.struct(F.concat(t["ids"], F.array(a["i"])).alias("ids"), (t["s"] + a["s"]).alias("s")))))

    out = rows.select(key, *(first(scores, k).alias(h) for h, (scores, k) in heads.items()))
    lists = list(heads)
    tuples = F.transform(F.col(lists[0]), lambda a: F.struct(F.array(a["i"]).alias("ids"), a["s"].alias("s")))
    for h in lists[1:]:
        tuples = crossed(tuples, h)

    def ranked(t: Column) -> Column:
        p, perm, one_, two, r, i = (t["ids"][n] for n in range(6))
        return S.tuple_rank(p, S.join_filter(perm, one_, two), r, i)

    bonus = (lambda r: (12287 - r) * 1e-6) if soft else (lambda r: F.lit(0.0))
    entries = F.transform(tuples, lambda t: F.struct((-(F.round(t["s"], 9) + bonus(ranked(t)))).alias("o"), ranked(t).alias("r"), t["s"].alias("s")))
    best = F.slice(F.array_sort(entries), 1, keep)
    return out.select(key, F.posexplode(best).alias("n", "t")).select(key, (F.col("n") + 1).cast("long").alias("rank"), F.col("t.r").alias("tuple_rank"), F.col("t.s").alias("score"))


def bits_prior(bits: str | Column, temperature: float) -> Column:
    """-(bits - least) / temperature."""
    low = F.array_min(bits)
    return F.transform(bits, lambda b: -(b - low) / temperature)


def energy_prior(energies: str | Column, temperature: float) -> Column:
    return F.transform(energies, lambda e: -F.log1p(F.greatest(e, F.lit(0.0)) + 1e-6) / temperature)


def soft_targets(best: Column, second: Column, temperature: float) -> tuple[Column, Column]:
    """Weights 1 and exp(-max(0, second - best) / T), normalised; a missing second has none."""
    w = F.when(second.isNull(), F.lit(0.0)).otherwise(F.exp(-F.greatest(F.lit(0.0), (second - best).cast("double")) / temperature))
    return 1 / (1 + w), w / (1 + w)


def soft_targets_absolute(best: Column, second: Column, temperature: float) -> tuple[Column, Column]:
    """exp(-bits / T) of each, the sum 1e-12 at least (so large bits give weights near 0)."""
    a = F.exp(-best.cast("double") / temperature)
    b = F.when(second.isNull(), F.lit(0.0)).otherwise(F.exp(-second.cast("double") / temperature))
    total = F.greatest(a + b, F.lit(1e-12))
    return a / total, b / total


def smoothed(best: Column, second: Column, classes: int, epsilon: float) -> Column:
    """Label smoothing: the best alone, or half and half with another second, over a floor of epsilon / classes."""
    both = second.isNotNull() & (second != best)
    hit = lambda i: F.when(both & ((i == best) | (i == second)), 0.5).when(~both & (i == best), 1.0).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (1 - epsilon) * hit(i) + epsilon / classes)


def soft_cross_entropy(scores: str | Column, best: Column, second: Column, w_best: Column, w_second: Column) -> Column:
    lp = log_softmax(scores)
    at = lambda i: F.get(lp, i.cast("int"))
    return -(w_best * at(best) + F.when(second.isNull(), F.lit(0.0)).otherwise(w_second * at(second)))
