"""Pieces of ranker training and evaluation: samples, targets, losses, rerankers, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def tuple_ranking_loss(best: Column, second: Column, negative: Column) -> Column:
    """Best above a negative counts fully; best above second, and second above the negative, by half."""
    return softplus(negative - best) + 0.5 * softplus(second - best) + 0.5 * softplus(negative - second)


def smooth_l1(x: Column, y: Column) -> Column:
    d = F.abs(x - y)
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def max_normalised(scores: Column, limit: float) -> Column:
    """Scores cut at the limit, as shares of the largest."""
    cut = F.transform(scores, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(limit)))
    return F.transform(cut, lambda x: x / F.greatest(F.array_max(cut), F.lit(1e-12)))


def chunked_log_sum_exp(scores: Column, chunk: int, n: int) -> Column:
    """The log of a sum of exponentials over chunks: each chunk's maximum and sum join the ones before."""

    def step(s: Column, i: Column) -> Column:
        part = F.slice(scores, i + 1, F.lit(chunk))
        m = F.greatest(s["m"], F.array_max(part))
        return F.struct(m.alias("m"), (s["s"] * F.exp(s["m"] - m) + total(F.transform(part, lambda x: F.exp(x - m)))).alias("s"))

    start = F.struct(F.lit(-1e300).alias("m"), F.lit(0.0).alias("s"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1), F.lit(chunk)), start, step, lambda s: s["m"] + F.log(s["s"] + 1e-12))


def sampled_negatives(key: Column, classes: int, positives: list[Column], keep: int, seed: int) -> Column:
    """`keep` classes in a seeded random order; positives come last and only fill up."""
    place = lambda i: F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string")))
    is_positive = lambda i: sum(((i == F.coalesce(p.cast("int"), F.lit(-1))).cast("int") for p in positives), F.lit(0)) > 0
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.struct(is_positive(i).alias("positive"), place(i).alias("h"), i.alias("i"))))
    return F.transform(F.slice(order, 1, keep), lambda x: F.struct(x["i"].cast("long").alias("i"), (~x["positive"]).alias("valid")))


def positive_pool(labels: DataFrame) -> DataFrame:
    """labels(best, second) -> the distinct classes that are best or second somewhere."""
    return labels.select(F.explode(F.array("best", "second")).alias("class")).where("class is not null").distinct()


def fnv1a(bytes_: Column) -> Column:
    """FNV-1a of 64 bits over an array of byte values, as (hi, lo) halves: products stay within a long."""
    mask = (1 << 32) - 1

    def step(s: Column, b: Column) -> Column:
        lo = s["lo"].bitwiseXOR(b.cast("long"))
        low = lo * 435
        # The prime is 2^40 + 435; 2^40 times the low half reaches the high one moved by eight bits.
        hi = s["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(lo, 8)
        return F.struct(hi.bitwiseAND(F.lit(mask)).alias("hi"), low.bitwiseAND(F.lit(mask)).alias("lo"))

    return F.aggregate(bytes_, F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo")), step)


def byte_values(text: Column) -> Column:
    """UTF-8 bytes as numbers."""
    code = F.hex(F.encode(text, "utf-8"))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(text) - 1, F.lit(0))), lambda i: F.conv(F.substring(code, 2 * i + 1, 2), 16, 10).cast("long"))


def budgeted(groups: list[tuple[str, list[str]]], most: int) -> list[tuple[str, str]]:
    """(group, column) of all groups by priority, doubles kept, up to a number of columns."""
    return [(g, c) for g, columns in groups for c in columns][:most]


def trial_grid(architectures: DataFrame, features: DataFrame) -> DataFrame:
    """(trial, arch, feature): every pair of two small lists, architectures running fastest."""
    pairs = features.join(F.broadcast(architectures))  # both are lists of a configuration
    return pairs.withColumn("trial", F.row_number().over(Window.orderBy("feature", "arch")) - 1)


def cheapest_prefix(candidates: DataFrame, group: str, order: list[str], bits: str, sizes: list[int], cost: float) -> DataFrame:
    """(k, cost): for each beam size the mean bits of the best of a group's first k candidates and the cost of trying k."""
    ranked = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    best = ranked.groupBy(group).agg(*(F.min(F.when(F.col("_n") <= k, F.col(bits))).alias(f"_{k}") for k in sizes))
    one = best.agg(*((F.avg(f"_{k}") + cost * k).alias(f"_{k}") for k in sizes))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"_{k}").alias("cost")) for k in sizes))).alias("c")).select("c.*")
