"""Operators on tables of candidate settings: argmin with ties, projected minima, pruning, ranks.

All are partial aggregates or windows within a block, so a table of any size shuffles once on the
block key, and only the columns in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def best_second(cand: DataFrame, key: str, keep: int = 2) -> DataFrame:
    """The `keep` tuples of least (bits, tuple_rank) a block, of each tuple its least bits: (key, tuple_rank, bits, rn)."""
    least = cand.groupBy(key, "tuple_rank").agg(F.min("bits").alias("bits"))
    w = Window.partitionBy(key).orderBy("bits", "tuple_rank")
    return least.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).select(key, "tuple_rank", "bits", F.col("rn").cast("long").alias("rn"))


def label_records(best: DataFrame, key: str) -> DataFrame:
    """One row a block from the ranks 1 and 2 of best_second."""
    at = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    rows = best.groupBy(key).agg(at(1, "tuple_rank").alias("b"), at(1, "bits").alias("best_bits"), at(2, "tuple_rank").alias("s"), at(2, "bits").alias("second_bits"))
    out = [F.col(key), F.col("b"), F.col("s"), "best_bits", "second_bits"]
    for side, rank in (("best", "b"), ("second", "s")):
        parts = S.split_rank(rank)
        code = parts.pop("filter_code")
        parts |= {"filter_code": code, "cf_perm": S.filter_perm(code), "cf_primary": S.filter_primary(code), "cf_secondary": S.filter_secondary(code)}
        out += [c.cast("long").alias(f"{side}_{n}") for n, c in parts.items()]
    return rows.select(*out)


def projected_minima(cand: DataFrame, key: str, heads: dict[str, tuple[Column, int]]) -> DataFrame:
    """(key, head, class, bits): the least bits with each class of each head (column, classes): one aggregate a block, then rows of what was met."""
    least = {(h, v): F.min(F.when(c == v, F.col("bits"))).alias(f"_{h}_{v}") for h, (c, n) in heads.items() for v in range(n)}
    pairs = F.array(*(F.struct(F.lit(h).alias("head"), F.lit(v).cast("long").alias("class"), F.col(f"_{h}_{v}").alias("bits")) for h, v in least))
    return cand.groupBy(key).agg(*least.values()).select(key, F.explode(pairs).alias("p")).where("p.bits is not null").select(key, "p.*")


def conditional_minima(cand: DataFrame, key: str, by: str, values: int, when: str) -> DataFrame:
    """One row a block with a column of least bits for each value of `by`, split by a 0/1 column; -1 where there is none."""
    return cand.groupBy(key).agg(*(F.coalesce(F.min(F.when((F.col(by) == v) & (F.col(when) == w), F.col("bits"))), F.lit(-1).cast("long")).alias(f"{by}{v}_{when}{w}") for w in (0, 1) for v in range(values)))


def top_predictors_minima(cand: DataFrame, key: str, keep: int = 2) -> DataFrame:
    """Predictors by (least energy, number); of the first `keep` the least bits of each filter. One shuffle, by block, serves all steps."""
    rows = cand.select(key, "predictor", "filter_code", "energy", "bits").repartition(key)
    rows = rows.withColumn("least", F.min("energy").over(Window.partitionBy(key, "predictor")))
    rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy(key).orderBy("least", "predictor"))).where(F.col("place") <= keep)
    return rows.groupBy(key, "filter_code").agg(F.min("bits").alias("bits"))


def pruned(cand: DataFrame, key: str, order: list[str], factor: float = 1.3) -> DataFrame:
    """Trials whose energy is at most `factor` times the least before them; the first always stays."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cand.withColumn("least_before", F.min("energy").over(before)).where(F.col("least_before").isNull() | (F.col("energy") <= factor * F.col("least_before")))


def prefix_hits(ranked: DataFrame, key: str, order: list[str], match: Column) -> DataFrame:
    """Each row's rank within its block and whether a match is among the rows up to it."""
    w = Window.partitionBy(key).orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("hit", F.max(match.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
