"""Statistics of dimensions and classes: scalers, entropies, baselines, folds over trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(vectors: DataFrame, key: str, values: str) -> DataFrame:
    """(key, dim from 0, x double)."""
    rows = vectors.select(key, F.posexplode(values).alias("dim", "x"))
    return rows.select(key, F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


def moments(dims: DataFrame) -> DataFrame:
    """Mergeable state of each dimension: count, sum and sum of squares; a partial aggregate."""
    return dims.groupBy("dim").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))


def sample_scaler(m: DataFrame) -> DataFrame:
    """Mean and sample deviation; variance is 1 for one row, 1e-12 at least; a deviation below 1e-6 becomes 1."""
    mean = F.col("s") / F.col("n")
    var = F.when(F.col("n") > 1, F.greatest(F.lit(1e-12), (F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1))).otherwise(F.lit(1.0))
    std = F.sqrt(var)
    return m.select("dim", mean.alias("mean"), F.when(std < 1e-6, F.lit(1.0)).otherwise(std).alias("std"))


def population_scaler(dims: DataFrame) -> DataFrame:
    return dims.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def train_scaler(dims: DataFrame, train: Column, epsilon: float = 1e-6) -> DataFrame:
    """Mean and sqrt(population variance + epsilon) of the training rows."""
    return dims.where(train).groupBy("dim").agg(F.avg("x").alias("mean"), F.sqrt(F.var_pop("x") + epsilon).alias("std"))


def standardized(dims: DataFrame, scaler: DataFrame) -> DataFrame:
    """A scaler has a row a dimension, so it is broadcast."""
    return dims.join(F.broadcast(scaler), "dim").withColumn("z", (F.col("x") - F.col("mean")) / F.col("std"))


def class_entropy(rows: DataFrame, label: str) -> DataFrame:
    """Counts of classes and the entropy of their shares in bits."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).agg(F.count(F.lit(1)).alias("classes"), (-F.sum(p * F.log2(p + 1e-12))).alias("entropy"), F.max("n").alias("largest"))  # one row


def mode_baseline(rows: DataFrame, label: str) -> DataFrame:
    """The most frequent class (ties: the smallest) and its share."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(label, F.struct("n", -F.col(label)))
    return counts.agg(best.alias("mode"), (F.max("n") / F.sum("n")).alias("accuracy"))


def best_trial(trials: DataFrame, order: str, rate: str, size: str, least: float = 0.001) -> DataFrame:
    """The fold over trials in order: a rate better by `least` wins, an equal one (1e-9) with fewer parameters too.

    Returns the winner, its rate and how many trials since have not improved. Trials are few (a
    search's log), which is why the ordered fold may gather them.
    """
    log = F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(rate).alias("r"), F.col(size).alias("p"))))

    def step(s: Column, x: Column) -> Column:
        better = s["t"].isNull() | (x["r"] >= s["r"] + least) | ((F.abs(x["r"] - s["r"]) <= 1e-9) & (x["p"] < s["p"]))
        return F.when(better, F.struct(x["t"].alias("t"), x["r"].alias("r"), x["p"].alias("p"), F.lit(0).cast("long").alias("idle"))).otherwise(F.struct(s["t"].alias("t"), s["r"].alias("r"), s["p"].alias("p"), (s["idle"] + 1).alias("idle")))

    kinds = dict(trials.dtypes)
    start = F.struct(F.lit(None).cast(kinds[order]).alias("t"), F.lit(None).cast(kinds[rate]).alias("r"), F.lit(None).cast(kinds[size]).alias("p"), F.lit(0).cast("long").alias("idle"))
    won = trials.agg(F.aggregate(log, start, step).alias("w"))
    return won.select(F.col("w.t").alias("trial"), F.col("w.r").alias("rate"), F.col("w.p").alias("params"), F.col("w.idle").alias("idle"))
