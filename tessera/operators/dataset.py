"""Operators that make a training set: eligibility, runs, joins by place, packing, splits, scalers.

Row numbers within a file, block or path are window functions on that key; numbers over a whole
table are two-level (counts of partitions of the key's range, then within one), so no window
holds the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

BUCKETS = 64  # of a table by key, times the shuffle partitions
ROWS = 1 << 20  # of a partition that is sorted by key


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null; a rule of unknown truth does not hold."""
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for name, rule in rules[1:]:
        out = out.when(rule, F.lit(name))
    return out


def class_counts(labels: DataFrame, heads: list[str]) -> DataFrame:
    """For each head the largest class of best and second plus one."""
    return labels.agg(*((F.max(F.greatest(F.col(f"best_{h}"), F.coalesce(F.col(f"second_{h}"), F.lit(0)))) + 1).alias(h) for h in heads))


def range_violations(labels: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """For each head how many rows hold a class outside 0 to size - 1; a missing second is none."""
    bad = lambda h, n: ~F.col(f"best_{h}").between(0, n - 1) | ~F.coalesce(F.col(f"second_{h}"), F.lit(0)).between(0, n - 1)
    return labels.agg(*(F.count_if(bad(h, n)).alias(h) for h, n in sizes.items()))


def mismatches(a: DataFrame, b: DataFrame, key: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows that both sides have, and how many differ in each named pair of columns (null equals null)."""
    return a.join(b, key).agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(~F.col(x).eqNullSafe(F.col(y))).alias(n) for n, (x, y) in pairs.items()))


def by_key(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows dealt by key to as many partitions as keep the even share of each at ROWS, so that a task's sort does not grow with the table."""
    return rows.repartition(max(shuffle_partitions(rows), -(-rows.count() // ROWS)), *key)


def runs(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours within a key: (key, run from 1, value, length).

    A run comes from its last row, in the windows of one sort: no table of runs is held.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    here, place = F.struct(F.col("value")), F.row_number().over(w)  # a struct is null beyond the ends only
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    narrow = by_key(rows.select(*key, *order, F.col(value).alias("value")), key)
    marked = narrow.select("*", place.alias("place"), (~F.lag(here).over(w).eqNullSafe(here)).alias("first"), (~F.lead(here).over(w).eqNullSafe(here)).alias("last"))
    found = marked.select(*key, "value", "place", "last", F.count_if("first").over(so_far).alias("run"), F.max(F.when(F.col("first"), F.col("place"))).over(so_far).alias("start"))
    return found.where("last").select(*key, "run", "value", (F.col("place") - F.col("start") + 1).cast("long").alias("length"))


def sequence_costs(rows: DataFrame, key: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Bits of a value sequence raw, with same-as-previous flags, and as runs."""
    r = runs(rows, key, order, value)
    n = F.sum("length")
    return r.groupBy(*key).agg((n * width).alias("raw_bits"), (width + n - 1 + (F.count(F.lit(1)) - 1) * width).alias("same_bits"), F.sum(width + S.varuint_bits(F.col("length") - 1)).alias("run_bits"))


def pack_offsets(parts: DataFrame, key: str, count: str, bucket: Column, offset: str = "offset") -> DataFrame:
    """Adds the sum of all counts before each key. `bucket` never falls as the key rises: sums go by bucket, then within one."""
    dealt = parts.withColumn("_b", bucket)
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_b").agg(F.sum(count).alias("_sum")).select("_b", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))  # a row a bucket
    inside = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_mine", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(sums, "_b")
    return out.withColumn(offset, (F.col("_before") + F.col("_mine")).cast("long")).drop("_b", "_mine", "_before")


def even_buckets(rows: DataFrame, key: str) -> Column:
    """Buckets of equal width over a whole-number key: BUCKETS a partition, however many rows there are."""
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    width = -(-(hi - lo + 1) // (BUCKETS * shuffle_partitions(rows)))
    return F.floor((F.col(key) - lo) / width)


def shuffle_partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, order: list[Column], bucket: Column, name: str = "row_id") -> DataFrame:
    """Dense row numbers from 0 in the given order; `bucket` never falls along it."""
    return pack_offsets(rows.withColumn("_one", F.lit(1)).withColumn("_order", F.struct(*order)), "_order", "_one", bucket, name).drop("_one", "_order")


def range_lookup(points: DataFrame, point: str, ranges: DataFrame, start: str, count: str, size: int = 4096) -> DataFrame:
    """Joins each point to the range [start, start + count) that holds it.

    Ranges are cut into buckets of `size` points and joined on the bucket, so it is an equi-join
    with a residual condition and not a comparison of all with all.
    """
    cut = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(start) + F.col(count) - 1) / size)))).where(F.col(count) > 0)
    at = points.withColumn("_bucket", F.floor(F.col(point) / size))
    return at.join(cut, "_bucket").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(count))).drop("_bucket")


def sampled(rows: DataFrame, key: str, seed: int, keep: int) -> DataFrame:
    """`keep` rows by a seeded hash of the key, the same on every engine."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(keep)


def split(rows: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    """Adds place (0 first) in a seeded shuffle and part: train for the first `share`, else valid."""
    digits = len(f"{BUCKETS * shuffle_partitions(rows):x}")  # of the hash: that many buckets at least
    out = numbered(rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))), [F.col("_h"), F.col(key)], F.substring("_h", 1, digits), "place").drop("_h")
    total = out.agg(F.count(F.lit(1)).alias("_total"))
    return out.crossJoin(F.broadcast(total)).withColumn("part", F.when(F.col("place") < F.floor(F.col("_total") * share), F.lit("train")).otherwise(F.lit("valid"))).drop("_total")  # one row
