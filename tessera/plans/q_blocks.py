"""Queries on 8x8 blocks: predictors, residuals, filters, scan orders, bit costs, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import costs as C
from ..functions import scalars as S
from . import fixtures as X
from .registry import query

BLOCKS, PLANES = f"WITH {X.BLOCKS_SQL}", f"WITH {X.PLANES_SQL}"
R64 = "range(0, 64)"


def px(dy: int, dx: int, v: str = "px") -> str:
    """DuckDB: the pixel at an offset from place i, 0 outside."""
    return f"CASE WHEN i // 8 + ({dy}) >= 0 AND i % 8 + ({dx}) BETWEEN 0 AND 7 THEN {v}[i + 1 + ({8 * dy + dx})] ELSE 0 END"


NEAR = ", ".join(f"CAST({px(dy, dx)} AS BIGINT) AS {n}" for n, dy, dx in (("a", 0, -1), ("b", -1, 0), ("c", -1, -1), ("d", -1, 1)))
EXPLODED = f"{BLOCKS}, p AS (SELECT block_id, px, unnest(range(0, 64)) AS i FROM blocks), n AS (SELECT block_id, i, CAST(px[i + 1] AS BIGINT) AS v, {NEAR} FROM p)"
MED = "CASE WHEN c > greatest(a, b) THEN least(a, b) WHEN c < least(a, b) THEN greatest(a, b) ELSE a + b - c END"
MED7 = MED.replace("c > ", "c >= ").replace("c < ", "c <= ")
PREDICTED = [MED, "(a + c + 1) // 2", "(b + c + 1) // 2", "(b + d + 1) // 2", "a", "b", "c", "d"]


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """One row a pixel with its left, up, up-left and up-right neighbours."""
    y, x = F.floor(F.col("i") / 8), F.col("i") % 8
    rows = X.blocks(spark, d).select("block_id", "px", F.posexplode("px").alias("i", "v"))
    return rows.select("block_id", F.col("i").cast("long").alias("i"), F.col("v").cast("long").alias("v"), A.at("px", y, x - 1).alias("a"), A.at("px", y - 1, x).alias("b"), A.at("px", y - 1, x - 1).alias("c"), A.at("px", y - 1, x + 1).alias("d"))


@query("q_neighbour_predict", f"{EXPLODED} SELECT block_id, i, v, a, b, c, d FROM n")
def neighbour_predict(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d)


@query("q_predictors", f"{EXPLODED} SELECT block_id, i, " + ", ".join(f"CAST({e} AS BIGINT) AS f{k}" for k, e in enumerate(PREDICTED)) + " FROM n")
def predictors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d).select("block_id", "i", *(p.alias(f"f{k}") for k, p in enumerate(S.predictors("a", "b", "c", "d"))))


@query("q_gen7_predictors", f"{EXPLODED} SELECT block_id, i, CAST({MED7} AS BIGINT) AS med, CAST((a + b + c + 1) // 3 AS BIGINT) AS average FROM n")
def predictors_7(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d).select("block_id", "i", S.med_7("a", "b", "c").alias("med"), S.average_7("a", "b", "c").alias("average"))


@query("q_residual", f"{EXPLODED} " + " UNION ALL ".join(f"SELECT block_id, CAST({k} AS BIGINT) AS predictor, i, CAST(v - ({e}) AS BIGINT) AS r FROM n" for k, e in enumerate(PREDICTED)))
def residual(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(k).cast("long").alias("predictor"), A.residual("px", k).alias("r")) for k in range(8)))
    rows = X.blocks(spark, d).select("block_id", F.explode(each).alias("e")).select("block_id", "e.predictor", F.posexplode("e.r").alias("i", "r"))
    return rows.withColumn("i", F.col("i").cast("long"))


FILTERS = [0, 7, 23, 39, 71, 86, 94]


def filter_sql(code: int) -> str:
    perm = S.PERMUTATIONS[(code >> 4) % 6]
    d = [f"CAST(c{p}[i + 1] AS BIGINT)" for p in perm]
    one = ["0", d[0], f"{d[0]} // 2", f"(3 * {d[0]}) // 2"][(code >> 2) & 3]
    two = ["0", d[0], d[1], f"({d[0]} + {d[1]}) // 2"][code & 3]
    return f"SELECT block_id, CAST({code} AS BIGINT) AS filter_code, i, {d[0]} AS r0, {d[1]} - {one} AS r1, {d[2]} - {two} AS r2 FROM p"


@query("q_color_filter", f"{PLANES}, p AS (SELECT block_id, c0, c1, c2, unnest({R64}) AS i FROM planes) " + " UNION ALL ".join(map(filter_sql, FILTERS)))
def color_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = X.planes(spark, d).select("block_id", F.posexplode(F.arrays_zip("c0", "c1", "c2")).alias("i", "p"))
    rows = rows.select("block_id", F.col("i").cast("long").alias("i"), "p.c0", "p.c1", "p.c2", F.explode(F.array(*(F.lit(f).cast("long") for f in FILTERS))).alias("filter_code"))
    r = S.color_filter("filter_code", "c0", "c1", "c2")
    return rows.select("block_id", "filter_code", "i", *(x.alias(f"r{k}") for k, x in enumerate(r)))


@query("q_reorder", f"{BLOCKS} " + " UNION ALL ".join(f"SELECT block_id, '{n}' AS scan, i, CAST(px[({o})[i + 1] + 1] AS BIGINT) AS v FROM (SELECT block_id, px, unnest({R64}) AS i FROM blocks)" for n, o in A.scan_orders().items()))
def reorder(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(n).alias("scan"), A.scanned("px", o).alias("v")) for n, o in A.scan_orders().items()))
    rows = X.blocks(spark, d).select("block_id", F.explode(each).alias("e")).select("block_id", "e.scan", F.posexplode("e.v").alias("i", "v"))
    return rows.withColumn("i", F.col("i").cast("long"))


@query("q_interleave", f"{PLANES}, p AS (SELECT *, unnest(range(0, 192)) AS i FROM planes) SELECT block_id, i, CAST(CASE i % 3 WHEN 0 THEN c0[i // 3 + 1] WHEN 1 THEN c1[i // 3 + 1] ELSE c2[i // 3 + 1] END AS BIGINT) AS v FROM p")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    rows = X.planes(spark, d).select("block_id", F.posexplode(A.interleaved("c0", "c1", "c2")).alias("i", "v"))
    return rows.withColumn("i", F.col("i").cast("long"))


@query("q_block_energy", f"{BLOCKS} SELECT block_id, CAST(list_sum(list_transform(px, lambda x: CAST(x AS BIGINT) * x)) AS BIGINT) AS energy FROM blocks")
def energy(spark: SparkSession, d: str) -> DataFrame:
    return X.blocks(spark, d).select("block_id", A.energy("px").alias("energy"))


UP, LEFT = px(-1, 0), px(0, -1)


@query("q_delta_roundtrip", f"{BLOCKS}, p AS (SELECT block_id, px, unnest({R64}) AS i FROM blocks), u AS (SELECT block_id, i, px[i + 1] AS v, CASE WHEN i >= 8 THEN px[i - 7] ELSE 0 END AS up FROM p) SELECT block_id, i, CAST(((v - up - CASE WHEN i % 8 > 0 THEN lag(v - up) OVER (PARTITION BY block_id ORDER BY i) ELSE 0 END) % 256 + 256) % 256 AS BIGINT) AS delta, CAST(v AS BIGINT) AS restored FROM u")
def delta(spark: SparkSession, d: str) -> DataFrame:
    """Up, then left differences modulo 256, and the pixels that running sums restore from them."""
    ups = A.over_block(lambda y, x: A.at("px", y, x) - A.at("px", y - 1, x))
    rows = X.blocks(spark, d).withColumn("u", ups)
    rows = rows.withColumn("delta", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.pmod(F.get("u", i) - F.when(i % 8 > 0, F.get("u", i - 1)).otherwise(F.lit(0)), F.lit(256))))
    # The sum of all deltas above and to the left gives a pixel back.
    total = lambda i: F.pmod(F.aggregate(F.filter(F.sequence(F.lit(0), i), lambda j: j % 8 <= i % 8), F.lit(0).cast("long"), lambda s, j: s + F.get("delta", j)), F.lit(256))
    rows = rows.withColumn("restored", F.transform(F.sequence(F.lit(0), F.lit(63)), total))
    out = rows.select("block_id", F.posexplode(F.arrays_zip("delta", "restored")).alias("i", "p"))
    return out.select("block_id", F.col("i").cast("long").alias("i"), F.col("p.delta").cast("long").alias("delta"), F.col("p.restored").cast("long").alias("restored"))


# Bit costs of residuals.

VALUES = f"{EXPLODED}, r AS (SELECT block_id, i, v - a AS v FROM n)"
WIDTH = "CASE WHEN {0} <= 0 THEN 0 ELSE length(ltrim(bin({0}), '0')) END"
ZIG = "CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END"
GAMMA = "CASE WHEN {0} <= 0 THEN 0 ELSE 2 * (" + WIDTH + ") - 1 END"


def values(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d).select((F.col("v") - F.col("a")).alias("v")).distinct()


def scalar(name: str, expression: str, f) -> None:
    sql = f"{VALUES}, m AS (SELECT DISTINCT v, {ZIG} AS m FROM r) SELECT v, CAST({expression} AS BIGINT) AS out FROM m"
    query(name, sql)(lambda spark, d: values(spark, d).withColumn("m", S.zigzag("v")).select("v", f(F.col("v"), F.col("m")).cast("long").alias("out")))


scalar("q_zigzag", "m", lambda v, m: m)
scalar("q_unzigzag", "v", lambda v, m: S.unzigzag(m))
scalar("q_bit_width", WIDTH.format("m"), lambda v, m: S.bit_width(m))
scalar("q_run_length_bits", f"CASE WHEN m <= 2 THEN m ELSE 2 + {GAMMA.format('(m - 2)')} END", lambda v, m: S.run_length_bits(m))
scalar("q_gen7_run_length_bits", f"CASE WHEN m <= 3 THEN m ELSE 3 + {GAMMA.format('(m - 3)')} END", lambda v, m: S.zero_run_bits_7(m))
scalar("q_varuint_bits", f"8 * greatest(1, ceil(({WIDTH.format('m * 37')}) / 7.0))", lambda v, m: S.varuint_bits(m * 37))
scalar("q_golomb_value_bits", f"CASE WHEN m // 4 < 16 THEN m // 4 + 3 ELSE 16 + {GAMMA.format('(m - 15)')} END", lambda v, m: S.golomb_value_bits(m, F.lit(2)))


@query("q_bitlen_table", " UNION ALL ".join(f"SELECT CAST({row} AS BIGINT) AS row, CAST({i} AS BIGINT) AS bits, CAST({n} AS BIGINT) AS means" for row, (_, _, counts) in enumerate(C.DEFAULT) for i, n in enumerate(counts)))
def bit_length_table(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(r).cast("long").alias("row"), F.array(*map(F.lit, C.bit_lengths(c))).alias("b")) for r, (_, _, c) in enumerate(C.DEFAULT)))
    rows = spark.range(1).select(F.explode(each).alias("e")).select("e.row", F.explode("e.b").alias("bits")).withColumn("bits", F.col("bits").cast("long"))
    return rows.groupBy("row", "bits").agg(F.count(F.lit(1)).alias("means"))


def steps_sql(mean: str, counts: list[int]) -> str:
    return " + ".join(f"CASE WHEN {mean} >= {t} THEN 1 ELSE 0 END" for t in C.thresholds(counts)[:-1])


def plain_sql(row: int) -> str:
    """DuckDB: the fold as a recursion over list_reduce with a struct."""
    rise, fall, counts = C.DEFAULT[row]
    m = "(CASE WHEN x.v >= 0 THEN 2 * x.v ELSE -2 * x.v - 1 END)"
    k = f"({steps_sql('((s.a + 8) // 16)', counts)})"
    cost = f"(CASE WHEN ({m} >> {k}) < 16 THEN ({m} >> {k}) + 1 + {k} ELSE 16 + {GAMMA.format(f'({m} - 15)')} END)"
    mix = f"(CASE WHEN s.a < {m} THEN ({m} * {16 * rise} + s.a * {16 - rise} + 8) // 16 ELSE ({m} * {16 * fall} + s.a * {16 - fall} + 8) // 16 END)"
    return f"list_reduce(l, lambda s, x: {{'v': CAST(0 AS BIGINT), 'a': CAST({mix} AS BIGINT), 'bits': CAST(s.bits + {cost} AS BIGINT)}}, {{'v': CAST(0 AS BIGINT), 'a': CAST(0 AS BIGINT), 'bits': CAST(0 AS BIGINT)}}).bits"


LISTS = f"{VALUES}, l AS (SELECT block_id, list({{'v': CAST(v AS BIGINT), 'a': CAST(0 AS BIGINT), 'bits': CAST(0 AS BIGINT)}} ORDER BY i) AS l FROM r GROUP BY block_id)"


@query("q_golomb_plain_bits", f"{LISTS} SELECT block_id, {plain_sql(0)} AS bits FROM l")
def golomb_plain(spark: SparkSession, d: str) -> DataFrame:
    return X.blocks(spark, d).withColumn("r", A.residual("px", 4)).select("block_id", C.plain_bits("r", 0).alias("bits"))


def rle_sql(row: int) -> str:
    rise, fall, counts = C.DEFAULT[row]
    m = "greatest(0, (CASE WHEN x.v >= 0 THEN 2 * x.v ELSE -2 * x.v - 1 END) - 1)"
    k = f"({steps_sql('((s.a + 8) // 16)', counts)})"
    cost = f"(CASE WHEN x.v = 0 THEN 0 WHEN ({m} >> {k}) < 16 THEN ({m} >> {k}) + 1 + {k} ELSE 16 + {GAMMA.format(f'({m} - 15)')} END)"
    mix = f"(CASE WHEN x.v = 0 THEN s.a WHEN s.a < {m} THEN ({m} * {16 * rise} + s.a * {16 - rise} + 8) // 16 ELSE ({m} * {16 * fall} + s.a * {16 - fall} + 8) // 16 END)"
    run = "CASE WHEN s.run <= 2 THEN s.run ELSE 2 + " + GAMMA.format("(s.run - 2)") + " END"
    turned = "(s.run > 0 AND (x.v = 0) <> s.zero)"
    zero = "'v': CAST(0 AS BIGINT), 'a': CAST(0 AS BIGINT), 'bits': CAST(1 AS BIGINT), 'run': CAST(0 AS BIGINT), 'zero': true"
    state = f"list_reduce(l, lambda s, x: {{'v': CAST(0 AS BIGINT), 'a': CAST({mix} AS BIGINT), 'bits': CAST(s.bits + {cost} + CASE WHEN {turned} THEN {run} ELSE 0 END AS BIGINT), 'run': CAST(CASE WHEN {turned} THEN 1 ELSE s.run + 1 END AS BIGINT), 'zero': x.v = 0}}, {{{zero}}})"
    return f"SELECT block_id, CAST(s.bits + {run} AS BIGINT) AS bits FROM (SELECT block_id, {state} AS s FROM l)"


RLE_LISTS = f"{VALUES}, l AS (SELECT block_id, list({{'v': CAST(v AS BIGINT), 'a': CAST(0 AS BIGINT), 'bits': CAST(0 AS BIGINT), 'run': CAST(0 AS BIGINT), 'zero': false}} ORDER BY i) AS l FROM (SELECT block_id, i, CASE WHEN abs(v) < 40 THEN 0 ELSE v END AS v FROM r) GROUP BY block_id)"


@query("q_golomb_rle_bits", f"{RLE_LISTS} {rle_sql(3)}")
def golomb_rle(spark: SparkSession, d: str) -> DataFrame:
    """Of residuals with small values set to 0, so that there are runs."""
    quiet = F.transform(A.residual("px", 4), lambda v: F.when(F.abs(v) < 40, F.lit(0)).otherwise(v).cast("long"))
    return X.blocks(spark, d).withColumn("r", quiet).select("block_id", C.run_length_bits("r", 3).alias("bits"))


def plain7_sql(row: int) -> str:
    _, _, counts = C.DEFAULT[row]
    m = "(CASE WHEN x.v >= 0 THEN 2 * x.v ELSE -2 * x.v - 1 END)"
    k = f"({steps_sql('s.a', counts)})"
    return f"list_reduce(l, lambda s, x: {{'v': CAST(0 AS BIGINT), 'a': CAST(({m} + s.a + 1) // 2 AS BIGINT), 'bits': CAST(s.bits + ({m} >> {k}) + 1 + {k} AS BIGINT)}}, {{'v': CAST(0 AS BIGINT), 'a': CAST(0 AS BIGINT), 'bits': CAST(0 AS BIGINT)}}).bits"


@query("q_gen7_plain_bits", f"{LISTS} SELECT block_id, {plain7_sql(1)} AS bits FROM l")
def plain_7(spark: SparkSession, d: str) -> DataFrame:
    return X.blocks(spark, d).withColumn("r", A.residual("px", 4)).select("block_id", C.plain_bits_7("r", C.DEFAULT[1][2]).alias("bits"))


# Real-valued features, to six decimals.


def r6(c: Column) -> Column:
    return F.round(c, 6)


LUMA = "0.299 * c0[i + 1] / 255 + 0.587 * c1[i + 1] / 255 + 0.114 * c2[i + 1] / 255"
LUMAS = f"{PLANES}, y AS (SELECT block_id, list_transform({R64}, lambda i: CAST(0.299 AS DOUBLE) * c0[i + 1] + CAST(0.587 AS DOUBLE) * c1[i + 1] + CAST(0.114 AS DOUBLE) * c2[i + 1]) AS raw FROM planes), l AS (SELECT block_id, list_transform(raw, lambda v: v / 255) AS l FROM y)"


def lumas(spark: SparkSession, d: str) -> DataFrame:
    return X.planes(spark, d).withColumn("l", A.luma_block("c0", "c1", "c2"))


@query("q_luma", f"{LUMAS} SELECT block_id, unnest({R64}) AS i, round(unnest(l), 6) AS l FROM l")
def luma(spark: SparkSession, d: str) -> DataFrame:
    rows = lumas(spark, d).select("block_id", F.posexplode("l").alias("i", "l"))
    return rows.select("block_id", F.col("i").cast("long").alias("i"), r6(F.col("l")).alias("l"))


@query("q_pixels_rgb", f"{PLANES}, p AS (SELECT *, unnest({R64}) AS i FROM planes) SELECT block_id, i, round(c0[i + 1] / 255, 6) AS r, round(c1[i + 1] / 255, 6) AS g, round(c2[i + 1] / 255, 6) AS b FROM p")
def pixels(spark: SparkSession, d: str) -> DataFrame:
    rows = X.planes(spark, d).select("block_id", F.posexplode(F.arrays_zip("c0", "c1", "c2")).alias("i", "p"))
    return rows.select("block_id", F.col("i").cast("long").alias("i"), *(r6(F.col(f"p.c{k}") / 255).alias(n) for k, n in enumerate("rgb")))


@query("q_pool4x4", f"{LUMAS}, p AS (SELECT block_id, l, unnest(range(0, 16)) AS i FROM l), t AS (SELECT *, (i // 4) * 16 + (i % 4) * 2 + 1 AS t FROM p) SELECT block_id, i, round((l[t] + l[t + 1] + l[t + 8] + l[t + 9]) / 4, 6) AS v FROM t")
def pool(spark: SparkSession, d: str) -> DataFrame:
    rows = lumas(spark, d).select("block_id", F.posexplode(A.pooled("l")).alias("i", "v"))
    return rows.select("block_id", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


@query("q_dct4x4", f"{LUMAS}, p AS (SELECT block_id, l, unnest(range(0, 16)) AS k FROM l) SELECT block_id, k AS i, round(list_sum(list_transform({R64}, lambda i: l[i + 1] * cos(pi() * (2 * (i // 8) + 1) * (k // 4) / 16) * cos(pi() * (2 * (i % 8) + 1) * (k % 4) / 16))), 6) + 0.0 AS v FROM p")
def dct(spark: SparkSession, d: str) -> DataFrame:
    rows = lumas(spark, d).select("block_id", F.posexplode(A.dct_low("l")).alias("i", "v"))
    return rows.select("block_id", F.col("i").cast("long").alias("i"), (r6(F.col("v")) + F.lit(0.0)).alias("v"))


def steps(values: str, dx: int) -> Column:
    """Absolute differences to the left (dx 1) or upper (dx 8) neighbour inside the block."""
    keep = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 8 > 0) if dx == 1 else (i >= 8))
    return F.transform(keep, lambda i: F.abs(F.get(F.col(values), i) - F.get(F.col(values), i - dx)))


DX = "list_transform(list_filter(range(0, 64), lambda i: i % 8 > 0), lambda i: abs(l[i + 1] - l[i]))"
DY = "list_transform(list_filter(range(0, 64), lambda i: i >= 8), lambda i: abs(l[i + 1] - l[i - 7]))"
MEAN = "list_sum({0}) / len({0})"
VAR = "list_sum(list_transform({0}, lambda x: x * x)) / len({0}) - (list_sum({0}) / len({0})) * (list_sum({0}) / len({0}))"


@query(
    "q_pixel_derived",
    f"{LUMAS} SELECT block_id, round({MEAN.format('l')}, 6) AS mean, round({VAR.format('l')}, 6) AS var, round({MEAN.format(DX)}, 6) AS dx, round({MEAN.format(DY)}, 6) AS dy, "
    f"round((len(list_filter({DX}, lambda x: x > 0.08)) + len(list_filter({DY}, lambda x: x > 0.08))) / 112, 6) AS edges FROM l",
)
def pixel_derived(spark: SparkSession, d: str) -> DataFrame:
    dx, dy = steps("l", 1), steps("l", 8)
    edges = (F.size(F.filter(dx, lambda x: x > 0.08)) + F.size(F.filter(dy, lambda x: x > 0.08))) / 112
    return lumas(spark, d).select("block_id", r6(A.mean("l")).alias("mean"), r6(A.variance("l")).alias("var"), r6(A.mean(dx)).alias("dx"), r6(A.mean(dy)).alias("dy"), r6(edges).alias("edges"))


GX = "list_sum(list_transform({0}, lambda x: x * x))"


@query(
    "q_stats_v1",
    f"{LUMAS} SELECT block_id, round({MEAN.format('l')}, 6) AS mean, round({VAR.format('l')}, 6) AS var, round({GX.format(DX)}, 6) AS gx, round({GX.format(DY)}, 6) AS gy, "
    f"round(({GX.format(DX)} + {GX.format(DY)}) / ({VAR.format('l')} + 1e-6), 6) AS hf_norm FROM l",
)
def stats_v1(spark: SparkSession, d: str) -> DataFrame:
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    gx, gy = square(steps("l", 1)), square(steps("l", 8))
    return lumas(spark, d).select("block_id", r6(A.mean("l")).alias("mean"), r6(A.variance("l")).alias("var"), r6(gx).alias("gx"), r6(gy).alias("gy"), r6((gx + gy) / (A.variance("l") + 1e-6)).alias("hf_norm"))


def tv_sql(order: list[int], power: int) -> str:
    steps_ = f"list_transform(range(1, 64), lambda i: power(abs(CAST(px[({order})[i + 1] + 1] AS DOUBLE) - px[({order})[i] + 1]), {power}))"
    return f"list_sum({steps_}) / 63"


@query("q_total_variation", f"{BLOCKS} " + " UNION ALL ".join(f"SELECT block_id, '{n}' AS scan, round({tv_sql(o, 1)}, 6) AS tv FROM blocks" for n, o in A.scan_orders().items()))
def variation(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(n).alias("scan"), A.total_variation(A.scanned("px", o)).alias("tv")) for n, o in A.scan_orders().items()))
    return X.blocks(spark, d).select("block_id", F.explode(each).alias("e")).select("block_id", "e.scan", r6(F.col("e.tv")).alias("tv"))


@query("q_stats_v3", f"{BLOCKS} " + " UNION ALL ".join(f"SELECT block_id, '{n}' AS scan, round({tv_sql(o, 1)}, 6) AS tv, round(ln(1 + {tv_sql(o, 2)}), 6) AS tv2 FROM blocks" for n, o in A.scan_orders().items()))
def stats_v3(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(n).alias("scan"), A.total_variation(A.scanned("px", o)).alias("tv"), F.log1p(A.total_variation(A.scanned("px", o), 2)).alias("tv2")) for n, o in A.scan_orders().items()))
    return X.blocks(spark, d).select("block_id", F.explode(each).alias("e")).select("block_id", "e.scan", r6(F.col("e.tv")).alias("tv"), r6(F.col("e.tv2")).alias("tv2"))


@query("q_featcache", f"{PLANES}, p AS (SELECT *, unnest(range(0, 259)) AS i FROM planes) SELECT block_id, i, round(CASE WHEN i < 64 THEN c0[i + 1] / 255 WHEN i < 128 THEN c1[i - 63] / 255 WHEN i < 192 THEN c2[i - 127] / 255 WHEN i < 256 THEN 0 WHEN i < 258 THEN 1 ELSE 0.75 END, 6) AS v FROM p")
def feature_cache(spark: SparkSession, d: str) -> DataFrame:
    """Planes padded to four, then width, height and components as shares of 8, 8 and 4."""
    unit = lambda c: F.transform(c, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v)) / 255)
    whole = F.concat(unit("c0"), unit("c1"), unit("c2"), F.array_repeat(F.lit(0.0), 64), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.75)))
    rows = X.planes(spark, d).select("block_id", F.posexplode(whole).alias("i", "v"))
    return rows.select("block_id", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


@query("q_block_search")
def block_search(spark: SparkSession, d: str) -> DataFrame:
    """The two cheapest settings of each block over all scan orders."""
    from ..operators.block_search import searched

    return searched(X.planes(spark, d))


# Orientation: gradients of the summed components under 3x3 weights, edges repeated.

WEIGHTS = [(dy, dx, gx, gy) for dy, row in zip((-1, 0, 1), ((1, 0, -1), (2, 0, -2), (1, 0, -1))) for dx, gx, gy in zip((-1, 0, 1), row, ((1, 2, 1), (0, 0, 0), (-1, -2, -1))[dy + 1])]


def near_sql(dy: int, dx: int) -> str:
    return f"m[greatest(0, least(7, i // 8 + ({dy}))) * 8 + greatest(0, least(7, i % 8 + ({dx}))) + 1]"


GX_SQL = " + ".join(f"({gx}) * {near_sql(dy, dx)}" for dy, dx, gx, _ in WEIGHTS if gx)
GY_SQL = " + ".join(f"({gy}) * {near_sql(dy, dx)}" for dy, dx, _, gy in WEIGHTS if gy)


@query(
    "q_orientation_features",
    f"""{PLANES}, m AS (SELECT block_id, list_transform({R64}, lambda i: c0[i + 1] + c1[i + 1] + c2[i + 1]) AS m FROM planes), p AS (SELECT block_id, m, unnest({R64}) AS i FROM m),
    g AS (SELECT block_id, CAST({GX_SQL} AS DOUBLE) AS gx, CAST({GY_SQL} AS DOUBLE) AS gy FROM p),
    o AS (SELECT block_id, gx, gy, sqrt(gx * gx + gy * gy) AS mag, greatest(0, least(7, floor((atan2(gy, gx) + pi()) * (4 / pi())))) AS bin FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY mag) AS r, avg(mag) OVER (PARTITION BY block_id) AS mean FROM o)
    SELECT block_id, {', '.join(f'round(CASE WHEN sum(mag) > 0 THEN sum(CASE WHEN bin = {k} THEN mag ELSE 0 END) / sum(mag) ELSE 0 END, 6) AS bin{k}' for k in range(8))},
      round(avg(mag), 6) AS mean, round(max(CASE WHEN r = 60 THEN mag END), 6) AS p95, round(avg(CASE WHEN mag > 1.5 * mean THEN 1.0 ELSE 0.0 END), 6) AS edges,
      round((sum(abs(gx)) - sum(abs(gy))) / (sum(abs(gx)) + sum(abs(gy)) + 1e-6), 6) + 0.0 AS balance,
      round(sum(CASE WHEN r <= 16 THEN mag ELSE 0 END) / 16 / (sum(CASE WHEN r > 48 THEN mag ELSE 0 END) / 16 + 1e-6), 6) AS low_high
    FROM r GROUP BY block_id""",
)
def orientation(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of directions weighted by strength, mean, 95th percentile, edge share, balance, low to high ratio; all in the row."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(7), v))

    def gradient(i: Column, which: int) -> Column:
        parts = [w[2 + which] * F.get("m", (clamp(F.floor(i / 8) + w[0]) * 8 + clamp(i % 8 + w[1])).cast("int")) for w in WEIGHTS if w[2 + which]]
        return sum(parts[1:], parts[0]).cast("double")

    places = F.sequence(F.lit(0), F.lit(63))
    rows = X.planes(spark, d).select("block_id", F.transform(F.arrays_zip("c0", "c1", "c2"), lambda p: (p["c0"] + p["c1"] + p["c2"]).cast("long")).alias("m"))
    rows = rows.select("block_id", F.transform(places, lambda i: F.struct(gradient(i, 0).alias("gx"), gradient(i, 1).alias("gy"))).alias("g"))
    rows = rows.select("block_id", F.transform("g", lambda g: F.struct(g["gx"].alias("gx"), g["gy"].alias("gy"), F.sqrt(g["gx"] * g["gx"] + g["gy"] * g["gy"]).alias("mag"), clamp(F.floor((F.atan2(g["gy"], g["gx"]) + F.pi()) * (4 / F.pi()))).alias("bin"))).alias("g"))
    rows = rows.withColumn("mags", F.array_sort(F.transform("g", lambda g: g["mag"]))).withColumn("sum", total("mags"))

    def share(k: int) -> Column:
        mine = total(F.transform("g", lambda g: F.when(g["bin"] == k, g["mag"]).otherwise(0.0)))
        return F.when(F.col("sum") > 0, mine / F.col("sum")).otherwise(0.0)

    mean = F.col("sum") / 64
    h, v = total(F.transform("g", lambda g: F.abs(g["gx"]))), total(F.transform("g", lambda g: F.abs(g["gy"])))
    return rows.select(
        "block_id",
        *(r6(share(k)).alias(f"bin{k}") for k in range(8)),
        r6(mean).alias("mean"),
        r6(F.get("mags", F.lit(59))).alias("p95"),
        r6(F.size(F.filter("mags", lambda m: m > 1.5 * mean)) / 64).alias("edges"),
        (r6((h - v) / (h + v + 1e-6)) + F.lit(0.0)).alias("balance"),
        r6(total(F.slice("mags", 1, 16)) / 16 / (total(F.slice("mags", 49, 16)) / 16 + 1e-6)).alias("low_high"),
    )
