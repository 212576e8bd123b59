"""Queries on dimensions, classes and heads of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ranking as R
from ..operators import statistics as T
from . import fixtures as X
from .registry import query

HEADS = {"predictor": (0, 8), "cf_perm": (8, 6), "cf_primary": (14, 4), "cf_secondary": (18, 4), "reorder": (22, 8), "interleave": (30, 2)}
WIDTHS = {"predictor": 4, "cf_perm": 4, "cf_primary": 3, "cf_secondary": 2, "reorder": 4, "interleave": 2}
DIMS = "WITH d AS (SELECT vec_id, unnest(range(0, 64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def dims(spark: SparkSession, d: str) -> DataFrame:
    return T.exploded(X.table(spark, d, "embeddings"), "vec_id", "embedding")


@query("q_feature_stats", f"{DIMS} SELECT dim, count(*) AS n, round(sum(x), 6) AS s, round(sum(x * x), 6) AS ss FROM d GROUP BY dim")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    return T.moments(dims(spark, d)).select("dim", "n", F.round("s", 6).alias("s"), F.round("ss", 6).alias("ss"))


@query("q_scaler_samp", f"{DIMS} SELECT dim, round(avg(x), 6) + 0.0 AS mean, round(CASE WHEN sqrt(greatest(1e-12, var_samp(x))) < 1e-6 THEN 1 ELSE sqrt(greatest(1e-12, var_samp(x))) END, 6) AS std FROM d GROUP BY dim")
def scaler_sample(spark: SparkSession, d: str) -> DataFrame:
    return T.sample_scaler(T.moments(dims(spark, d))).select("dim", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("q_scaler_pop", f"{DIMS} SELECT dim, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) AS std FROM d GROUP BY dim")
def scaler_population(spark: SparkSession, d: str) -> DataFrame:
    return T.population_scaler(dims(spark, d)).select("dim", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("q_standardize", f"{DIMS}, s AS (SELECT dim, avg(x) AS mean, sqrt(var_pop(x) + 1e-6) AS std FROM d WHERE vec_id % 10 <> 0 GROUP BY dim) SELECT vec_id, dim, round((x - mean) / std, 6) + 0.0 AS z FROM d JOIN s USING (dim)")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    rows = dims(spark, d)
    return T.standardized(rows, T.train_scaler(rows, F.col("vec_id") % 10 != 0)).select("vec_id", "dim", r6(F.col("z")).alias("z"))


@query("q_variance_rank", f"{DIMS}, v AS (SELECT dim, round(var_pop(x), 9) AS var FROM d GROUP BY dim) SELECT dim, row_number() OVER (ORDER BY var DESC, dim) AS rank FROM v QUALIFY rank <= 16")
def variance_rank(spark: SparkSession, d: str) -> DataFrame:
    """The 16 dimensions of largest variance: a report of a few rows."""
    from pyspark.sql import Window

    v = dims(spark, d).groupBy("dim").agg(F.round(F.var_pop("x"), 9).alias("var"))
    return v.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("var"), "dim")).cast("long")).where("rank <= 16").select("dim", "rank")


TRANSFORMS = {
    "log1p": (lambda x: F.log1p(F.greatest(x, F.lit(0.0))), "ln(1 + greatest(x, 0))"),
    "sqrt": (lambda x: F.sqrt(F.greatest(x, F.lit(0.0))), "sqrt(greatest(x, 0))"),
    "square": (lambda x: x * x, "x * x"),
    "abs": (F.abs, "abs(x)"),
    "clip": (lambda x: F.greatest(F.lit(-0.1), F.least(F.lit(0.1), x)), "greatest(-0.1, least(0.1, x))"),
}


@query("q_transforms", f"{DIMS} SELECT vec_id, dim, " + ", ".join(f"round({sql}, 6) + 0.0 AS {n}" for n, (_, sql) in TRANSFORMS.items()) + " FROM d")
def transforms(spark: SparkSession, d: str) -> DataFrame:
    return dims(spark, d).select("vec_id", "dim", *(r6(f(F.col("x"))).alias(n) for n, (f, _) in TRANSFORMS.items()))


@query("q_feature_pipeline", "WITH p AS (SELECT vec_id, list_concat(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)), list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) * x), list_transform(embedding[5:8], lambda x: abs(CAST(x AS DOUBLE)))) AS f FROM embeddings) SELECT vec_id, unnest(range(0, 16)) AS i, round(unnest(f), 6) + 0.0 AS v FROM p")
def feature_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Selected columns as they are, then transforms of subsets, side by side."""
    raw = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    rows = X.table(spark, d, "embeddings").withColumn("raw", raw)
    whole = F.concat("raw", F.transform(F.slice("raw", 1, 4), lambda x: x * x), F.transform(F.slice("raw", 5, 4), F.abs))
    rows = rows.select("vec_id", F.posexplode(whole).alias("i", "v"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


@query("q_class_hist_entropy", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT n, n / sum(n) OVER () AS p FROM c) SELECT count(*) AS classes, round(-sum(p * log2(p + 1e-12)), 6) AS entropy, max(n) AS largest FROM t")
def class_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = T.class_entropy(X.table(spark, d, "embeddings"), "label")
    return e.select("classes", r6(F.col("entropy")).alias("entropy"), "largest")


@query("q_mode_baseline", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT CAST((SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS BIGINT) AS mode, round(max(n) / sum(n), 6) AS accuracy FROM c")
def mode_baseline(spark: SparkSession, d: str) -> DataFrame:
    return T.mode_baseline(X.table(spark, d, "embeddings"), "label").select(F.col("mode").cast("long").alias("mode"), r6(F.col("accuracy")).alias("accuracy"))


# Heads: slices of an embedding as scores of classes.


def head_scores(h: str) -> Column:
    start, n = HEADS[h]
    return F.transform(F.slice("embedding", start + 1, n), lambda x: x.cast("double"))


def heads(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "embeddings").select("vec_id", "label", *(head_scores(h).alias(h) for h in HEADS))


def slot(h: str) -> str:
    start, n = HEADS[h]
    return f"list_transform(embedding[{start + 1}:{start + n}], lambda x: CAST(x AS DOUBLE))"




TOP = "SELECT vec_id, r - 1 AS place, i AS id FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY {o}, i) AS r FROM (SELECT vec_id, unnest(range(0, 8)) AS i, unnest(" + slot("predictor") + ") AS x FROM embeddings)) WHERE r <= 3"


def exploded(rows: DataFrame, c: Column) -> DataFrame:
    out = rows.select("vec_id", F.posexplode(c).alias("place", "id"))
    return out.select("vec_id", F.col("place").cast("long").alias("place"), F.col("id").cast("long").alias("id"))


@query("q_topk_tiebreak", TOP.format(o="x DESC"))
def topk(spark: SparkSession, d: str) -> DataFrame:
    return exploded(heads(spark, d), R.top_k("predictor", 3))


@query("q_topk_soft", TOP.format(o="x + (8 - i) * 1e-6 DESC"))
def topk_soft(spark: SparkSession, d: str) -> DataFrame:
    return exploded(heads(spark, d), R.top_k_soft("predictor", 3))


@query("q_k_smallest", TOP.format(o="x"))
def smallest(spark: SparkSession, d: str) -> DataFrame:
    return exploded(heads(spark, d), R.k_smallest("predictor", 3))


@query(
    "q_topk_near_best",
    f"""WITH x AS (SELECT vec_id, unnest(range(0, 8)) AS i, unnest({slot('predictor')}) AS x FROM embeddings),
    o AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r, x >= max(x) OVER (PARTITION BY vec_id) - 0.05 AS near FROM x),
    a AS (SELECT vec_id, i, 0 AS g, r FROM o WHERE near UNION ALL SELECT vec_id, i, 1, r FROM o)
    SELECT vec_id, place - 1 AS place, i AS id FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY g, r) AS place FROM a) WHERE place <= 4""",
)
def near_best(spark: SparkSession, d: str) -> DataFrame:
    return exploded(heads(spark, d), R.near_best("predictor", 4, 0.05))


BITS = "CAST(floor(100 * (1 + abs(CAST(x AS DOUBLE)))) AS BIGINT)"


@query("q_proj_top2", f"SELECT vec_id, r - 1 AS place, i AS id FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY b, i) AS r FROM (SELECT vec_id, unnest(range(0, 8)) AS i, unnest(list_transform(embedding[1:8], lambda x: {BITS})) AS b FROM embeddings)) WHERE r <= 2")
def projected_top2(spark: SparkSession, d: str) -> DataFrame:
    return exploded(heads(spark, d), R.k_smallest(bits_of("predictor"), 2))


def bits_of(h: str) -> Column:
    return F.transform(h, lambda x: F.floor(100 * (1 + F.abs(x))))


@query("q_proj_scores", f"SELECT vec_id, unnest(range(0, 8)) AS i, round(unnest(list_transform(embedding[1:8], lambda x: -ln(1 + CASE WHEN x > 0.3 THEN 1e30 ELSE CAST({BITS} AS DOUBLE) END))), 6) AS s FROM embeddings")
def projected_scores(spark: SparkSession, d: str) -> DataFrame:
    """Bits as scores; a sentinel (here: components above 0.3) counts as 1e30 bits."""
    s = F.transform("predictor", lambda x: -F.log1p(F.when(x > F.lit(0.3).cast("double"), F.lit(1e30)).otherwise(F.floor(100 * (1 + F.abs(x))).cast("double"))))
    rows = heads(spark, d).select("vec_id", F.posexplode(s).alias("i", "s"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("s")).alias("s"))


@query("q_log_softmax", f"WITH x AS (SELECT vec_id, unnest(range(0, 8)) AS i, unnest({slot('predictor')}) AS x FROM embeddings) SELECT vec_id, i, round(x - max(x) OVER w - ln(sum(exp(x - m)) OVER w), 6) + 0.0 AS lp FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM x) WINDOW w AS (PARTITION BY vec_id)")
def log_softmax(spark: SparkSession, d: str) -> DataFrame:
    rows = heads(spark, d).select("vec_id", F.posexplode(R.log_softmax("predictor")).alias("i", "lp"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("lp")).alias("lp"))


def beam_sql(keep: int, soft: bool) -> str:
    tops = ", ".join(f"t_{h} AS (SELECT * FROM (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM (SELECT vec_id, unnest(range(0, {HEADS[h][1]})) AS i, unnest({slot(h)}) AS x FROM embeddings)) WHERE r <= {k})" for h, k in WIDTHS.items())
    rank = "(((t_predictor.i * 96 + t_cf_perm.i * 16 + t_cf_primary.i * 4 + t_cf_secondary.i) * 8 + t_reorder.i) * 2 + t_interleave.i)"
    score = "((((t_predictor.x + t_cf_perm.x) + t_cf_primary.x) + t_cf_secondary.x) + t_reorder.x) + t_interleave.x"
    joins = " ".join(f"JOIN t_{h} USING (vec_id)" for h in list(WIDTHS)[1:])
    bonus = " + (12287 - tuple_rank) * 1e-6" if soft else ""
    return f"WITH {tops}, c AS (SELECT vec_id, {rank} AS tuple_rank, {score} AS score FROM t_predictor {joins}), b AS (SELECT vec_id, tuple_rank, score, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9){bonus} DESC, tuple_rank) AS rank FROM c QUALIFY rank <= {keep})"


def beams(spark: SparkSession, d: str, keep: int, soft: bool = False) -> DataFrame:
    return R.beam(heads(spark, d), "vec_id", {h: (h, k) for h, k in WIDTHS.items()}, keep, soft)


@query("q_beam_cross", beam_sql(5, False) + " SELECT vec_id, rank, tuple_rank, round(score, 6) + 0.0 AS score FROM b")
def beam_cross(spark: SparkSession, d: str) -> DataFrame:
    return beams(spark, d, 5).withColumn("score", r6(F.col("score")))


@query("q_beam_topk", beam_sql(3, True) + " SELECT vec_id, rank, tuple_rank, round(score, 6) + 0.0 AS score FROM b")
def beam_topk(spark: SparkSession, d: str) -> DataFrame:
    return beams(spark, d, 3, True).withColumn("score", r6(F.col("score")))


TRUTH = "(((label % 8) * 96 + (vec_id % 6) * 16 + (vec_id % 4) * 4 + (label % 4)) * 8 + (vec_id % 8)) * 2 + vec_id % 2"


def truth() -> Column:
    v, label = F.col("vec_id"), F.col("label").cast("long")
    return S.tuple_rank(label % 8, S.join_filter(v % 6, v % 4, label % 4), v % 8, v % 2)


def beams_with_truth(spark: SparkSession, d: str, keep: int) -> DataFrame:
    best = beams(spark, d, keep).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tuple_rank"))), lambda t: t["tuple_rank"]).alias("found"))
    return heads(spark, d).select("vec_id", truth().alias("truth")).join(best, "vec_id")


FOUND = beam_sql(32, False) + f", t AS (SELECT vec_id, {TRUTH} AS truth FROM embeddings), f AS (SELECT t.vec_id, min(CASE WHEN b.tuple_rank = t.truth THEN b.rank END) AS found_at FROM t JOIN b USING (vec_id) GROUP BY t.vec_id)"


@query("q_hit_at_n", FOUND + " SELECT vec_id, CAST(found_at IS NOT NULL AS BIGINT) AS hit FROM f")
def hit(spark: SparkSession, d: str) -> DataFrame:
    return beams_with_truth(spark, d, 32).select("vec_id", F.array_contains("found", F.col("truth")).cast("long").alias("hit"))


@query("q_position_in_candidates", FOUND + " SELECT vec_id, coalesce(found_at - 1, -1) AS place FROM f")
def position(spark: SparkSession, d: str) -> DataFrame:
    return beams_with_truth(spark, d, 32).select("vec_id", (F.array_position("found", F.col("truth")) - 1).alias("place"))


@query("q_hit_rates", FOUND + " SELECT " + ", ".join(f"round(avg(CASE WHEN found_at <= {n} THEN 1.0 ELSE 0.0 END), 6) AS hit{n}" for n in (1, 3, 10, 32)) + " FROM f")
def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    at = F.array_position("found", F.col("truth"))
    rows = beams_with_truth(spark, d, 32)
    return rows.agg(*(r6(F.avg(F.when((at > 0) & (at <= n), 1.0).otherwise(0.0))).alias(f"hit{n}") for n in (1, 3, 10, 32)))


@query("q_negatives_anti", beam_sql(8, False) + f", t AS (SELECT vec_id, {TRUTH} AS truth FROM embeddings) SELECT b.vec_id, b.tuple_rank FROM b JOIN t USING (vec_id) WHERE b.tuple_rank <> t.truth")
def negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = beams_with_truth(spark, d, 8)
    return rows.select("vec_id", F.explode(F.filter("found", lambda c: c != F.col("truth"))).alias("tuple_rank"))


@query("q_infer_top3", beam_sql(3, False) + " SELECT vec_id, rank, tuple_rank // 1536 AS predictor, (tuple_rank // 16) % 96 AS filter_code, (tuple_rank // 2) % 8 AS reorder, tuple_rank % 2 AS interleave FROM b")
def infer(spark: SparkSession, d: str) -> DataFrame:
    return beams(spark, d, 3).select("vec_id", "rank", *(c.cast("long").alias(n) for n, c in S.split_rank("tuple_rank").items()))


@query(
    "q_triad_topk",
    f"""WITH p AS (SELECT vec_id, unnest(range(0, 8)) AS p, unnest({slot('predictor')}) AS sp FROM embeddings), r AS (SELECT vec_id, unnest(range(0, 8)) AS r, unnest({slot('reorder')}) AS sr FROM embeddings),
    f AS (SELECT vec_id, f, CAST(embedding[f % 6 + 9] AS DOUBLE) + f * 0.0001 AS sf FROM embeddings, range(0, 192) t(f)),
    c AS (SELECT vec_id, (p * 192 + f) * 8 + r AS triad, sp + sf + sr AS s FROM p JOIN f USING (vec_id) JOIN r USING (vec_id))
    SELECT vec_id, rank, triad FROM (SELECT vec_id, triad, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, triad) AS rank FROM c) WHERE rank <= 3""",
)
def triads(spark: SparkSession, d: str) -> DataFrame:
    """Three scores of 8, 192 and 8 classes: the best sums of all 12,288 are among the three best of each, ties by number."""
    f = F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: F.get("embedding", (i % 6 + 8).cast("int")).cast("double") + i * 0.0001)
    rows = heads(spark, d).join(X.table(spark, d, "embeddings").select("vec_id", f.alias("filter_i")), "vec_id")
    best = lambda h, n: F.transform(R.top_k(h, n), lambda i: F.struct(i.alias("i"), F.get(F.col(h), i.cast("int")).alias("s")))
    rows = rows.select("vec_id", best("predictor", 8).alias("p"), best("filter_i", 12).alias("f"), best("reorder", 8).alias("r"))
    rows = rows.select("vec_id", F.explode("p").alias("p"), "f", "r").select("vec_id", "p", F.explode("f").alias("f"), "r").select("vec_id", "p", "f", F.explode("r").alias("r"))
    rows = rows.select("vec_id", S.triad("p.i", "f.i", "r.i").alias("triad"), F.round(F.col("p.s") + F.col("f.s") + F.col("r.s"), 9).alias("s"))
    three = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "triad"))), 1, 3)
    out = rows.groupBy("vec_id").agg(three.alias("t")).select("vec_id", F.posexplode("t").alias("n", "t"))
    return out.select("vec_id", (F.col("n") + 1).cast("long").alias("rank"), F.col("t.triad").alias("triad"))


@query("q_linear_forward", "SELECT vec_id, unnest(range(0, 4)) AS i, round(unnest(list_transform(range(0, 4), lambda o: greatest(0, list_sum(list_transform(range(0, 64), lambda k: CAST(embedding[k + 1] AS DOUBLE) * ((k * 7 + o * 13) % 11 - 5) / 10)) + o * 0.01))), 6) + 0.0 AS y FROM embeddings")
def linear(spark: SparkSession, d: str) -> DataFrame:
    """One dense layer with a ramp, in the JVM; weights are an array literal."""
    weights = [[((k * 7 + o * 13) % 11 - 5) / 10 for k in range(64)] for o in range(4)]
    out = F.array(*(F.greatest(F.lit(0.0), F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, w)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) + o * 0.01) for o, w in enumerate(weights)))
    rows = X.table(spark, d, "embeddings").select("vec_id", F.posexplode(out).alias("i", "y"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("y")).alias("y"))


# Priors, targets, losses.

PAIR = f"WITH {X.CAND_SQL}, {X.BEST_SQL}, {X.LAB_SQL}"


@query("q_filterbits_prior", f"WITH b AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: {BITS}) AS b FROM embeddings) SELECT vec_id, unnest(range(0, 8)) AS i, round(unnest(list_transform(b, lambda x: -(x - list_min(b)) / 4.0)), 6) + 0.0 AS v FROM b")
def filter_prior(spark: SparkSession, d: str) -> DataFrame:
    return prior(heads(spark, d), R.bits_prior(bits_of("predictor"), 4.0))


@query("q_energy_prior", "SELECT vec_id, unnest(range(0, 8)) AS i, round(unnest(list_transform(embedding[1:8], lambda x: -ln(1 + greatest(CAST(x AS DOUBLE) * 1000, 0) + 1e-6) / 2.0)), 6) + 0.0 AS v FROM embeddings")
def energy_prior(spark: SparkSession, d: str) -> DataFrame:
    return prior(heads(spark, d), R.energy_prior(F.transform("predictor", lambda x: x * 1000), 2.0))


@query("q_bits_prior", f"WITH b AS (SELECT vec_id, list_transform(range(1, 9), lambda k: least(list_transform(embedding[1:8], lambda x: {BITS})[k], list_transform(embedding[23:30], lambda x: {BITS})[k])) AS b FROM embeddings) SELECT vec_id, unnest(range(0, 8)) AS i, round(unnest(list_transform(b, lambda x: -(x - list_min(b)) / 4.0)), 6) + 0.0 AS v FROM b")
def bits_prior(spark: SparkSession, d: str) -> DataFrame:
    """The smaller bits of both interleave modes."""
    return prior(heads(spark, d), R.bits_prior(F.zip_with(bits_of("predictor"), bits_of("reorder"), lambda a, b: F.least(a, b)), 4.0))


def prior(rows: DataFrame, c: Column) -> DataFrame:
    out = rows.select("vec_id", F.posexplode(c).alias("i", "v"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


@query("q_soft_targets_margin", f"{PAIR}, w AS (SELECT block_id, CASE WHEN second_bits IS NULL THEN 0.0 ELSE exp(-greatest(0, second_bits - best_bits) / 50.0) END AS w FROM lab) SELECT block_id, round(1 / (1 + w), 6) AS first, round(w / (1 + w), 6) AS second FROM w")
def margin_targets(spark: SparkSession, d: str) -> DataFrame:
    a, b = R.soft_targets(F.col("best_bits"), F.col("second_bits"), 50.0)
    return X.labels(spark, d).select("block_id", r6(a).alias("first"), r6(b).alias("second"))


@query("q_soft_targets_abs", f"{PAIR}, w AS (SELECT block_id, exp(-best_bits / 50.0) AS a, CASE WHEN second_bits IS NULL THEN 0.0 ELSE exp(-second_bits / 50.0) END AS b FROM lab) SELECT block_id, round(a / greatest(a + b, 1e-12), 6) AS first, round(b / greatest(a + b, 1e-12), 6) AS second FROM w")
def absolute_targets(spark: SparkSession, d: str) -> DataFrame:
    a, b = R.soft_targets_absolute(F.col("best_bits"), F.col("second_bits"), 50.0)
    return X.labels(spark, d).select("block_id", r6(a).alias("first"), r6(b).alias("second"))


SMOOTH = f"{PAIR}, h AS (SELECT block_id, b // 1536 AS b, s // 1536 AS s FROM lab), x AS (SELECT *, unnest(range(0, 8)) AS i FROM h)"


@query("q_label_smoothing", f"{SMOOTH} SELECT block_id, i, round(0.8 * CASE WHEN s IS NOT NULL AND s <> b THEN CASE WHEN i IN (b, s) THEN 0.5 ELSE 0 END WHEN i = b THEN 1 ELSE 0 END + 0.2 / 8, 6) AS t FROM x")
def smoothing(spark: SparkSession, d: str) -> DataFrame:
    t = R.smoothed(F.col("best_predictor"), F.col("second_predictor"), 8, 0.2)
    rows = X.labels(spark, d).select("block_id", F.posexplode(t).alias("i", "t"))
    return rows.select("block_id", F.col("i").cast("long").alias("i"), r6(F.col("t")).alias("t"))


LP = f"WITH x AS (SELECT vec_id, label, unnest(range(0, 8)) AS i, unnest({slot('predictor')}) AS x FROM embeddings), m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM x), lp AS (SELECT vec_id, label, i, x - m - ln(sum(exp(x - m)) OVER (PARTITION BY vec_id)) AS lp FROM m)"


@query("q_soft_ce", f"{LP} SELECT round(avg(l), 6) AS loss FROM (SELECT vec_id, -sum(CASE WHEN i = label % 8 THEN 0.7 * lp ELSE 0 END + CASE WHEN i = vec_id % 8 THEN 0.3 * lp ELSE 0 END) AS l FROM lp GROUP BY vec_id)")
def soft_ce(spark: SparkSession, d: str) -> DataFrame:
    loss = R.soft_cross_entropy("predictor", F.col("label") % 8, F.col("vec_id") % 8, F.lit(0.7), F.lit(0.3))
    return heads(spark, d).agg(r6(F.avg(loss)).alias("loss"))


@query("q_top2_ce", f"{LP} SELECT round(avg(l), 6) AS loss FROM (SELECT vec_id, -ln(sum(CASE WHEN i IN (label % 8, vec_id % 8) THEN exp(lp) ELSE 0 END) + 1e-12) AS l FROM lp GROUP BY vec_id)")
def top2_ce(spark: SparkSession, d: str) -> DataFrame:
    """Minus the log of the probability that best and second have together."""
    rows = heads(spark, d).withColumn("lp", R.log_softmax("predictor"))
    both = F.aggregate(F.array_distinct(F.array((F.col("label") % 8).cast("long"), F.col("vec_id") % 8)), F.lit(0.0), lambda s, i: s + F.exp(F.get("lp", i.cast("int"))))
    return rows.agg(r6(F.avg(-F.log(both + 1e-12))).alias("loss"))


@query("q_nce_loss", f"{LP} SELECT round(avg(-lp), 6) AS loss FROM lp WHERE i = label % 8")
def nce(spark: SparkSession, d: str) -> DataFrame:
    """The positive's log-probability among all candidates of the row."""
    return heads(spark, d).agg(r6(F.avg(-F.get(R.log_softmax("predictor"), (F.col("label") % 8).cast("int")))).alias("loss"))


@query("q_distill_kl", f"WITH x AS (SELECT vec_id, unnest(range(0, 8)) AS i, unnest({slot('predictor')}) / 2 AS t, unnest({slot('reorder')}) / 2 AS s FROM embeddings), m AS (SELECT *, max(t) OVER (PARTITION BY vec_id) AS mt, max(s) OVER (PARTITION BY vec_id) AS ms FROM x), lp AS (SELECT vec_id, t - mt - ln(sum(exp(t - mt)) OVER (PARTITION BY vec_id)) AS lt, s - ms - ln(sum(exp(s - ms)) OVER (PARTITION BY vec_id)) AS ls FROM m) SELECT round(avg(k) * 4, 6) AS loss FROM (SELECT vec_id, sum(exp(lt) * (lt - ls)) AS k FROM lp GROUP BY vec_id)")
def distill(spark: SparkSession, d: str) -> DataFrame:
    """Divergence of a student's head from a teacher's at temperature 2, times the temperature squared."""
    at2 = lambda h: R.log_softmax(F.transform(h, lambda x: x / 2))
    rows = heads(spark, d).withColumn("t", at2("predictor")).withColumn("s", at2("reorder"))
    kl = F.aggregate(F.zip_with("t", "s", lambda t, s: F.exp(t) * (t - s)), F.lit(0.0), lambda a, x: a + x)
    return rows.agg(r6(F.avg(kl) * 4).alias("loss"))


@query("q_head_metrics", f"{LP}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, i) AS r FROM lp) SELECT " + ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0.0 END), 6) AS top{k}" for k in (1, 2, 4)) + ", round(avg(lp), 6) AS mean_log_prob FROM r WHERE i = label % 8")
def head_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = heads(spark, d).withColumn("y", (F.col("label") % 8).cast("long"))
    top = lambda k: r6(F.avg(F.array_contains(R.top_k("predictor", k), F.col("y")).cast("double"))).alias(f"top{k}")
    return rows.agg(top(1), top(2), top(4), r6(F.avg(F.get(R.log_softmax("predictor"), F.col("y").cast("int")))).alias("mean_log_prob"))
