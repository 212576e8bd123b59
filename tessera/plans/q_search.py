"""Queries over candidate settings and block labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dataset, search
from . import fixtures as X
from .registry import query

CAND, BEST, LAB = f"WITH {X.CAND_SQL}", f"WITH {X.CAND_SQL}, {X.BEST_SQL}", f"WITH {X.CAND_SQL}, {X.BEST_SQL}, {X.LAB_SQL}"
PERM, PRIMARY, SECONDARY = "(({0} // 16) % 6)", "(({0} // 4) % 4)", "({0} % 4)"


def rank_part(r: str, part: str) -> str:
    code = f"(({r} // 16) % 96)"
    return {"predictor": f"({r} // 1536)", "filter_code": code, "reorder": f"(({r} // 2) % 8)", "interleave": f"({r} % 2)", "cf_perm": PERM.format(code), "cf_primary": PRIMARY.format(code), "cf_secondary": SECONDARY.format(code)}[part]


@query("q_best_second", f"{BEST} SELECT block_id, tuple_rank, bits, rn FROM best_second")
def best_second(spark: SparkSession, d: str) -> DataFrame:
    return search.best_second(X.candidates(spark, d), "block_id")


@query(
    "q_proj_min_grouping_sets",
    f"{CAND} "
    + " UNION ALL ".join(
        f"SELECT block_id, '{h}' AS head, {e} AS class, min(bits) AS bits FROM cand GROUP BY ALL"
        for h, e in {"predictor": "predictor", "cf_perm": PERM.format("filter_code"), "cf_primary": PRIMARY.format("filter_code"), "cf_secondary": SECONDARY.format("filter_code"), "reorder": "reorder", "interleave": "interleave"}.items()
    ),
)
def projected_minima(spark: SparkSession, d: str) -> DataFrame:
    heads = {"predictor": F.col("predictor"), "cf_perm": S.filter_perm("filter_code"), "cf_primary": S.filter_primary("filter_code"), "cf_secondary": S.filter_secondary("filter_code"), "reorder": F.col("reorder"), "interleave": F.col("interleave")}
    return search.projected_minima(X.candidates(spark, d), "block_id", {h: (c, X.HEADS[h]) for h, c in heads.items()})


@query("q_min_by_filter_pivot", f"{CAND} SELECT block_id, " + ", ".join(f"coalesce(min(bits) FILTER (WHERE predictor = {v} AND interleave = {w}), -1) AS predictor{v}_interleave{w}" for w in (0, 1) for v in range(8)) + " FROM cand GROUP BY block_id")
def min_pivot(spark: SparkSession, d: str) -> DataFrame:
    return search.conditional_minima(X.candidates(spark, d), "block_id", "predictor", 8, "interleave")


@query("q_filter_rolldown", f"{CAND} SELECT block_id, {PERM.format('filter_code')} AS perm, {PRIMARY.format('filter_code')} AS primary_mode, {SECONDARY.format('filter_code')} AS secondary_mode, min(bits) AS bits FROM cand GROUP BY ALL")
def rolldown(spark: SparkSession, d: str) -> DataFrame:
    by = X.candidates(spark, d).groupBy("block_id", "filter_code").agg(F.min("bits").alias("bits"))
    return by.groupBy("block_id", S.filter_perm("filter_code").alias("perm"), S.filter_primary("filter_code").alias("primary_mode"), S.filter_secondary("filter_code").alias("secondary_mode")).agg(F.min("bits").alias("bits"))


@query(
    "q_top2pred_min",
    f"""{CAND}, e AS (SELECT block_id, predictor, min(energy) AS energy FROM cand GROUP BY ALL),
    t AS (SELECT block_id, predictor FROM e QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY energy, predictor) <= 2)
    SELECT block_id, filter_code, min(bits) AS bits FROM cand JOIN t USING (block_id, predictor) GROUP BY ALL""",
)
def top2(spark: SparkSession, d: str) -> DataFrame:
    return search.top_predictors_minima(X.candidates(spark, d), "block_id")


ORDER = ["trial", "tuple_rank", "bits", "energy"]


@query(
    "q_prune_running_min",
    f"""{CAND}, m AS (SELECT *, min(energy) OVER (PARTITION BY block_id ORDER BY trial, tuple_rank, bits, energy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM cand)
    SELECT block_id, trial, tuple_rank, bits, energy FROM m WHERE b IS NULL OR energy <= 1.3 * b""",
)
def prune(spark: SparkSession, d: str) -> DataFrame:
    return search.pruned(X.candidates(spark, d), "block_id", ORDER).select("block_id", *ORDER)


@query(
    "q_rank_prefix_hits",
    f"""{CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY bits, tuple_rank, trial, energy) AS rank FROM cand)
    SELECT block_id, rank, tuple_rank, CAST(max(CAST(interleave = 0 AS INTEGER)) OVER (PARTITION BY block_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hit FROM r""",
)
def prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.prefix_hits(X.candidates(spark, d), "block_id", ["bits", "tuple_rank", "trial", "energy"], F.col("interleave") == 0).select("block_id", "rank", "tuple_rank", "hit")


@query("q_tuple_rank", f"{CAND} SELECT DISTINCT tuple_rank, predictor, filter_code, reorder, interleave, filter_code + 96 * interleave AS filter_i, (predictor * 192 + filter_code + 96 * interleave) * 8 + reorder AS triad FROM cand")
def ranks(spark: SparkSession, d: str) -> DataFrame:
    parts = S.split_rank("tuple_rank")
    rows = X.candidates(spark, d).select("tuple_rank").distinct().select("tuple_rank", *(c.cast("long").alias(n) for n, c in parts.items()))
    rows = rows.withColumn("filter_i", S.filter_i("filter_code", "interleave"))
    return rows.withColumn("triad", S.triad("predictor", "filter_i", "reorder"))


@query("q_split_filter", f"{CAND} SELECT DISTINCT filter_code, {PERM.format('filter_code')} AS perm, {PRIMARY.format('filter_code')} AS primary_mode, {SECONDARY.format('filter_code')} AS secondary_mode FROM cand")
def split_filter(spark: SparkSession, d: str) -> DataFrame:
    return X.candidates(spark, d).select("filter_code").distinct().select("filter_code", S.filter_perm("filter_code").alias("perm"), S.filter_primary("filter_code").alias("primary_mode"), S.filter_secondary("filter_code").alias("secondary_mode"))


@query("q_join_filter", "SELECT DISTINCT ((l_partkey % 7) % 6) * 16 + ((l_suppkey % 5) % 4) * 4 + (l_orderkey % 9) % 4 AS filter_code, l_partkey % 7 AS perm, l_suppkey % 5 AS primary_mode, l_orderkey % 9 AS secondary_mode FROM lineitem")
def join_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "lineitem").select((F.col("l_partkey") % 7).alias("perm"), (F.col("l_suppkey") % 5).alias("primary_mode"), (F.col("l_orderkey") % 9).alias("secondary_mode")).distinct()
    return rows.withColumn("filter_code", S.join_filter("perm", "primary_mode", "secondary_mode"))


PARTS = ["predictor", "filter_code", "reorder", "interleave", "cf_perm", "cf_primary", "cf_secondary"]


@query("q_label_records", f"{LAB} SELECT block_id, best_bits, coalesce(second_bits, -1) AS second_bits, " + ", ".join(f"coalesce({rank_part(r, p)}, -1) AS {s}_{p}" for s, r in (("best", "b"), ("second", "s")) for p in PARTS) + " FROM lab")
def label_records(spark: SparkSession, d: str) -> DataFrame:
    return X.labels(spark, d).drop("b", "s").fillna(-1)


@query("q_n_classes", f"{LAB} SELECT " + ", ".join(f"max(greatest({rank_part('b', h)}, coalesce({rank_part('s', h)}, 0))) + 1 AS {h}" for h in X.HEADS) + " FROM lab")
def n_classes(spark: SparkSession, d: str) -> DataFrame:
    return dataset.class_counts(X.labels(spark, d), list(X.HEADS))


@query("q_label_range_violations", f"{LAB} SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE {rank_part('b', h)} > {n - 2} OR coalesce({rank_part('s', h)}, -1) > {n - 2}) AS BIGINT) AS {h}" for h, n in X.HEADS.items()) + " FROM lab")
def violations(spark: SparkSession, d: str) -> DataFrame:
    """With each head's largest class declared out of range, so that there are violations to count."""
    return dataset.range_violations(X.labels(spark, d), {h: n - 1 for h, n in X.HEADS.items()})


@query("q_bits_sidecar", f"{LAB} SELECT block_id, best_bits, coalesce(second_bits, 9223372036854775807) AS second_bits FROM lab")
def sidecar(spark: SparkSession, d: str) -> DataFrame:
    """A missing second is the largest long, which stands for the unsigned sentinel."""
    return X.labels(spark, d).select("block_id", "best_bits", F.coalesce("second_bits", F.lit((1 << 63) - 1)).alias("second_bits"))


REASON_SQL = f"""{LAB}, e AS (SELECT block_id,
  CASE WHEN block_id % 11 = 0 THEN 'block_size' WHEN block_id % 5 NOT IN (3, 4) THEN 'components' WHEN s IS NULL THEN 'missing_second'
       WHEN {rank_part('b', 'interleave')} = 1 AND {rank_part('s', 'interleave')} = 1 THEN 'entropy' WHEN {rank_part('s', 'predictor')} = {rank_part('b', 'predictor')} THEN 'same_tuple' END AS reason FROM lab)"""


def eligible(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("block_id")
    rules = [
        ("block_size", b % 11 == 0),
        ("components", ~(b % 5).isin(3, 4)),
        ("missing_second", F.col("s").isNull()),
        ("entropy", (F.col("best_interleave") == 1) & (F.col("second_interleave") == 1)),
        ("same_tuple", F.col("second_predictor") == F.col("best_predictor")),
    ]
    return X.labels(spark, d).withColumn("reason", dataset.first_reason(rules))


@query("q_eligibility_reason", f"{REASON_SQL} SELECT block_id, reason FROM e")
def reasons(spark: SparkSession, d: str) -> DataFrame:
    return eligible(spark, d).select("block_id", "reason")


@query("q_eligibility_mask", f"{REASON_SQL} SELECT block_id, CAST(reason IS NULL AS BIGINT) AS eligible FROM e")
def mask(spark: SparkSession, d: str) -> DataFrame:
    return eligible(spark, d).select("block_id", F.col("reason").isNull().cast("long").alias("eligible"))


@query("q_drop_reasons", f"{REASON_SQL} SELECT reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY reason")
def drops(spark: SparkSession, d: str) -> DataFrame:
    return eligible(spark, d).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_consistency_counts",
    f"""{LAB} SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE b IS DISTINCT FROM o_custkey) AS BIGINT) AS best_differs,
    CAST(count(*) FILTER (WHERE s IS DISTINCT FROM NULLIF(o_custkey % 1000, 0)) AS BIGINT) AS second_differs FROM lab JOIN orders ON block_id = o_orderkey""",
)
def consistency(spark: SparkSession, d: str) -> DataFrame:
    other = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id"), F.col("o_custkey").alias("best"), F.nullif(F.col("o_custkey") % 1000, F.lit(0)).alias("second"))
    return dataset.mismatches(X.labels(spark, d), other, "block_id", {"best_differs": ("b", "best"), "second_differs": ("s", "second")})


ROUTE = "CASE WHEN interleave = 1 THEN 6 + {k} WHEN c IN (0, 3) THEN 3 * {k} ELSE 3 * {k} + c END"


@query("q_golomb_row_route", f"{CAND} SELECT DISTINCT k, c, interleave, CAST({ROUTE.format(k='k')} AS BIGINT) AS row FROM (SELECT trial % 2 AS k, tuple_rank % 4 AS c, interleave FROM cand)")
def route(spark: SparkSession, d: str) -> DataFrame:
    """Which cost table row codes a component: k 0 plain, 1 run-length."""
    from ..functions import costs

    rows = X.candidates(spark, d).select((F.col("trial") % 2).alias("k"), (F.col("tuple_rank") % 4).alias("c"), "interleave").distinct()
    return rows.withColumn("row", costs.row_route("k", "c", "interleave"))


@query("q_sideinfo_pack", f"{CAND} SELECT DISTINCT filter_code, interleave AS mode, trial % 5 AS diff, predictor AS plain, filter_code + interleave * 128 + (trial % 5) * 256 + predictor * 2048 AS packed FROM cand")
def side_info(spark: SparkSession, d: str) -> DataFrame:
    rows = X.candidates(spark, d).select("filter_code", F.col("interleave").alias("mode"), (F.col("trial") % 5).alias("diff"), F.col("predictor").alias("plain")).distinct()
    return rows.withColumn("packed", S.side_info("filter_code", "mode", "diff", "plain"))


@query(
    "q_cross_config",
    "SELECT p AS predictor, f AS filter_code, r AS reorder, i AS interleave, ((p * 96 + f) * 8 + r) * 2 + i AS tuple_rank FROM range(8) a(p), range(96) b(f), range(8) c(r), range(2) e(i)",
)
def configurations(spark: SparkSession, d: str) -> DataFrame:
    """All setting tuples: a table of fixed size (12,288 rows) that a search broadcasts."""
    n = spark.range(12288).select(F.col("id").alias("tuple_rank"))
    return n.select(*(c.cast("long").alias(k) for k, c in S.split_rank("tuple_rank").items()), "tuple_rank")


@query(
    "q_run_lengths",
    f"""{CAND}, o AS (SELECT block_id, predictor, row_number() OVER w AS pos, lag(predictor) OVER w AS before FROM cand WINDOW w AS (PARTITION BY block_id ORDER BY trial, tuple_rank, bits, energy)),
    g AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM predictor THEN 1 ELSE 0 END) OVER (PARTITION BY block_id ORDER BY pos) AS grp FROM o)
    SELECT block_id, CAST(grp AS BIGINT) AS run, any_value(predictor) AS value, count(*) AS length FROM g GROUP BY block_id, grp""",
)
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    return dataset.runs(X.candidates(spark, d), ["block_id"], ORDER, "predictor")


@query(
    "q_same_as_prev_bits",
    f"""{CAND}, o AS (SELECT block_id, predictor, lag(predictor) OVER (PARTITION BY block_id ORDER BY trial, tuple_rank, bits, energy) AS before FROM cand)
    SELECT block_id, count(*) AS n, CAST(count(*) FILTER (WHERE before = predictor) AS BIGINT) AS same FROM o GROUP BY block_id""",
)
def same_as_previous(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("block_id").orderBy(*ORDER)
    rows = dataset.by_key(X.candidates(spark, d).select("block_id", *ORDER, "predictor"), ["block_id"]).withColumn("same", F.lag("predictor").over(w) == F.col("predictor"))
    return rows.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same"))


@query(
    "q_zero_runs",
    f"""{CAND}, o AS (SELECT block_id, CAST(interleave <> 0 AS BIGINT) AS nz, row_number() OVER w AS pos, lag(CAST(interleave <> 0 AS BIGINT)) OVER w AS before FROM cand WINDOW w AS (PARTITION BY block_id ORDER BY trial, tuple_rank, bits, energy)),
    g AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM nz THEN 1 ELSE 0 END) OVER (PARTITION BY block_id ORDER BY pos) AS grp FROM o)
    SELECT block_id, CAST(grp AS BIGINT) AS run, any_value(nz) AS value, count(*) AS length FROM g GROUP BY block_id, grp""",
)
def zero_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = X.candidates(spark, d).withColumn("nz", (F.col("interleave") != 0).cast("long"))
    return dataset.runs(rows, ["block_id"], ORDER, "nz")


SEQ = f"""{CAND}, o AS (SELECT block_id, predictor, row_number() OVER w AS pos, lag(predictor) OVER w AS before FROM cand WINDOW w AS (PARTITION BY block_id ORDER BY trial, tuple_rank, bits, energy)),
 g AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM predictor THEN 1 ELSE 0 END) OVER (PARTITION BY block_id ORDER BY pos) AS grp FROM o),
 r AS (SELECT block_id, grp, count(*) AS len FROM g GROUP BY block_id, grp),
 c AS (SELECT block_id, CAST(sum(len) AS BIGINT) * 4 AS raw_bits, 4 + (CAST(sum(len) AS BIGINT) - 1) + (count(*) - 1) * 4 AS same_bits,
       CAST(sum(4 + 8 * CASE WHEN len - 1 < 128 THEN 1 ELSE 2 END) AS BIGINT) AS run_bits FROM r GROUP BY block_id)"""


@query("q_sequence_bits", f"{SEQ} SELECT block_id, raw_bits, same_bits, run_bits FROM c")
def sequence_bits(spark: SparkSession, d: str) -> DataFrame:
    return dataset.sequence_costs(X.candidates(spark, d), ["block_id"], ORDER, "predictor", 4)


@query("q_best_sequence_mode", f"{SEQ} SELECT block_id, CAST(CASE WHEN raw_bits <= same_bits AND raw_bits <= run_bits THEN 0 WHEN same_bits <= run_bits THEN 1 ELSE 2 END AS BIGINT) AS mode, least(raw_bits, same_bits, run_bits) AS bits FROM c")
def best_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset.sequence_costs(X.candidates(spark, d), ["block_id"], ORDER, "predictor", 4)
    best = F.array_min(F.array(*(F.struct(F.col(c).alias("bits"), F.lit(i).cast("long").alias("mode")) for i, c in enumerate(("raw_bits", "same_bits", "run_bits")))))
    return rows.select("block_id", best["mode"].alias("mode"), best["bits"].alias("bits"))
