"""Queries on samples, targets, losses, rerankers and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ranking as R
from ..operators import training as G
from . import fixtures as X
from .q_more import RAW, layer, layer_sql
from .q_ranking import LP, beam_sql, beams, head_scores, heads, r6, slot, triads
from .registry import query

PAIR = f"WITH {X.CAND_SQL}, {X.BEST_SQL}, {X.LAB_SQL}"


# Scans of records and features.


@query(
    "q_lenient_features",
    """WITH f AS (SELECT CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE CAST(props->>'k' AS DOUBLE) END AS x FROM events)
    SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM f""",
)
def lenient_features(spark: SparkSession, d: str) -> DataFrame:
    """A line that does not parse is a row of zeros and counts in mean and deviation; each seventh line is cut short here."""
    line = F.when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    x = F.coalesce(F.from_json(line, "k double")["k"], F.lit(0.0))
    return X.table(spark, d, "events").select(x.alias("x")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean"), r6(F.stddev_pop("x")).alias("std"))


@query("q_gather_records", f"{PAIR} SELECT block_id, b, s FROM lab WHERE block_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def gather_records(spark: SparkSession, d: str) -> DataFrame:
    """Of all records those of selected rows: a semi join."""
    wanted = X.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("block_id"))
    return X.labels(spark, d).join(wanted, "block_id", "left_semi").select("block_id", "b", "s")


@query(
    "q_packed_index_scan",
    """WITH i AS (SELECT conv_id, count(*) AS n, max(turn) + 1 AS expected FROM conversations GROUP BY conv_id)
    SELECT conv_id, n, n = expected AS complete FROM i ORDER BY conv_id LIMIT 100""",
)
def packed_index_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 entries of an index with the check of their counts; the limit is the scan's own."""
    index = X.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), (F.max("turn") + 1).alias("expected"))
    return index.orderBy("conv_id").limit(100).select("conv_id", "n", (F.col("n") == F.col("expected")).alias("complete"))


@query("q_inference_eligibility", "SELECT vec_id AS block_id, len(embedding) = 64 AND label % 5 IN (3, 4) AS eligible FROM embeddings")
def inference_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Only a block of 8 x 8 with three or four components goes to a model; the label stands for the components."""
    return X.blocks(spark, d).select("block_id", ((F.size("px") == 64) & (F.col("label") % 5).isin(3, 4)).alias("eligible"))


GROUPS = [("bits", [f"bits_{i}" for i in range(96)]), ("luma", [f"luma_{i}" for i in range(64)]), ("energy", [f"energy_{i}" for i in range(96)]), ("luma_again", [f"luma_{i}" for i in range(64)])]


@query(
    "q_column_budget",
    "WITH g AS ("
    + " UNION ALL ".join(f"SELECT {k} AS place, '{g}' AS grp, i, concat('{c[0].rsplit('_', 1)[0]}_', i) AS name FROM range(0, {len(c)}) t(i)" for k, (g, c) in enumerate(GROUPS))
    + "), n AS (SELECT *, row_number() OVER (ORDER BY place, i) - 1 AS position FROM g) SELECT position, grp, name FROM n WHERE position < 256",
)
def column_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, g, c) for i, (g, c) in enumerate(G.budgeted(GROUPS, 256))]
    return spark.createDataFrame(rows, "position long, grp string, name string")


@query(
    "q_head_map",
    """WITH t AS (SELECT p_partkey, p_size AS a, p_partkey % 20 AS b FROM part)
    SELECT p_partkey, CAST(greatest(1, least(a, 8)) AS BIGINT) AS predictor, CAST(greatest(1, least(b, 8)) AS BIGINT) AS reorder, CAST(2 AS BIGINT) AS interleave FROM t""",
)
def head_map(spark: SparkSession, d: str) -> DataFrame:
    """head=K words after a split that drops empty ones; widths are held between 1 and the head's classes, missing heads take all."""
    text = F.concat_ws(",", F.concat(F.lit("predictor="), "p_size"), F.lit(""), F.concat(F.lit("reorder="), F.col("p_partkey") % 20), F.lit(""))
    words = F.filter(F.transform(F.split(text, ","), lambda w: F.trim(w)), lambda w: w != "")
    widths = F.map_from_entries(F.transform(words, lambda w: F.struct(F.split_part(w, F.lit("="), F.lit(1)).alias("k"), F.split_part(w, F.lit("="), F.lit(2)).cast("long").alias("v"))))
    rows = X.table(spark, d, "part").withColumn("m", widths)
    held = lambda h: F.greatest(F.lit(1), F.least(F.coalesce(F.try_element_at("m", F.lit(h)), F.lit(X.HEADS[h])), F.lit(X.HEADS[h]))).cast("long").alias(h)
    return rows.select("p_partkey", held("predictor"), held("reorder"), held("interleave"))


NAMES = "CASE o_orderkey % 4 WHEN 0 THEN concat('a/', o_orderkey, '.BMP') WHEN 1 THEN concat('b.png/', o_orderkey) WHEN 2 THEN concat(o_orderkey, '.Png') ELSE concat(o_orderkey, '.bmp.txt') END"


@query("q_extension_test", f"SELECT o_orderkey, coalesce(lower(nullif(regexp_extract({NAMES}, '\\.([A-Za-z0-9]+)$', 1), '')) IN ('bmp', 'png'), false) AS is_image FROM orders")
def extension_test(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr(NAMES)
    return X.table(spark, d, "orders").select("o_orderkey", F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).isin("bmp", "png").alias("is_image"))


HASH = "list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(0, strlen(url)), lambda i: CAST(('0x' || substr(hex(encode(url)), 2 * i + 1, 2)) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@query("q_fnv1a", f"WITH h AS (SELECT page_id, {HASH} AS h FROM pages) SELECT page_id, CAST(h // 4294967296 AS BIGINT) AS hi, CAST(h % 4294967296 AS BIGINT) AS lo FROM h")
def fnv1a(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "pages").withColumn("h", G.fnv1a(G.byte_values(F.col("url")))).select("page_id", "h.hi", "h.lo")


@query("q_entropy_total", f"{PAIR} SELECT CAST(sum(best_bits) AS BIGINT) AS bits, count(*) AS blocks FROM lab")
def entropy_total(spark: SparkSession, d: str) -> DataFrame:
    return X.labels(spark, d).agg(F.sum("best_bits").alias("bits"), F.count(F.lit(1)).alias("blocks"))


@query(
    "q_consistency_examples",
    f"""{PAIR}, m AS (SELECT block_id, b // 1536 AS kept, o_custkey % 8 AS other FROM lab JOIN orders ON block_id = o_orderkey WHERE b // 1536 <> o_custkey % 8)
    SELECT kept, other, block_id FROM (SELECT *, row_number() OVER (PARTITION BY kept, other ORDER BY block_id) AS n FROM m) WHERE n <= 5""",
)
def consistency_examples(spark: SparkSession, d: str) -> DataFrame:
    """At most five examples of each kind of mismatch: partial top lists, so a frequent kind meets nowhere whole."""
    other = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("block_id"), (F.col("o_custkey") % 8).alias("other"))
    rows = X.labels(spark, d).join(other, "block_id").select("block_id", F.col("best_predictor").cast("long").alias("kept"), "other").where("kept <> other")
    salted = rows.groupBy("kept", "other", F.pmod(F.xxhash64("block_id"), F.lit(64)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list("block_id")), 1, 5).alias("few"))
    few = salted.groupBy("kept", "other").agg(F.slice(F.sort_array(F.flatten(F.collect_list("few"))), 1, 5).alias("few"))
    return few.select("kept", "other", F.explode("few").alias("block_id"))


# Samples and targets.


@query(
    "q_sampled_negatives",
    f"""{PAIR}, c AS (SELECT block_id, i, i = b // 1536 OR (s IS NOT NULL AND i = s // 1536) AS positive, md5(concat('17:', block_id, ':', i)) AS h FROM lab, range(0, 8) t(i))
    SELECT block_id, place, i, NOT positive AS valid FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY positive, h, i) - 1 AS place FROM c) WHERE place < 4""",
)
def sampled_negatives(spark: SparkSession, d: str) -> DataFrame:
    picked = G.sampled_negatives(F.col("block_id"), 8, [F.col("best_predictor"), F.col("second_predictor")], 4, 17)
    rows = X.labels(spark, d).select("block_id", F.posexplode(picked).alias("place", "n"))
    return rows.select("block_id", F.col("place").cast("long").alias("place"), "n.i", "n.valid")


@query("q_positive_pool", f"{PAIR} SELECT DISTINCT t AS class FROM (SELECT b AS t FROM lab UNION ALL SELECT s FROM lab) WHERE t IS NOT NULL")
def positive_pool(spark: SparkSession, d: str) -> DataFrame:
    return G.positive_pool(X.labels(spark, d).select(F.col("b").alias("best"), F.col("s").alias("second")))


@query(
    "q_heuristic_top2",
    f"WITH x AS (SELECT vec_id, unnest(range(0, 8)) AS i, unnest({slot('predictor')}) AS v FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY floor(v * 1000), i) AS n FROM x) SELECT vec_id, CAST(max(CASE WHEN n = 1 THEN i END) AS BIGINT) AS first, CAST(max(CASE WHEN n = 2 THEN i END) AS BIGINT) AS second FROM r WHERE n <= 2 GROUP BY vec_id",
)
def heuristic_top2(spark: SparkSession, d: str) -> DataFrame:
    """The two classes of fewest bits stand in for labels, ties to the smaller class."""
    bits = F.transform("predictor", lambda x, i: F.struct(F.floor(x * 1000).alias("bits"), i.cast("long").alias("i")))
    two = F.slice(F.array_sort(bits), 1, 2)
    return heads(spark, d).select("vec_id", two[0]["i"].alias("first"), two[1]["i"].alias("second"))


@query("q_trial_grid", "WITH a AS (SELECT DISTINCT l_returnflag AS arch FROM lineitem), f AS (SELECT DISTINCT l_linestatus AS feature FROM lineitem) SELECT row_number() OVER (ORDER BY feature, arch) - 1 AS trial, arch, feature FROM a, f")
def trial_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "lineitem")
    grid = G.trial_grid(rows.select(F.col("l_returnflag").alias("arch")).distinct(), rows.select(F.col("l_linestatus").alias("feature")).distinct())
    return grid.select(F.col("trial").cast("long").alias("trial"), "arch", "feature")


# Losses.

AT = lambda e: f"{slot('predictor')}[{e} + 1]"
PLUS = lambda x: f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


@query(
    "q_tuple_ranking_loss",
    f"WITH t AS (SELECT {AT('label % 8')} AS b, {AT('vec_id % 8')} AS s, {AT('(label + 3) % 8')} AS n FROM embeddings) SELECT round(avg({PLUS('(n - b)')} + 0.5 * {PLUS('(s - b)')} + 0.5 * {PLUS('(n - s)')}), 6) AS loss FROM t",
)
def tuple_ranking_loss(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.get("predictor", i.cast("int"))
    return heads(spark, d).agg(r6(F.avg(G.tuple_ranking_loss(at(F.col("label") % 8), at(F.col("vec_id") % 8), at((F.col("label") + 3) % 8)))).alias("loss"))


CUT = lambda h: f"list_transform({slot(h)}, lambda x: least(greatest(x * 1000, 0), 100))"


@query(
    "q_smooth_l1_loss",
    f"WITH t AS (SELECT {CUT('predictor')} AS a, {CUT('reorder')} AS b FROM embeddings), n AS (SELECT unnest(list_transform(a, lambda x: x / greatest(list_max(a), 1e-12))) AS x, unnest(list_transform(b, lambda x: x / greatest(list_max(b), 1e-12))) AS y FROM t) SELECT round(avg(CASE WHEN abs(x - y) < 1 THEN 0.5 * (x - y) * (x - y) ELSE abs(x - y) - 0.5 END), 6) AS loss FROM n",
)
def smooth_l1_loss(spark: SparkSession, d: str) -> DataFrame:
    scaled = lambda h: G.max_normalised(F.transform(h, lambda x: x * 1000), 100.0)
    return heads(spark, d).agg(r6(F.avg(G.total(F.zip_with(scaled("predictor"), scaled("reorder"), G.smooth_l1)) / 8)).alias("loss"))


@query("q_projection_ce", f"{LP}, b AS (SELECT vec_id, i, lp, row_number() OVER (PARTITION BY vec_id ORDER BY floor(lp * 50) DESC, i) AS n FROM lp) SELECT round(avg(-lp), 6) AS loss FROM b WHERE n = 2")
def projection_ce(spark: SparkSession, d: str) -> DataFrame:
    """Cross-entropy against the class that a coarse projection of the scores puts second."""
    rows = heads(spark, d).withColumn("lp", R.log_softmax("predictor"))
    order = F.array_sort(F.transform("lp", lambda x, i: F.struct((-F.floor(x * 50)).alias("o"), i.alias("i"))))
    return rows.agg(r6(F.avg(-F.get("lp", order[1]["i"]))).alias("loss"))


@query("q_log_sum_exp_chunks", f"SELECT vec_id, round(ln(list_sum(list_transform({RAW}, lambda x: exp(x)))), 6) AS v FROM embeddings")
def log_sum_exp_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return rows.select("vec_id", r6(G.chunked_log_sum_exp(F.col("x"), 16, 64)).alias("v"))


# Models.

PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
TANH = lambda x: f"((exp(2 * {x}) - 1) / (exp(2 * {x}) + 1))"


@query(
    "q_pair_interactions",
    f"WITH e AS (SELECT vec_id, {RAW} AS v FROM embeddings), g AS (SELECT vec_id, v, "
    + ", ".join(f"{layer_sql('v', 64, 8, k)} AS w{k}" for k in range(6))
    + " FROM e) SELECT vec_id, round(0.5 * ("
    + " + ".join(f"list_sum(list_transform(range(1, 9), lambda k: v[{8 * a} + k] * {TANH(f'w{n}[k]')} * v[{8 * b} + k]))" for n, (a, b) in enumerate(PAIRS))
    + "), 6) + 0.0 AS s FROM g",
)
def pair_interactions(spark: SparkSession, d: str) -> DataFrame:
    """All six pairs of four embeddings, each through its own gate."""
    rows = X.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    part = lambda k: F.slice("v", 8 * k + 1, 8)
    gated = [G.total(F.zip_with(F.zip_with(part(a), F.transform(layer(F.col("v"), 64, 8, n), F.tanh), lambda x, w: x * w), part(b), lambda x, y: x * y)) for n, (a, b) in enumerate(PAIRS)]
    return rows.select("vec_id", r6(0.5 * sum(gated[1:], gated[0])).alias("s"))


RESCORED = "round(sin(tuple_rank // 1536 * 0.7 + (tuple_rank // 16) % 96 * 0.013 + (tuple_rank // 2) % 8 * 0.31 - tuple_rank % 2 * 0.5 + vec_id % 10), 9)"


@query("q_tuple_rerank", beam_sql(16, False) + f", r AS (SELECT vec_id, tuple_rank, row_number() OVER (PARTITION BY vec_id ORDER BY {RESCORED} DESC, tuple_rank) AS rank FROM b) SELECT vec_id, rank, tuple_rank FROM r WHERE rank <= 3")
def tuple_rerank(spark: SparkSession, d: str) -> DataFrame:
    """A reranker's score takes the place of the heads' sum for the 16 best tuples; three stay, ties by number."""
    parts = S.split_rank("tuple_rank")
    score = F.round(F.sin(parts["predictor"] * 0.7 + parts["filter_code"] * 0.013 + parts["reorder"] * 0.31 - parts["interleave"] * 0.5 + F.col("vec_id") % 10), 9)
    rows = beams(spark, d, 16).groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-score).alias("s"), F.col("tuple_rank").alias("t")))), 1, 3).alias("best"))
    return rows.select("vec_id", F.posexplode("best").alias("n", "b")).select("vec_id", (F.col("n") + 1).cast("long").alias("rank"), F.col("b.t").alias("tuple_rank"))


TRIADS = f"""WITH p AS (SELECT vec_id, label, unnest(range(0, 8)) AS p, unnest({slot('predictor')}) AS sp FROM embeddings), r AS (SELECT vec_id, unnest(range(0, 8)) AS r, unnest({slot('reorder')}) AS sr FROM embeddings),
    f AS (SELECT vec_id, f, CAST(embedding[f % 6 + 9] AS DOUBLE) + f * 0.0001 AS sf FROM embeddings, range(0, 192) t(f)),
    c AS (SELECT vec_id, label, (p * 192 + f) * 8 + r AS triad, round(sp + sf + sr, 9) AS s FROM p JOIN f USING (vec_id) JOIN r USING (vec_id))"""


@query(
    "q_triad_rerank",
    f"{TRIADS}, t AS (SELECT vec_id, triad, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, triad) AS rank FROM c), b AS (SELECT vec_id, triad, rank FROM t WHERE rank <= 3), n AS (SELECT vec_id, triad, row_number() OVER (PARTITION BY vec_id ORDER BY round(1.0 / rank + 0.1 * sin(triad), 9) DESC, triad) AS rank FROM b) SELECT vec_id, rank, triad FROM n",
)
def triad_rerank(spark: SparkSession, d: str) -> DataFrame:
    """A second model's score times 0.1 is added to the first stage's (here the reciprocal rank)."""
    score = F.round(1.0 / F.col("rank") + 0.1 * F.sin("triad"), 9)
    rows = triads(spark, d).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct((-score).alias("s"), "triad"))).alias("best"))
    return rows.select("vec_id", F.posexplode("best").alias("n", "b")).select("vec_id", (F.col("n") + 1).cast("long").alias("rank"), F.col("b.triad").alias("triad"))


@query(
    "q_hit_rates_exact",
    f"{TRIADS}, t AS (SELECT vec_id, label, triad, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, triad) AS rank FROM c) SELECT "
    + ", ".join(f"round(avg(CASE WHEN rank <= {n} THEN 1.0 ELSE 0.0 END), 6) AS hit{n}" for n in (1, 3, 1000))
    + " FROM t WHERE triad = (label % 8 * 192 + label * 17 % 192) * 8 + label % 8",
)
def hit_rates_exact(spark: SparkSession, d: str) -> DataFrame:
    """The truth's exact rank among all triads: how many are better, or as good with a smaller number."""
    f = F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: F.get("embedding", (i % 6 + 8).cast("int")).cast("double") + i * 0.0001)
    rows = X.table(spark, d, "embeddings").select("vec_id", "label", head_scores("predictor").alias("p"), f.alias("f"), head_scores("reorder").alias("r"))
    y = F.col("label")
    rows = rows.withColumn("truth", (y % 8 * 192 + y * 17 % 192) * 8 + y % 8)
    score = lambda p, g, r: F.round(p + g + r, 9)
    rows = rows.withColumn("own", score(F.get("p", (y % 8).cast("int")), F.get("f", (y * 17 % 192).cast("int")), F.get("r", (y % 8).cast("int"))))
    ahead = lambda s, n: ((s > F.col("own")) | ((s == F.col("own")) & (n < F.col("truth")))).cast("long")
    count = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    inner = lambda p, i, g, j: count(F.transform("r", lambda r, k: ahead(score(p, g, r), (i * 192 + j) * 8 + k)))
    better = count(F.transform("p", lambda p, i: count(F.transform("f", lambda g, j: inner(p, i, g, j)))))
    return rows.withColumn("rank", better + 1).agg(*(r6(F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0))).alias(f"hit{n}") for n in (1, 3, 1000)))


SIZES = [1, 2, 4, 8]


@query(
    "q_beam_config",
    f"WITH {X.CAND_SQL}, r AS (SELECT block_id, bits, row_number() OVER (PARTITION BY block_id ORDER BY tuple_rank, bits) AS n FROM cand), b AS (SELECT block_id, "
    + ", ".join(f"min(CASE WHEN n <= {k} THEN bits END) AS b{k}" for k in SIZES)
    + " FROM r GROUP BY block_id), c AS ("
    + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, avg(b{k}) + {k} * 20.0 AS cost FROM b" for k in SIZES)
    + ") SELECT k, round(cost, 6) AS cost FROM c ORDER BY cost, k LIMIT 1",
)
def beam_config(spark: SparkSession, d: str) -> DataFrame:
    """The beam of least cost, fewer candidates on a tie: the same on every run."""
    costs = G.cheapest_prefix(X.candidates(spark, d), "block_id", ["tuple_rank", "bits"], "bits", SIZES, 20.0)
    return costs.agg(F.min(F.struct("cost", "k")).alias("m")).select("m.k", r6(F.col("m.cost")).alias("cost"))
