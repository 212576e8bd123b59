"""Queries on earlier codec generations, dumps, models and bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import costs as C
from ..functions import generations as G
from ..functions import scalars as S
from ..operators import dataset as D
from . import fixtures as X
from .q_blocks import BLOCKS, EXPLODED, MED, PLANES, R64, VALUES, neighbours
from .registry import query

MED6 = MED.replace("c > ", "c >= ")


@query("q_gen6_predictors", f"{EXPLODED} SELECT block_id, i, CAST({MED6} AS BIGINT) AS med, (a + b + 1) // 2 AS average FROM n")
def predictors_6(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d).select("block_id", "i", G.med_6(F.col("a"), F.col("b"), F.col("c")).alias("med"), S.half_up(F.col("a"), F.col("b")).alias("average"))


def weighed_sql(row: list[int]) -> str:
    return "((" + " + ".join(f"({w}) * CAST(c{k}[i + 1] AS BIGINT)" for k, w in enumerate(row)) + ") % 256 + 256) % 256"


@query("q_gen6_color_filter", f"{PLANES}, p AS (SELECT *, unnest({R64}) AS i FROM planes) " + " UNION ALL ".join(f"SELECT block_id, CAST({code} AS BIGINT) AS code, i, {', '.join(f'{weighed_sql(row)} AS r{k}' for k, row in enumerate(m))}, CAST(c0[i + 1] AS BIGINT) AS b0, CAST(c1[i + 1] AS BIGINT) AS b1, CAST(c2[i + 1] AS BIGINT) AS b2 FROM p" for code, m in enumerate(G.apply_weights())))
def color_filter_6(spark: SparkSession, d: str) -> DataFrame:
    """Filtered components of each of sixteen codes (r) and what undoing gives back (b)."""
    rows = X.planes(spark, d).select("block_id", F.posexplode(F.arrays_zip("c0", "c1", "c2")).alias("i", "p"))
    out = []
    for code in range(16):
        r = G.filter_6(code, *(F.col(f"p.c{k}").cast("long") for k in range(3)))
        b = G.unfilter_6(code, *r)
        out.append(F.struct(F.lit(code).cast("long").alias("code"), *(c.alias(f"r{k}") for k, c in enumerate(r)), *(c.alias(f"b{k}") for k, c in enumerate(b))))
    return rows.select("block_id", F.col("i").cast("long").alias("i"), F.explode(F.array(*out)).alias("e")).select("block_id", "i", "e.*")


CODES = [0, 6, 9, 27, 63, 86, 95]


def filter_7_sql(code: int) -> str:
    e = [f"CAST(c{p}[i + 1] AS BIGINT)" for p in S.PERMUTATIONS[(code >> 4) % 6]]
    guess = ["0", f"{e[0]} // 2", e[0], f"(3 * {e[0]}) // 2"]
    return f"SELECT block_id, CAST({code} AS BIGINT) AS filter_code, i, {e[0]} AS r0, {e[1]} - {guess[code >> 2 & 3]} AS r1, {e[2]} - {guess[code & 3]} AS r2 FROM p"


@query("q_gen7_color_filter", f"{PLANES}, p AS (SELECT block_id, c0, c1, c2, unnest({R64}) AS i FROM planes) " + " UNION ALL ".join(map(filter_7_sql, CODES)))
def color_filter_7(spark: SparkSession, d: str) -> DataFrame:
    rows = X.planes(spark, d).select("block_id", F.posexplode(F.arrays_zip("c0", "c1", "c2")).alias("i", "p"))
    rows = rows.select("block_id", F.col("i").cast("long").alias("i"), "p.c0", "p.c1", "p.c2", F.explode(F.array(*(F.lit(f).cast("long") for f in CODES))).alias("filter_code"))
    return rows.select("block_id", "filter_code", "i", *(r.alias(f"r{k}") for k, r in enumerate(G.filter_7("filter_code", "c0", "c1", "c2"))))


@query(
    "q_gen7_directional",
    f"{BLOCKS}, p AS (SELECT block_id, px, unnest({R64}) AS i FROM blocks) "
    + " UNION ALL ".join(
        f"SELECT block_id, '{n}' AS direction, i, CAST(px[i + 1] - CASE WHEN i % 8 + ({dx}) BETWEEN 0 AND 7 AND i // 8 + ({dy}) >= 0 THEN px[i + 1 + ({8 * dy + dx})] ELSE 0 END AS BIGINT) AS v, CAST(px[i + 1] AS BIGINT) AS back FROM p"
        for n, (dx, dy) in G.DIRECTIONS.items()
    ),
)
def directional(spark: SparkSession, d: str) -> DataFrame:
    """Differences in each direction and the pixels that undoing gives back."""
    out = None
    for name, (dx, dy) in G.DIRECTIONS.items():
        rows = X.blocks(spark, d).withColumn("v", G.directional("px", dx, dy)).withColumn("back", G.undirectional("v", dx, dy))
        one = rows.select("block_id", F.lit(name).alias("direction"), F.posexplode(F.arrays_zip("v", "back")).alias("i", "e")).select("block_id", "direction", F.col("i").cast("long").alias("i"), "e.v", "e.back")
        out = one if out is None else out.union(one)
    return out


@query("q_residual_bitmap", f"{VALUES} SELECT block_id, i, CAST(greatest(0, least(255, round(128 + v * 1.5))) AS BIGINT) AS shade FROM r")
def residual_bitmap(spark: SparkSession, d: str) -> DataFrame:
    """Residuals around middle gray, halves rounded away from zero."""
    shade = F.transform(A.residual("px", 4), lambda r: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(128 + r * F.lit(1.5)))).cast("long"))
    rows = X.blocks(spark, d).select("block_id", F.posexplode(shade).alias("i", "shade"))
    return rows.withColumn("i", F.col("i").cast("long"))


@query("q_residual_dump", f"{VALUES} SELECT block_id, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY i) AS line FROM r GROUP BY block_id")
def residual_dump(spark: SparkSession, d: str) -> DataFrame:
    return X.blocks(spark, d).select("block_id", F.array_join(F.transform(A.residual("px", 4), lambda v: v.cast("string")), " ").alias("line"))


@query("q_reorder_histogram", f"WITH {X.CAND_SQL}, n AS (SELECT reorder, count(*) AS n FROM cand WHERE reorder <> 5 GROUP BY reorder) SELECT i AS reorder, coalesce(n, 0) AS n FROM range(0, 8) t(i) LEFT JOIN n ON i = reorder")
def reorder_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all eight scan orders; those that never occur keep a zero."""
    counts = X.candidates(spark, d).where("reorder <> 5").groupBy("reorder").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(8).toDF("reorder").join(counts, "reorder", "left").fillna(0, ["n"])


@query("q_scan_names", " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS reorder, '{n}' AS name" for i, n in enumerate(A.scan_orders())))
def scan_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(A.scan_orders())), "reorder long, name string")


@query("q_label_cache", f"WITH {X.CAND_SQL}, {X.BEST_SQL}, {X.LAB_SQL} SELECT block_id, b // 1536 AS best_predictor, coalesce(s // 1536, 65535) AS second_predictor, (b // 2) % 8 AS best_reorder, coalesce((s // 2) % 8, 65535) AS second_reorder FROM lab")
def label_cache(spark: SparkSession, d: str) -> DataFrame:
    """Selected heads with the sentinel of a missing label."""
    heads = ["predictor", "reorder"]
    return X.labels(spark, d).select("block_id", *(F.coalesce(F.col(f"{s}_{h}"), F.lit(65535).cast("long")).alias(f"{s}_{h}") for h in heads for s in ("best", "second")))


@query("q_channel_convert", f"{PLANES}, p AS (SELECT *, unnest(range(0, 256)) AS i FROM planes) SELECT block_id, i, CAST(CASE i % 4 WHEN 0 THEN 255 WHEN 1 THEN c0[i // 4 + 1] WHEN 2 THEN c1[i // 4 + 1] ELSE c2[i // 4 + 1] END AS BIGINT) AS v FROM p")
def channels(spark: SparkSession, d: str) -> DataFrame:
    """Three components as four with an opaque alpha in front."""
    rows = X.planes(spark, d).withColumn("a", F.array_repeat(F.lit(255), 64))
    rows = rows.select("block_id", F.posexplode(A.interleaved("a", "c0", "c1", "c2")).alias("i", "v"))
    return rows.withColumn("i", F.col("i").cast("long"))


@query("q_incremental_skip", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 1)")
def incremental(spark: SparkSession, d: str) -> DataFrame:
    """Inputs without an output so far."""
    done = X.table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return X.table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("q_duplicate_paths", "SELECT p, count(*) AS n FROM (SELECT regexp_replace(concat('in/', c_mktsegment, '/', c_custkey % 700, '.bmp'), '\\.bmp$', '') AS p FROM customer) GROUP BY p HAVING count(*) > 1")
def duplicate_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("in/"), "c_mktsegment", F.lit("/"), (F.col("c_custkey") % 700).cast("string"), F.lit(".bmp"))
    return X.table(spark, d, "customer").select(F.regexp_replace(path, r"\.bmp$", "").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("q_json_render", "SELECT p_partkey, concat('{\"id\": ', p_partkey, ', \"price\": ', printf('%.6f', p_retailprice), '}') AS line FROM part")
def json_render(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "part").select("p_partkey", F.format_string('{"id": %d, "price": %.6f}', "p_partkey", "p_retailprice").alias("line"))


@query("q_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%d%H%M%S') AS run FROM events")
def iso_time(spark: SparkSession, d: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return X.table(spark, d, "events").select("event_id", iso.alias("iso"), F.translate(iso, ":-TZ", "").alias("run"))


@query("q_row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "orders").select("o_orderkey")
    return D.numbered(rows, [F.col("o_orderkey")], D.even_buckets(rows, "o_orderkey"))


def layer(v: Column, n_in: int, n_out: int, seed: int) -> Column:
    """A dense layer with weights ((k * 7 + o * 13 + seed) % 11 - 5) / 10."""
    weights = [[((k * 7 + o * 13 + seed) % 11 - 5) / 10 for k in range(n_in)] for o in range(n_out)]
    return F.array(*(F.aggregate(F.zip_with(v, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for w in weights))


def layer_sql(v: str, n_in: int, n_out: int, seed: int) -> str:
    return f"list_transform(range(0, {n_out}), lambda o: list_sum(list_transform(range(0, {n_in}), lambda k: {v}[k + 1] * ((k * 7 + o * 13 + {seed}) % 11 - 5) / 10)))"


RAW = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query("q_mlp_forward", f"WITH e AS (SELECT vec_id, {RAW} AS v FROM embeddings), h AS (SELECT vec_id, list_transform({layer_sql('v', 64, 6, 0)}, lambda x: greatest(x, 0)) AS h FROM e) SELECT vec_id, unnest(range(0, 4)) AS i, round(unnest({layer_sql('h', 6, 4, 3)}), 6) + 0.0 AS y FROM h")
def mlp(spark: SparkSession, d: str) -> DataFrame:
    """Two dense layers with a ramp between them."""
    rows = X.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("h", F.transform(layer(F.col("v"), 64, 6, 0), lambda x: F.greatest(x, F.lit(0.0))))
    rows = rows.select("vec_id", F.posexplode(layer(F.col("h"), 6, 4, 3)).alias("i", "y"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("y", 6) + F.lit(0.0)).alias("y"))


@query("q_pair_interaction", f"WITH e AS (SELECT vec_id, {RAW} AS v FROM embeddings), g AS (SELECT vec_id, v[1:8] AS a, v[9:16] AS b, {layer_sql('v', 64, 8, 1)} AS w FROM e) SELECT vec_id, round(0.5 * list_sum(list_transform(range(1, 9), lambda k: a[k] * ((exp(2 * w[k]) - 1) / (exp(2 * w[k]) + 1)) * b[k])), 6) + 0.0 AS s FROM g")
def pair_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Two embeddings multiplied through a gate that the features set."""
    rows = X.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    gate = F.transform(layer(F.col("v"), 64, 8, 1), F.tanh)
    parts = F.zip_with(F.zip_with(F.slice("v", 1, 8), gate, lambda a, w: a * w), F.slice("v", 9, 8), lambda x, b: x * b)
    return rows.select("vec_id", (F.round(0.5 * F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)).alias("s"))


@query("q_head_training")
def head_training(spark: SparkSession, d: str) -> DataFrame:
    """A head trained on soft labels: each of two classes is a weighted row. Returns accuracy on the held-out tenth."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = X.table(spark, d, "embeddings").where("label is not null and embedding is not null").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    soft = F.array(F.struct(F.col("label").alias("y"), F.lit(0.9).alias("w")), F.struct(((F.col("label") + 1) % 10).alias("y"), F.lit(0.1).alias("w")))
    train = rows.where("vec_id % 10 <> 0").select("features", F.explode(soft).alias("s")).select("features", "s.y", "s.w")
    model = LogisticRegression(labelCol="y", weightCol="w", maxIter=20, regParam=1e-3).fit(train)
    scored = model.transform(rows.where("vec_id % 10 = 0"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


RISE, FALL, _ = C.DEFAULT[0]
MAPPED = "(CASE WHEN x.v >= 0 THEN 2 * x.v ELSE -2 * x.v - 1 END)"
MIXED = f"(CASE WHEN s.a < {MAPPED} THEN ({MAPPED} * {16 * RISE} + s.a * {16 - RISE} + 8) // 16 ELSE ({MAPPED} * {16 * FALL} + s.a * {16 - FALL} + 8) // 16 END)"
STATE = "STRUCT(mean BIGINT, width BIGINT, m BIGINT)[]"


@query(
    "q_golomb_states",
    f"""{VALUES}, l AS (SELECT block_id, list({{'v': CAST(v AS BIGINT), 'a': CAST(0 AS BIGINT), 'out': CAST([] AS {STATE})}} ORDER BY i) AS l FROM r GROUP BY block_id),
    o AS (SELECT block_id, list_reduce(l, lambda s, x: {{'v': CAST(0 AS BIGINT), 'a': CAST({MIXED} AS BIGINT), 'out': list_append(s.out, {{'mean': CAST(s.a // 16 AS BIGINT), 'width': CAST(length(ltrim(bin({MAPPED}), '0')) AS BIGINT), 'm': CAST({MAPPED} AS BIGINT)}})}},
      {{'v': CAST(0 AS BIGINT), 'a': CAST(0 AS BIGINT), 'out': CAST([] AS {STATE})}}).out AS o FROM l)
    SELECT block_id, step, mean, width, m FROM (SELECT block_id, unnest(range(0, 64)) AS step, unnest(o, recursive := true) FROM o)""",
)
def golomb_states(spark: SparkSession, d: str) -> DataFrame:
    """The dump of mean, width and mapped value at each step of the plain fold."""
    rows = X.blocks(spark, d).select("block_id", F.posexplode(C.plain_states(A.residual("px", 4), 0)).alias("step", "s"))
    return rows.select("block_id", F.col("step").cast("long").alias("step"), F.col("s.mean").cast("long").alias("mean"), F.col("s.width").cast("long").alias("width"), F.col("s.m").cast("long").alias("m"))


def round_trips(spark: SparkSession, d: str, form: str) -> DataFrame:
    """Each block as an image of three components, written and read again: (block_id, bytes, equal)."""
    import numpy as np
    import pyarrow as pa

    from ..operators.block_search import TOGETHER, dealt
    from ..sources import gen8, images

    def encode_all(block):
        return gen8.encode_all(block) if form == "gen8" else [images.ENCODERS[form](image) for image in block]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                planes = [part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8) for c in (1, 2, 3)]
                block = np.stack(planes, axis=3).astype(np.uint8)
                files = encode_all(block)
                equal = [int((images.decode(raw)[:, :, -3:] == image).all()) for raw, image in zip(files, block, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, files), pa.int64()), pa.array(equal, pa.int64())], names=["block_id", "bytes", "equal"])

    rows = X.planes(spark, d).select("block_id", "c0", "c1", "c2")
    return (dealt(rows) if form == "gen8" else rows).mapInArrow(run, "block_id long, bytes long, equal long")


@query("q_codec_bmp", "SELECT vec_id AS block_id, CAST(246 AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS equal FROM embeddings")
def codec_bmp(spark: SparkSession, d: str) -> DataFrame:
    return round_trips(spark, d, "bmp")


@query("q_codec_gen5", "SELECT vec_id AS block_id, CAST(254 AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS equal FROM embeddings")
def codec_gen5(spark: SparkSession, d: str) -> DataFrame:
    return round_trips(spark, d, "gen5")


@query("q_codec_png", "SELECT vec_id AS block_id, CAST(1 AS BIGINT) AS equal FROM embeddings")
def codec_png(spark: SparkSession, d: str) -> DataFrame:
    return round_trips(spark, d, "png").drop("bytes")


@query("q_codec_gen8", "SELECT vec_id AS block_id, CAST(1 AS BIGINT) AS equal FROM embeddings")
def codec_gen8(spark: SparkSession, d: str) -> DataFrame:
    return round_trips(spark, d, "gen8").drop("bytes")
