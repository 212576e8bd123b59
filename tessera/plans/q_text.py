"""Queries on text, packing, joins and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dataset as D
from ..operators import statistics as ST
from . import fixtures as X
from .registry import query


@query("q_line_counts", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"))


@query("q_text_lines", "SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, md5(l[i]) AS line_md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"))


LENIENT = "CASE event_id % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '-' || CAST(user_id AS VARCHAR) WHEN 2 THEN CAST(user_id AS VARCHAR) || '.75' WHEN 3 THEN '0x1f' WHEN 4 THEN '017' ELSE 'x' || event_type END"


@query("q_lenient_int", f"WITH t AS (SELECT event_id, user_id, {LENIENT} AS t FROM events) SELECT event_id, t, CAST(CASE event_id % 6 WHEN 0 THEN user_id WHEN 1 THEN -user_id WHEN 2 THEN user_id WHEN 3 THEN 31 WHEN 4 THEN 15 ELSE -1 END AS BIGINT) AS n FROM t")
def lenient(spark: SparkSession, d: str) -> DataFrame:
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 6
    t = F.when(k == 0, u).when(k == 1, F.concat(F.lit("-"), u)).when(k == 2, F.concat(u, F.lit(".75"))).when(k == 3, F.lit("0x1f")).when(k == 4, F.lit("017")).otherwise(F.concat(F.lit("x"), "event_type"))
    return X.table(spark, d, "events").select("event_id", t.alias("t")).withColumn("n", T.lenient_int(F.col("t"), -1))


@query("q_json_candidate", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, CAST(-1 AS BIGINT) AS missing FROM events")
def json_candidate(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "events").select("event_id", T.json_int("props", "$.k").alias("k"), T.json_int("props", "$.none").alias("missing"))


@query("q_csv_split", "WITH t AS (SELECT p_partkey, concat(p_brand, ', ,', p_type, ',') AS t FROM part) SELECT p_partkey, x AS item FROM (SELECT p_partkey, unnest(list_filter(list_transform(string_split(t, ','), lambda y: trim(y)), lambda y: y <> '')) AS x FROM t)")
def csv_split(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("p_brand", F.lit(", ,"), "p_type", F.lit(","))
    return X.table(spark, d, "part").select("p_partkey", F.explode(T.csv_items(t)).alias("item"))


@query("q_parse_topn", "SELECT DISTINCT p_size, n FROM (SELECT p_size, unnest([3, 1, CAST(p_size AS BIGINT)]) AS n FROM part) WHERE n > 0")
def parse_topn(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("3, 1,,3,0,x,"), F.col("p_size").cast("string"))
    return X.table(spark, d, "part").select("p_size").distinct().select("p_size", F.explode(T.top_n_list(t)).alias("n"))


@query("q_parse_bool", "SELECT o_orderkey, CAST(o_orderkey % 4 IN (0, 1) AS BIGINT) AS flag FROM orders")
def parse_bool(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.lit(" Yes")).when(k == 1, F.lit("TRUE ")).when(k == 2, F.lit("off")).otherwise(F.lit("2"))
    return X.table(spark, d, "orders").select("o_orderkey", T.flag(t).cast("long").alias("flag"))


@query("q_parse_feature_name", "SELECT p_partkey, concat('px_', p_size) AS key, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 50 ELSE -1 END AS idx FROM part")
def parse_name(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(F.lit("px_"), F.col("p_size").cast("string"))
    name = F.when(F.col("p_partkey") % 3 > 0, F.concat(base, F.lit("["), (F.col("p_partkey") % 50).cast("string"), F.lit("]"))).otherwise(base)
    key, index = T.feature_name(name)
    return X.table(spark, d, "part").select("p_partkey", key.alias("key"), F.coalesce(index, F.lit(-1).cast("long")).alias("idx"))


@query("q_extract_by_name", "SELECT vec_id, round(coalesce(CAST(embedding[vec_id % 70 + 1] AS DOUBLE), 0), 6) + 0.0 AS v FROM embeddings")
def by_name(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "embeddings").select("vec_id", (F.round(T.by_name(F.col("embedding"), F.col("vec_id") % 70), 6) + F.lit(0.0)).alias("v"))


@query("q_extract_by_schema", "SELECT vec_id, unnest(range(0, 4)) AS i, round(unnest(CASE WHEN vec_id % 5 > 0 THEN list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) ELSE [0.0, 0.0, 0.0, 0.0] END), 6) + 0.0 AS v FROM embeddings")
def by_schema(spark: SparkSession, d: str) -> DataFrame:
    values = F.slice("embedding", F.lit(1), F.when(F.col("vec_id") % 5 > 0, F.lit(4)).otherwise(F.lit(3)))
    rows = X.table(spark, d, "embeddings").select("vec_id", F.posexplode(T.by_schema(values, 4)).alias("i", "v"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query("q_schema_widths", "SELECT source AS key, min(len(string_split(text, chr(10)))) AS lo, max(len(string_split(text, chr(10)))) AS hi, CAST(min(len(string_split(text, chr(10)))) = max(len(string_split(text, chr(10)))) AS BIGINT) AS kept FROM documents GROUP BY source")
def schema_widths(spark: SparkSession, d: str) -> DataFrame:
    """A key stays in an inferred schema only if its width never changes."""
    width = F.size(F.split("text", "\n")).cast("long")
    rows = X.table(spark, d, "documents").groupBy(F.col("source").alias("key")).agg(F.min(width).alias("lo"), F.max(width).alias("hi"))
    return rows.withColumn("kept", (F.col("lo") == F.col("hi")).cast("long"))


@query("q_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def sha256(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("q_dataset_fingerprint", "SELECT sha256(string_agg(concat(sha256(name), ':', n, ':', name), '' ORDER BY name)) AS h FROM (SELECT source AS name, CAST(count(*) AS VARCHAR) AS n FROM documents GROUP BY source)")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One hash over the parts' hashes, counts and names in name order; a row a part (file), not a row a record."""
    parts = X.table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    piece = F.concat(F.sha2("name", 256), F.lit(":"), "n", F.lit(":"), "name")
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", piece.alias("p")))), lambda t: t["p"]), ""), 256).alias("h"))


# Joins and packing.


@query("q_zip_join", "WITH a AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS row_id FROM benchmark) SELECT row_id, doc_id, item_id FROM a JOIN b USING (row_id)")
def zip_join(spark: SparkSession, d: str) -> DataFrame:
    """Two tables joined by place: dense numbers on both sides, then an equi-join."""
    docs, items = X.table(spark, d, "documents").select("doc_id"), X.table(spark, d, "benchmark").select("item_id")
    a = D.numbered(docs, [F.col("doc_id")], D.even_buckets(docs, "doc_id"))
    b = D.numbered(items, [F.col("item_id")], D.even_buckets(items, "item_id"))
    return a.join(b, "row_id").select("row_id", "doc_id", "item_id")


@query("q_artifact_pairs", "SELECT c_custkey AS k, CAST(o.k IS NOT NULL AS BIGINT) AS has_orders, CASE WHEN o.k IS NULL THEN 'missing orders' END AS error FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c_custkey = o.k")
def artifact_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every part with its pair or with an error, instead of a silent inner join."""
    o = X.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("there", F.lit(True))
    rows = X.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(o, "k", "left")
    return rows.select("k", F.col("there").isNotNull().cast("long").alias("has_orders"), F.when(F.col("there").isNull(), F.lit("missing orders")).alias("error"))


PACK = "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), o AS (SELECT conv_id, n, CAST(coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c)"


def packed(spark: SparkSession, d: str) -> DataFrame:
    parts = X.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return D.pack_offsets(parts, "conv_id", "n", D.even_buckets(parts, "conv_id"), "start")


@query("q_pack_offsets", f"{PACK} SELECT conv_id, n, start FROM o")
def pack_offsets(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d)


@query("q_range_lookup", f"{PACK} SELECT doc_id, conv_id, doc_id - start AS line FROM documents JOIN o ON doc_id >= start AND doc_id < start + n")
def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = D.range_lookup(X.table(spark, d, "documents").select("doc_id"), "doc_id", packed(spark, d), "start", "n")
    return found.select("doc_id", "conv_id", (F.col("doc_id") - F.col("start")).alias("line"))


@query("q_truncate_to_count", "WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey FROM o JOIN customer ON o_custkey = c_custkey WHERE r <= c_nationkey")
def truncate(spark: SparkSession, d: str) -> DataFrame:
    """Of each part at most the declared number of rows, the first ones."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = X.table(spark, d, "orders").select("o_custkey", "o_orderkey").withColumn("r", F.row_number().over(w))
    declared = X.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("most"))
    return rows.join(declared, "o_custkey").where("r <= most").select("o_custkey", "o_orderkey")


@query("q_union_all", "SELECT 0 AS file_ord, o_orderkey AS line_no, o_orderstatus AS v FROM orders UNION ALL SELECT 1, l_orderkey, l_linestatus FROM lineitem")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    a = X.table(spark, d, "orders").select(F.lit(0).alias("file_ord"), F.col("o_orderkey").alias("line_no"), F.col("o_orderstatus").alias("v"))
    return a.unionByName(X.table(spark, d, "lineitem").select(F.lit(1).alias("file_ord"), F.col("l_orderkey").alias("line_no"), F.col("l_linestatus").alias("v")))


@query("q_sample_cap", "SELECT doc_id FROM documents ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':1234')), doc_id LIMIT 100")
def sample_cap(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    return D.sampled(X.table(spark, d, "documents").select("doc_id"), "doc_id", 1234, 100)


@query("q_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':1234')), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, place, CASE WHEN place < floor(n * 0.9) THEN 'train' ELSE 'valid' END AS part FROM r")
def split(spark: SparkSession, d: str) -> DataFrame:
    return D.split(X.table(spark, d, "documents").select("doc_id"), "doc_id", 1234, 0.9).select("doc_id", "place", "part")


# Reports.


@query("q_ratio_summary", "SELECT l_returnflag AS format, count(*) AS images, CAST(sum(l_quantity) AS BIGINT) AS original, CAST(sum(floor(l_extendedprice / 1000)) AS BIGINT) AS compressed, round(100 * sum(floor(l_extendedprice / 1000)) / sum(l_quantity), 6) AS ratio FROM lineitem GROUP BY l_returnflag")
def ratio_summary(spark: SparkSession, d: str) -> DataFrame:
    small = F.floor(F.col("l_extendedprice") / 1000)
    rows = X.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("format"))
    return rows.agg(F.count(F.lit(1)).alias("images"), F.sum("l_quantity").cast("long").alias("original"), F.sum(small).cast("long").alias("compressed"), F.round(100 * F.sum(small).cast("double") / F.sum("l_quantity"), 6).alias("ratio"))


@query("q_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_best_trial_fold",
    """WITH RECURSIVE t AS (SELECT s_suppkey AS t, round(s_acctbal / 10000, 6) AS r, s_suppkey % 7 AS p, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier),
    f AS (SELECT n, t AS bt, r AS br, p AS bp, CAST(0 AS BIGINT) AS idle FROM t WHERE n = 1
      UNION ALL SELECT t.tn, CASE WHEN w THEN t.t ELSE bt END, CASE WHEN w THEN t.r ELSE br END, CASE WHEN w THEN t.p ELSE bp END, CASE WHEN w THEN 0 ELSE idle + 1 END
      FROM (SELECT f.*, t.t, t.r, t.p, t.n AS tn, t.r >= br + 0.001 OR (abs(t.r - br) <= 1e-9 AND t.p < bp) AS w FROM f JOIN t ON t.n = f.n + 1) t)
    SELECT bt AS trial, br AS rate, bp AS params, idle FROM f ORDER BY n DESC LIMIT 1""",
)
def best_trial(spark: SparkSession, d: str) -> DataFrame:
    trials = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("t"), F.round(F.col("s_acctbal") / 10000, 6).alias("r"), (F.col("s_suppkey") % 7).alias("p"))
    return ST.best_trial(trials, "t", "r", "p")
