"""Block tables made of the driver's tables, for queries; every one has its SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import search

HEADS = {"predictor": 8, "cf_perm": 6, "cf_primary": 4, "cf_secondary": 4, "reorder": 8, "interleave": 2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8x8 block of bytes a vector: (block_id, label, px array<int>)."""
    px = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + F.lit(0.5)) * 256))).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block_id"), "label", px.alias("px"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three components a block: the pixels, and the pixels moved by one and by eight places."""
    return blocks(spark, sf_dir).select("block_id", "label", F.col("px").alias("c0"), F.expr("concat(slice(px, 2, 63), slice(px, 1, 1))").alias("c1"), F.expr("concat(slice(px, 9, 56), slice(px, 1, 8))").alias("c2"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated setting tuples: (block_id, trial, predictor, filter_code, reorder, interleave, bits, energy, tuple_rank)."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("block_id"),
        F.col("l_linenumber").cast("long").alias("trial"),
        (F.col("l_suppkey") % 8).alias("predictor"),
        (F.col("l_partkey") % 96).alias("filter_code"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).alias("reorder"),
        (F.col("l_quantity").cast("long") % 2).alias("interleave"),
        F.floor(F.col("l_extendedprice") / 100).alias("bits"),
        F.col("l_extendedprice").alias("energy"),
    )
    return rows.withColumn("tuple_rank", S.tuple_rank("predictor", "filter_code", "reorder", "interleave"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a block: best_* and second_* settings of its two best tuples (second_* null if there is one)."""
    return search.label_records(search.best_second(candidates(spark, sf_dir), "block_id"), "block_id")


CAND_SQL = """cand AS (
  SELECT l_orderkey AS block_id, CAST(l_linenumber AS BIGINT) AS trial, l_suppkey % 8 AS predictor, l_partkey % 96 AS filter_code,
         (l_orderkey + l_linenumber) % 8 AS reorder, CAST(floor(l_quantity) AS BIGINT) % 2 AS interleave,
         CAST(floor(l_extendedprice / 100) AS BIGINT) AS bits, l_extendedprice AS energy,
         (((l_suppkey % 8) * 96 + l_partkey % 96) * 8 + (l_orderkey + l_linenumber) % 8) * 2 + CAST(floor(l_quantity) AS BIGINT) % 2 AS tuple_rank
  FROM lineitem)"""
BEST_SQL = """best_second AS (
  SELECT block_id, tuple_rank, bits, rn FROM (
    SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY bits, tuple_rank) AS rn FROM (
      SELECT block_id, tuple_rank, min(bits) AS bits FROM cand GROUP BY block_id, tuple_rank)) WHERE rn <= 2)"""
LAB_SQL = """lab AS (
  SELECT block_id,
    max(CASE WHEN rn = 1 THEN tuple_rank END) AS b, max(CASE WHEN rn = 1 THEN bits END) AS best_bits,
    max(CASE WHEN rn = 2 THEN tuple_rank END) AS s, max(CASE WHEN rn = 2 THEN bits END) AS second_bits
  FROM best_second GROUP BY block_id)"""
BLOCKS_SQL = """blocks AS (
  SELECT vec_id AS block_id, label, list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 0.5) * 256))) AS INTEGER)) AS px
  FROM embeddings)"""
PLANES_SQL = BLOCKS_SQL + """, planes AS (
  SELECT block_id, label, px AS c0, list_concat(px[2:64], px[1:1]) AS c1, list_concat(px[9:64], px[1:8]) AS c2 FROM blocks)"""
