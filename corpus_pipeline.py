"""The corpus pipeline: documents to packed sequences in five stages.

Defined cases, for all stages: rows with a null id pass the filters by their text alone; null and
empty texts are clean, alone and without values, and pack as their end id; repeated rows go or stay
together, but for the join, which keeps one of each; an empty table stays empty; further columns
stay up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.decontamination import without_contaminated
from tessera.llm.ngram_join import one_of_each
from tessera.llm.packing import pack
from tessera.llm.pii import pseudonymised, session_key
from tessera.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; without usable labels all stay."""
    return without_toxic(docs, common.table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: five words, a similarity of 0.8 or more."""
    return one_of_each(docs, k=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words in tiles go; without a benchmark all stay."""
    return without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; n_chars follows the text."""
    out = pseudonymised(docs, session_key(spark))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("packing", packing),
]
#: No SQL can express k-nearest votes, string tiling or column generation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.publish(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
