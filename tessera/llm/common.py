"""Shared pieces of the text operators: scratch tables, hashing, ranks."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch of whole texts: a batch is held several times over on its way to Python and back.
BATCH, BATCH_BYTES = 500, "4m"


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives memory back to the system at the end of a task: Python workers live on and would keep it."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `size` bytes of one text column (a row at least), so that a task's arrays stay small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + size, "right")))
        yield batch.slice(i, j - i)
        i = j


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches for texts; a lower count of rows stays."""
    rows, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(rows)) <= BATCH:
        conf.set(rows, str(BATCH))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of a table that may hold more."""
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; without it, in local mode only, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_published: list[str] = []


def publish(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and rereads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    give_back()  # what the driver's Python held to plan it
    _published.append(path)
    return spark.read.schema(schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables published so far: for callers whose results are written."""
    while _published:
        path = spark._jvm.org.apache.hadoop.fs.Path(_published.pop())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows (a published table) join table (few rows a key) by keys, inner or left: no key's rows meet in one task.

    Keys with more than a quarter of a partition's even share of the rows, at most four times as
    many as there are partitions, find their table rows by broadcast; only the others are shuffled.
    """
    spark = rows.sparkSession
    full = rows.dropna(subset=keys)
    limit = rows.count() // (4 * partitions(spark)) + 1
    often = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys).collect()  # bounded as above
    out = full.join(table, keys, how)
    if often:
        hot = F.broadcast(spark.createDataFrame(often, full.select(*keys).schema))
        out = full.join(hot, keys, "left_anti").join(table, keys, how).unionByName(full.join(hot, keys, "left_semi").join(F.broadcast(table.join(hot, keys, "left_semi")), keys, how))
    if how == "left":
        out = out.unionByName(rows.where(" or ".join(f"{k} is null" for k in keys)), allowMissingColumns=True)
    return out


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str, salts: int | None = None) -> DataFrame:
    """Adds gapless ranks from 0 within `group` without putting a group into one task.

    Rows are salted by the hash of `order`; a rank is the count of the group's rows in
    smaller salts plus the rank within the salt. The counts table has `salts` rows a group.
    """
    salts = salts or 2 * partitions(df.sparkSession)
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = df.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_salt").orderBy(*order)
    return (
        df.withColumn("_in", F.row_number().over(inside))
        .join(counts, [*group, "_salt"])
        .withColumn(name, (F.col("_before") + F.col("_in") - 1).cast("long"))
        .drop("_salt", "_in", "_before")
    )
