"""Training dumps: JSON lines, strict and lenient, and fixed-width binary label records."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of a label record: 128 bytes, magic, version, twelve labels, a checksum that is not checked.
RECORD = struct.Struct("<IHH12hI92s")
MAGIC, VERSION = 0x4C424C38, 1
HEADS = ["predictor", "cf_perm", "cf_primary", "cf_secondary", "reorder", "interleave"]
CLASSES = [8, 6, 4, 4, 8, 2]


def pack_record(best: list[int], second: list[int] | None) -> bytes:
    return RECORD.pack(MAGIC, VERSION, 0, *best, *(second or [-1] * 6), 0, b"")


def read_label_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_id, best_*, second_*, error): numbers are read with SQL functions, no Python on executors.

    A record with a wrong magic, version or label has an error; a missing second is null.
    """
    size = RECORD.size
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content", "length")
    n = F.floor(F.col("length") / size)
    rows = files.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.expr("content").substr(i * size + 1, F.lit(size)))).alias("row_id", "r"))

    def number(at: int, width: int):
        """A little-endian unsigned number at a byte offset."""
        digits = F.concat(*(F.hex(F.col("r").substr(at + i, 1)) for i in range(width, 0, -1)))
        return F.conv(digits, 16, 10).cast("long")

    signed = lambda at: F.when(number(at, 2) >= 32768, number(at, 2) - 65536).otherwise(number(at, 2))
    out = rows.select("path", F.col("row_id").cast("long").alias("row_id"), number(0, 4).alias("magic"), number(4, 2).alias("version"), number(6, 2).alias("reserved"), *(signed(8 + 2 * i).alias(("best_" if i < 6 else "second_") + HEADS[i % 6]) for i in range(12)))
    best_ok = [F.col(f"best_{h}").between(0, c - 1) for h, c in zip(HEADS, CLASSES, strict=True)]
    second_ok = [F.col(f"second_{h}").between(-1, c - 1) for h, c in zip(HEADS, CLASSES, strict=True)]
    good = best_ok[0]
    for c in (*best_ok[1:], *second_ok):
        good = good & c
    error = F.when(F.col("magic") != MAGIC, "magic").when(F.col("version") != VERSION, "version").when(F.col("reserved") != 0, "reserved").when(~good, "label out of range")
    labels = [F.col(f"best_{h}") for h in HEADS] + [F.when(F.col(f"second_{h}") >= 0, F.col(f"second_{h}")).alias(f"second_{h}") for h in HEADS]
    return out.select("path", "row_id", *labels, error.alias("error"))


def read_json_lines(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """(path, line_no from 0, row, error) of every line, blank ones too.

    strict: readers call `checked`, which fails on the first bad line. lenient: a bad or blank line
    is a row of nulls, so that places stay right. skip: blank lines go, numbers stay.
    Line numbers come from whole files, one row a file; a file is the unit that a dump writes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r?\n$", "")
    lines = files.select("path", F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))
    rows = lines.select("path", F.col("line_no").cast("long").alias("line_no"), "line", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    blank = F.trim("line") == ""
    error = F.when(blank, "blank line").when(F.col("row").isNull() | F.col("row._bad").isNotNull(), F.concat(F.lit("bad JSON: "), F.substring("line", 1, 256)))
    rows = rows.withColumn("error", error).withColumn("row", F.when(error.isNull(), F.col("row").dropFields("_bad"))).drop("line")
    return rows.where(~F.coalesce(F.col("error") == "blank line", F.lit(False))) if mode == "skip" else rows


def checked(rows: DataFrame) -> DataFrame:
    """Fails with file, line and preview on a row with an error."""
    fail = F.raise_error(F.concat_ws(" ", "path", F.lit("line"), (F.col("line_no") + 1).cast("string"), "error"))
    return rows.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(fail.cast("boolean"))).drop("error")
