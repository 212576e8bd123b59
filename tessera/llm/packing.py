"""Packing (operator 8): cutting-stock column generation over a length histogram.

Documents become token ids plus an end id. A document longer than a sequence is cut into full
sequences and a rest; nothing else is cut. Rests fall into length classes; the histogram of
classes (bounded by sequence length / class width) goes to the driver, where a linear program
over patterns is solved by column generation: a knapsack dynamic program prices new patterns
against the duals. The program is rounded down, what is left is packed first-fit decreasing,
and ranked pieces of each class take the slots of its patterns through a broadcast interval
table (bounded by classes squared). Lengths never exceed their class, so sequences never overflow.

Defined cases: a null text is empty (the end id alone); empty tables give no rows; repeated rows
are separate documents with equal pieces; ties in rank are between equal pieces only; a null
doc_id stays null; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .ids import VOCABULARY, encode

LENGTH = 2048
WIDTH = 8
END = 1
CHUNK = 1 << 20  # bytes of text encoded at a time
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("cls", pa.int32())])


def cut(length: int, width: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).fill_null("")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CHUNK, "right")))
                ids, first = encode(texts.slice(i, j - i), vocabulary)
                rows = []
                for doc, a, b in zip(docs.slice(i, j - i).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    tokens = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                    n = len(tokens)
                    for s in range(0, n, length):
                        piece = tokens[s : s + length]
                        rows.append((doc, s, len(piece), zlib.crc32(piece.tobytes()), n, -(-len(piece) // width)))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)
                i = j

    return common.releasing(run)


def price(duals: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The unbounded knapsack of largest value: duals[c - 1] is the value of a piece of c units."""
    value = np.zeros(capacity + 1)  # value[capacity - room] is the best for that room: the terms of a sum lie side by side
    took = [0] * (capacity + 1)
    for room in range(1, capacity + 1):
        sums = duals[:room] + value[capacity - room + 1 :]
        k = int(sums.argmax())
        less = value[capacity - room + 1]
        value[capacity - room] = less
        if sums[k] > less + 1e-12:
            value[capacity - room], took[room] = sums[k], k + 1
    pattern: dict[int, int] = {}
    cap = capacity
    while cap > 0:
        if k := took[cap]:
            pattern[k] = pattern.get(k, 0) + 1
        cap -= k or 1
    return float(value[0]), pattern


def solve(demand: dict[int, int], capacity: int, rounds: int = 20_000, tolerance: float = 1e-4) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used; every class's slots add up to its demand exactly."""
    classes = sorted(c for c, n in demand.items() if n > 0)
    if not classes:
        return []
    m, at = len(classes), {c: i for i, c in enumerate(classes)}
    patterns = [{c: capacity // c} for c in classes]
    inverse = np.diag([c_ / 1.0 for c_ in (1 / (capacity // c) for c in classes)])
    n = np.array([demand[c] for c in classes], dtype=float)
    x = inverse @ n
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value = np.full(capacity, -1.0)
        value[np.array(classes) - 1] = duals
        worth, pattern = price(value, capacity)
        if worth <= 1 + tolerance:
            break
        column = np.zeros(m)
        for c, k in pattern.items():
            column[at[c]] = k
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        patterns[out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        x = np.maximum(x - step * ratio[out], 0)
        x[out] = ratio[out]
    used: list[tuple[dict[int, int], int]] = []
    left = {c: demand[c] for c in classes}
    for pattern, amount in zip(patterns, x, strict=True):
        times = min([int(amount + 1e-6)] + [left[c] // k for c, k in pattern.items()])
        if times > 0:
            used.append((pattern, times))
            for c, k in pattern.items():
                left[c] -= k * times
    while any(left.values()):  # each round fills one bin, largest pieces first, as often as the rest allows
        pattern, room = {}, capacity
        for c in reversed(classes):
            if k := min(left[c], room // c):
                pattern[c] = k
                room -= k * c
        times = min(left[c] // k for c, k in pattern.items())
        used.append((pattern, times))
        for c, k in pattern.items():
            left[c] -= k * times
    return used


def pack(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int"
    pieces = common.documents(docs).mapInArrow(cut(length, width, vocabulary), schema)
    pieces = common.publish(pieces, "pieces")
    demand = {r["cls"]: r["n"] for r in pieces.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most length / width rows
    slots, filled, base = [], dict.fromkeys(demand, 0), 0
    for pattern, times in solve(demand, length // width):
        for c, k in pattern.items():
            slots.append((c, filled[c], filled[c] + k * times, k, base))
            filled[c] += k * times
        base += times
    places = spark.createDataFrame(slots, "cls int, lo long, hi long, k long, base long")
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")]
    ranks = common.ranked(pieces, ["cls"], order, "rank")
    placed = ranks.join(F.broadcast(places), (ranks["cls"] == places["cls"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.expr("(rank - lo) div k")).alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
