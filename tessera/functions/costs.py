"""Bit-cost folds over value arrays with an adaptive mean, and the cost table they read.

A fold is one `aggregate` per array: arrays of a block (64 to 256 values) stay in a row, so costs
need no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

#: Fixed values, a row each: rise and fall ratio, then nine counts that add up to 1024.
GOLOMB_TABLE = """
12 6 | 1 3 4 9 27 94 267 480 139
9 6 | 2 3 3 14 122 96 229 435 120
7 5 | 3 1 6 8 112 108 258 414 114
12 8 | 2 3 3 10 15 92 253 521 125
14 6 | 2 3 3 11 71 95 280 452 107
10 9 | 3 2 6 5 101 56 261 422 168
6 5 | 3 2 5 8 47 120 250 492 97
3 5 | 3 4 2 11 27 110 248 487 132
"""


def parse_golomb(text: str) -> list[tuple[int, int, list[int]]]:
    """Rows (rise, fall, counts). Comments after # or ; and bars are dropped; a row has 9 or 11 numbers.

    Counts add up to 1024 and ratios are 1 to 16. Six rows stand for a table without the interleaved
    pair (rows 0 and 3 again); fewer rows that divide eight are repeated.
    """
    rows = []
    for number, line in enumerate(text.splitlines(), 1):
        fields = line.split("#")[0].split(";")[0].replace("|", " ").split()
        if not fields:
            continue
        values = [int(f) for f in fields]
        if len(values) not in (9, 11):
            raise ValueError(f"line {number}: 9 or 11 numbers are needed, not {len(values)}")
        rise, fall, counts = (*values[:2], values[2:]) if len(values) == 11 else (8, 8, values)
        if sum(counts) != 1024 or min(counts) < 0:
            raise ValueError(f"line {number}: the counts add up to {sum(counts)}, not 1024")
        if not (1 <= rise <= 16 and 1 <= fall <= 16):
            raise ValueError(f"line {number}: ratios are 1 to 16")
        rows.append((rise, fall, counts))
    if len(rows) == 6:
        rows += [rows[0], rows[3]]
    if not rows or 8 % len(rows):
        raise ValueError(f"{len(rows)} rows do not make eight")
    return rows * (8 // len(rows))


DEFAULT = parse_golomb(GOLOMB_TABLE)


def bit_lengths(counts: list[int]) -> list[int]:
    """For each of 1024 means the number of low bits: column i as often as its count says."""
    return [i for i, n in enumerate(counts) for _ in range(n)]


def thresholds(counts: list[int]) -> list[int]:
    """The mean from which each next column holds: running sums."""
    out, total = [], 0
    for n in counts:
        total += n
        out.append(total)
    return out


def low_bits(mean: Column, counts: list[int]) -> Column:
    """The table lookup as a sum of steps; means beyond the table take its last column."""
    steps = [F.when(mean >= t, F.lit(1)).otherwise(F.lit(0)) for t in thresholds(counts)[:-1]]
    return sum(steps[1:], steps[0]).cast("long")


def plain_bits(values: str, row: int, table: list[tuple[int, int, list[int]]] = DEFAULT) -> Column:
    """Bits of an integer array coded value by value."""
    rise, fall, counts = table[row]

    def step(s: Column, v: Column) -> Column:
        m = S.zigzag(v)
        k = low_bits(F.floor((s["a"] + 8) / 16), counts)
        return F.struct(S.mixed(s["a"], m, rise, fall).alias("a"), (s["bits"] + S.golomb_value_bits(m, k)).alias("bits"))

    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("bits"))
    return F.aggregate(values, start, step)["bits"]


def run_length_bits(values: str, row: int, table: list[tuple[int, int, list[int]]] = DEFAULT) -> Column:
    """Bits of an integer array coded as runs of zeros and of other values, after one leading bit."""
    rise, fall, counts = table[row]

    def step(s: Column, v: Column) -> Column:
        zero = v == 0
        m = S.zigzag_nonzero(v)
        k = low_bits(F.floor((s["a"] + 8) / 16), counts)
        turned = (zero != s["zero"]) & (s["run"] > 0)
        ended = F.when(turned, S.run_length_bits(s["run"])).otherwise(F.lit(0))
        return F.struct(
            F.when(zero, s["a"]).otherwise(S.mixed(s["a"], m, rise, fall)).alias("a"),
            (s["bits"] + ended + F.when(zero, F.lit(0)).otherwise(S.golomb_value_bits(m, k))).alias("bits"),
            F.when(turned, F.lit(1)).otherwise(s["run"] + 1).cast("long").alias("run"),
            zero.alias("zero"),
        )

    n = lambda x: F.lit(x).cast("long")
    start = F.struct(n(0).alias("a"), n(1).alias("bits"), n(0).alias("run"), F.lit(True).alias("zero"))
    total = F.aggregate(values, start, step, lambda s: s["bits"] + S.run_length_bits(s["run"]))
    return F.when(F.size(values) > 0, total).otherwise(F.lit(0)).cast("long")


def plain_bits_7(values: str, counts: list[int]) -> Column:
    """The third generation's cost: an integer mean and no escape for large quotients."""

    def step(s: Column, v: Column) -> Column:
        m = S.zigzag(v)
        k = low_bits(s["a"], counts)
        q = F.floor(m / F.pow(F.lit(2), k)).cast("long")
        return F.struct(F.floor((m + s["a"] + 1) / 2).cast("long").alias("a"), (s["bits"] + q + 1 + k).alias("bits"))

    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("bits"))
    return F.aggregate(values, start, step)["bits"]


def row_route(kind: str, component: str, interleaved: str) -> Column:
    """The table row of a component: kind 0 plain, 1 run-length; alpha shares the first component's row."""
    k, c = F.col(kind), F.col(component)
    return F.when(F.col(interleaved) == 1, 6 + k).when(c.isin(0, 3), 3 * k).otherwise(3 * k + c).cast("long")


def plain_states(values: Column, row: int, table: list[tuple[int, int, list[int]]] = DEFAULT) -> Column:
    """At each value of the plain fold: (mean without fraction, bit width of the value, value)."""
    rise, fall, _ = table[row]

    def step(s: Column, v: Column) -> Column:
        m = S.zigzag(v)
        seen = F.struct(F.floor(s["a"] / 16).alias("mean"), S.bit_width(m).alias("width"), m.alias("m"))
        return F.struct(S.mixed(s["a"], m, rise, fall).alias("a"), F.concat(s["out"], F.array(seen)).alias("out"))

    empty = F.array().cast("array<struct<mean:bigint,width:bigint,m:bigint>>")
    return F.aggregate(values, F.struct(F.lit(0).cast("long").alias("a"), empty.alias("out")), step)["out"]
