"""Scalar functions on columns: setting codes, bit costs, predictors, filters. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Column, b: int) -> Column:
    """Integer division towards zero."""
    return F.when(a >= 0, F.floor(a / b)).otherwise(-F.floor(-a / b)).cast("long")


# Setting codes: perm (0-5), primary (0-3), secondary (0-3) in one filter code; a rank for each tuple.


def filter_perm(code: C) -> Column:
    return F.shiftright(col(code).cast("long"), 4) % 6


def filter_primary(code: C) -> Column:
    return F.shiftright(col(code).cast("long"), 2).bitwiseAND(F.lit(3))


def filter_secondary(code: C) -> Column:
    return col(code).cast("long").bitwiseAND(F.lit(3))


def join_filter(perm: C, primary: C, secondary: C) -> Column:
    return ((col(perm) % 6) * 16 + (col(primary) % 4) * 4 + col(secondary) % 4).cast("long")


def tuple_rank(predictor: C, filter_code: C, reorder: C, interleave: C) -> Column:
    return (((col(predictor) * 96 + col(filter_code)) * 8 + col(reorder)) * 2 + col(interleave)).cast("long")


def split_rank(rank: C) -> dict[str, Column]:
    """The tuple of a rank: predictor, filter_code, reorder, interleave."""
    r = col(rank).cast("long")
    return {"predictor": F.floor(r / 1536), "filter_code": F.floor(r / 16) % 96, "reorder": F.floor(r / 2) % 8, "interleave": r % 2}


def filter_i(filter_code: C, interleave: C) -> Column:
    return (col(filter_code) + 96 * col(interleave)).cast("long")


def triad(predictor: C, filter_i_: C, reorder: C) -> Column:
    return ((col(predictor) * 192 + col(filter_i_)) * 8 + col(reorder)).cast("long")


# Bit costs.


def bit_width(v: C) -> Column:
    return F.when(col(v) <= 0, F.lit(0)).otherwise(F.length(F.bin(col(v).cast("long")))).cast("long")


def zigzag(v: C) -> Column:
    return F.when(col(v) >= 0, 2 * col(v)).otherwise(-2 * col(v) - 1).cast("long")


def zigzag_nonzero(v: C) -> Column:
    return F.greatest(F.lit(0), zigzag(v) - 1).cast("long")


def unzigzag(m: C) -> Column:
    return F.when(col(m) % 2 == 1, -F.floor((col(m) + 1) / 2)).otherwise(F.floor(col(m) / 2)).cast("long")


def gamma_bits(v: C) -> Column:
    return F.when(col(v) <= 0, F.lit(0)).otherwise(2 * bit_width(v) - 1).cast("long")


def run_length_bits(n: C) -> Column:
    return F.when(col(n) <= 2, F.greatest(F.lit(0), col(n))).otherwise(2 + gamma_bits(col(n) - 2)).cast("long")


def zero_run_bits_7(n: C) -> Column:
    """The third codec generation's cost of a run of zeros."""
    return F.when(col(n) <= 3, F.greatest(F.lit(0), col(n))).otherwise(3 + gamma_bits(col(n) - 3)).cast("long")


def varuint_bits(v: C) -> Column:
    return (8 * F.greatest(F.lit(1), F.ceil(bit_width(v) / 7))).cast("long")


def golomb_value_bits(m: C, k: C) -> Column:
    """A quotient of 16 or more is escaped: k plays no part then."""
    q = F.floor(col(m) / F.pow(F.lit(2), col(k))).cast("long")
    return F.when(q < 16, q + 1 + col(k)).otherwise(16 + gamma_bits(col(m) - 15)).cast("long")


def mixed(a: C, m: C, rise: int, fall: int) -> Column:
    """The adaptive mean after m: four fractional bits, compared unscaled."""
    a, m = col(a), col(m)
    step = lambda r: F.floor((m * 16 * r + a * (16 - r) + 8) / 16)
    return F.when(a < m, step(rise)).otherwise(step(fall)).cast("long")


# Predictors of a pixel from its neighbours: a left, b up, c up-left, d up-right.


def med(a: C, b: C, c: C) -> Column:
    a, b, c = col(a), col(b), col(c)
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(c > high, low).when(c < low, high).otherwise(a + b - c).cast("long")


def half_up(x: Column, y: Column) -> Column:
    return F.floor((x + y + 1) / 2).cast("long")


def predictors(a: C, b: C, c: C, d: C) -> list[Column]:
    a, b, c, d = (col(x).cast("long") for x in (a, b, c, d))
    return [med(a, b, c), half_up(a, c), half_up(b, c), half_up(b, d), a, b, c, d]


def med_7(a: C, b: C, c: C) -> Column:
    a, b, c = col(a), col(b), col(c)
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(c >= high, low).when(c <= low, high).otherwise(a + b - c).cast("long")


def average_7(a: C, b: C, c: C) -> Column:
    """A third of the sum, rounded alike on both sides of zero."""
    s = col(a) + col(b) + col(c)
    return F.when(s >= 0, F.floor((s + 1) / 3)).otherwise(-F.floor((1 - s) / 3)).cast("long")


# Colour filters on a triple.

#: The order in which a filter takes the three components.
PERMUTATIONS = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]


def color_filter(code: C, c0: C, c1: C, c2: C) -> list[Column]:
    """The first component kept, the other two as residuals of what the filter predicts."""
    source = F.array(*(col(c).cast("long") for c in (c0, c1, c2)))
    perm = F.array(*(F.array(*map(F.lit, p)) for p in PERMUTATIONS))
    d = [source[perm[filter_perm(code).cast("int")][i]] for i in range(3)]
    one = F.when(filter_primary(code) == 0, F.lit(0)).when(filter_primary(code) == 1, d[0]).when(filter_primary(code) == 2, div(d[0], 2)).otherwise(div(3 * d[0], 2))
    two = F.when(filter_secondary(code) == 0, F.lit(0)).when(filter_secondary(code) == 1, d[0]).when(filter_secondary(code) == 2, d[1]).otherwise(div(d[0] + d[1], 2))
    return [d[0], (d[1] - one).cast("long"), (d[2] - two).cast("long")]


def side_info(filter_code: C, mode: C, diff: C, plain: C) -> Column:
    """7 + 1 + 3 + 4 bits in one number, the filter lowest."""
    return (col(filter_code) + col(mode) * 128 + col(diff) * 256 + col(plain) * 2048).cast("long")
