"""Filters and predictors of the earlier codec generations, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S
from .arrays import SIDE, at, over_block

#: Fixed values of the sixth generation: how blue, green and red come back from the filtered
#: components, as weights of (blue, green, red); sums are modulo 256. One line a code.
UNDO_6 = [
    [[1, 0, 0], [0, 1, 0], [0, 0, 1]],
    [[1, 1, 0], [0, 1, 0], [0, 1, 1]],
    [[1, 0, 0], [1, 1, 0], [1, 1, 1]],
    [[1, 1, 1], [0, 1, 1], [0, 0, 1]],
    [[1, 0, 1], [1, 1, 1], [1, 1, 2]],
    [[1, 0, 1], [1, 1, 1], [0, 0, 1]],
    [[1, 1, 0], [0, 1, 0], [0, 0, 1]],
    [[1, 0, 0], [1, 1, 0], [0, 0, 1]],
    [[1, 0, 0], [0, 1, 0], [0, 1, 1]],
    [[2, 1, 1], [1, 1, 1], [1, 0, 1]],
    [[1, 0, 1], [0, 1, 1], [0, 0, 1]],
    [[1, 0, 0], [1, 1, 0], [1, 0, 1]],
    [[1, 0, 0], [1, 1, 1], [1, 0, 1]],
    [[1, 1, 0], [1, 2, 1], [1, 1, 1]],
    [[1, 1, 1], [0, 1, 1], [1, 1, 2]],
    [[1, 0, 0], [2, 1, 0], [2, 0, 1]],
]


def apply_weights() -> list[list[list[int]]]:
    """The inverse matrices: all determinants are 1 or -1, so they are whole."""

    def inverse(m: list[list[int]]) -> list[list[int]]:
        minor = lambda r, c: [[v for j, v in enumerate(row) if j != c] for i, row in enumerate(m) if i != r]
        det2 = lambda a: a[0][0] * a[1][1] - a[0][1] * a[1][0]
        cofactor = lambda r, c: (-1) ** (r + c) * det2(minor(r, c))
        det = sum(m[0][c] * cofactor(0, c) for c in range(3))
        return [[cofactor(c, r) * det for c in range(3)] for r in range(3)]

    return [inverse(m) for m in UNDO_6]


def weighed(weights: list[list[int]], parts: list[Column]) -> list[Column]:
    return [F.pmod(sum((w * p for w, p in zip(row[1:], parts[1:], strict=True)), row[0] * parts[0]), F.lit(256)).cast("long") for row in weights]


def filter_6(code: int, b: Column, g: Column, r: Column) -> list[Column]:
    return weighed(apply_weights()[code], [b, g, r])


def unfilter_6(code: int, b: Column, g: Column, r: Column) -> list[Column]:
    return weighed(UNDO_6[code], [b, g, r])


def med_6(a: Column, b: Column, c: Column) -> Column:
    """A corner at the upper bound takes the lower neighbour; only one below the lower bound the upper."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(c >= high, low).when(c < low, high).otherwise(a + b - c).cast("long")


def filter_7(code: Column | str, c0: Column | str, c1: Column | str, c2: Column | str) -> list[Column]:
    """Both residuals are taken from the first component: none, half, all or one and a half of it."""
    source = F.array(*(S.col(c).cast("long") for c in (c0, c1, c2)))
    perm = F.array(*(F.array(*map(F.lit, p)) for p in S.PERMUTATIONS))
    d = [source[perm[S.filter_perm(code).cast("int")][i]] for i in range(3)]
    guess = lambda mode: F.when(mode == 0, F.lit(0)).when(mode == 1, S.div(d[0], 2)).when(mode == 2, d[0]).otherwise(S.div(3 * d[0], 2))
    return [d[0], (d[1] - guess(S.filter_primary(code))).cast("long"), (d[2] - guess(S.filter_secondary(code))).cast("long")]


#: The neighbour (column, row) that a directional difference subtracts.
DIRECTIONS = {"down_right": (-1, -1), "down_left": (1, -1), "horizontal": (1, 0), "vertical": (0, -1)}


def directional(values: str, dx: int, dy: int) -> Column:
    return over_block(lambda y, x: at(values, y, x) - F.when((x + dx < SIDE) & (x + dx >= 0) & (y + dy >= 0), at(values, y + dy, x + dx)).otherwise(F.lit(0)))


def undirectional(values: str, dx: int, dy: int) -> Column:
    """A pixel back: the sum of differences along the way its direction goes."""

    def back(y: Column, x: Column) -> Column:
        total = at(values, y, x)
        for k in range(1, SIDE):
            total = total + F.when((x + k * dx < SIDE) & (x + k * dx >= 0) & (y + k * dy >= 0), at(values, y + k * dy, x + k * dx)).otherwise(F.lit(0))
        return total

    return over_block(back)
