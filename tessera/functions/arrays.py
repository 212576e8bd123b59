"""Kernels on 8x8 blocks held as arrays: neighbours, residuals, scan orders, transforms, features.

All are higher-order functions on array columns; a block never leaves its row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

SIDE = 8
N = SIDE * SIDE


def at(values: str | Column, y: Column, x: Column) -> Column:
    """A pixel by row and column, 0 outside the block."""
    inside = (x >= 0) & (x < SIDE) & (y >= 0)
    v = F.col(values) if isinstance(values, str) else values
    return F.when(inside, F.get(v, (y * SIDE + x).cast("int"))).otherwise(F.lit(0)).cast("long")


def over_block(f: Callable[[Column, Column], Column], n: int = N) -> Column:
    """An array of f(y, x) in raster order."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: f(F.floor(i / SIDE), i % SIDE))


def predicted(values: str, predictor: int) -> Column:
    return over_block(lambda y, x: S.predictors(at(values, y, x - 1), at(values, y - 1, x), at(values, y - 1, x - 1), at(values, y - 1, x + 1))[predictor])


def residual(values: str, predictor: int) -> Column:
    return F.zip_with(values, predicted(values, predictor), lambda v, p: (v - p).cast("long"))


def energy(values: str | Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))


# Scan orders, each from its rule.


@lru_cache(1)
def scan_orders() -> dict[str, list[int]]:
    def hilbert(d: int) -> tuple[int, int]:
        x = y = 0
        t, s = d, 1
        while s < SIDE:
            rx, ry = 1 & (t // 2), 0
            ry = 1 & (t ^ rx)
            if ry == 0:
                if rx == 1:
                    x, y = s - 1 - x, s - 1 - y
                x, y = y, x
            x, y, t, s = x + s * rx, y + s * ry, t // 4, s * 2
        return x, y

    curve = [hilbert(d) for d in range(N)]
    curve = curve if curve[1] == (0, 1) else [(y, x) for x, y in curve]
    diagonal = sorted(range(N), key=lambda i: (i // SIDE + i % SIDE, (i % SIDE if (i // SIDE + i % SIDE) % 2 == 0 else i // SIDE)))
    rows = [y * SIDE + (x if y % 2 == 0 else SIDE - 1 - x) for y in range(SIDE) for x in range(SIDE)]
    return {
        "hilbert": [y * SIDE + x for x, y in curve],
        "diagonal": diagonal,
        "antidiagonal": mirrored(diagonal),
        "horizontal": rows,
        "vertical": [(i % SIDE) * SIDE + i // SIDE for i in rows],
        "steep": STEEP,
        "flat": [STEEP[(i % SIDE) * SIDE + i // SIDE] for i in range(N)],
        "flat_up": [STEEP[(i % SIDE) * SIDE + SIDE - 1 - i // SIDE] for i in range(N)],
    }


#: The sixth scan order, in pairs of rows along diagonals, by place in the block.
STEEP = [
    0, 2, 11, 12, 27, 28, 43, 44,
    1, 3, 10, 13, 26, 29, 42, 45,
    4, 9, 14, 25, 30, 41, 46, 57,
    5, 8, 15, 24, 31, 40, 47, 56,
    6, 16, 23, 32, 39, 48, 55, 58,
    7, 17, 22, 33, 38, 49, 54, 59,
    18, 21, 34, 37, 50, 53, 60, 62,
    19, 20, 35, 36, 51, 52, 61, 63,
]


def mirrored(order: list[int]) -> list[int]:
    """The order with each row of eight places reversed."""
    return [order[i // SIDE * SIDE + SIDE - 1 - i % SIDE] for i in range(N)]


def scanned(values: str, order: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(F.col(values), i).cast("long"))


def unscanned(values: str, order: list[int]) -> Column:
    inverse = sorted(range(len(order)), key=order.__getitem__)
    return scanned(values, inverse)


def interleaved(*components: str) -> Column:
    """All first values, then all second values, and so on."""
    zipped = F.arrays_zip(*(F.col(c) for c in components))
    return F.flatten(F.transform(zipped, lambda s: F.array(*(s[c].cast("long") for c in components))))


def total_variation(values: str | Column, power: int = 1) -> Column:
    """Mean absolute (or squared) step between neighbours of a sequence."""
    v = F.col(values) if isinstance(values, str) else values
    steps = F.zip_with(F.slice(v, 2, N - 1), F.slice(v, 1, N - 1), lambda a, b: F.pow(F.abs(a - b).cast("double"), F.lit(float(power))))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (N - 1)


# Colour and block features.


def luma(r: Column, g: Column, b: Column, scale: float = 255.0) -> Column:
    return (0.299 * r.cast("double") + 0.587 * g.cast("double") + 0.114 * b.cast("double")) / scale


def luma_block(r: str, g: str, b: str, scale: float = 255.0) -> Column:
    return F.transform(F.arrays_zip(F.col(r), F.col(g), F.col(b)), lambda p: luma(p[r], p[g], p[b], scale))


def mean(values: str | Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)


def variance(values: str | Column) -> Column:
    """Population variance as the mean square less the squared mean."""
    m = mean(values)
    v = F.col(values) if isinstance(values, str) else values
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(v) - m * m


def pooled(values: str) -> Column:
    """4x4 means of 2x2 pixels."""
    v = F.col(values)

    def cell(i: Column) -> Column:
        top = (F.floor(i / 4) * 2 * SIDE + (i % 4) * 2).cast("int")
        return (F.get(v, top) + F.get(v, top + 1) + F.get(v, top + SIDE) + F.get(v, top + SIDE + 1)) / 4.0

    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def dct_low(values: str) -> Column:
    """The 4x4 lowest coefficients of the unnormalised cosine transform, row by row."""
    cos = lambda k, i: math.cos(math.pi * (2 * i + 1) * k / (2 * SIDE))
    basis = [F.array(*(F.lit(cos(u, i // SIDE) * cos(v, i % SIDE)) for i in range(N))) for u in range(4) for v in range(4)]
    return F.array(*(F.aggregate(F.zip_with(F.col(values), b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for b in basis))
