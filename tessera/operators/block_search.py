"""Exhaustive search with pruning: the cheapest (predictor, filter, scan, interleave) of each block.

Blocks are independent, so they are dealt to even tasks and a batch of them is searched as a whole
(no candidate rows): predictors and filters are tried in a fixed order and dropped when their energy exceeds 1.3
times the least so far, as the order decides; the survivors' bits are estimated for all blocks of a
batch at once in NumPy, step by step along the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import N, SIDE, scan_orders
from ..functions.costs import DEFAULT, bit_lengths
from ..functions.scalars import PERMUTATIONS

#: The order in which predictors are tried.
PREDICTOR_ORDER = [0, 4, 1, 3, 5, 2, 7, 6]
#: The order in which filter codes are tried.
FILTER_ORDER = [
    71, 86, 7, 87, 23, 0, 39, 6, 55, 70, 27, 94, 79, 75, 31, 37, 59, 95, 11, 91, 43, 22, 53, 5,
    19, 8, 14, 78, 51, 69, 57, 40, 15, 38, 3, 56, 25, 13, 88, 16, 36, 93, 24, 4, 10, 21, 32, 2,
    72, 26, 77, 48, 54, 90, 44, 85, 18, 41, 64, 74, 45, 30, 67, 73, 50, 61, 80, 47, 1, 83, 29, 35,
    60, 63, 9, 49, 58, 42, 17, 33, 52, 66, 82, 89, 65, 84, 68, 20, 46, 34, 81, 92, 62, 12, 76, 28,
]
GIVE_UP = 1.3
RATIOS = [(rise, fall) for rise, fall, _ in DEFAULT]
LOW_BITS = np.array([bit_lengths(counts) for _, _, counts in DEFAULT])
TOGETHER = 64  # blocks of a step
SEQUENCES = 4096  # sequences costed together
LARGEST = 4095  # mapped values whose costs are in tables; those of bytes are below 2048


def half(v: np.ndarray) -> np.ndarray:
    """Half, towards zero."""
    return np.sign(v) * (np.abs(v) // 2)


def residuals_of(windows: np.ndarray, predictor: int) -> np.ndarray:
    """Windows (n, components, height + 1, width + 2) have a pixel more above and on both sides; the result is (n, components, values)."""
    left, up, corner, right = windows[:, :, 1:, :-2], windows[:, :, :-1, 1:-1], windows[:, :, :-1, :-2], windows[:, :, :-1, 2:]
    if predictor == 0:
        high, low = np.maximum(left, up), np.minimum(left, up)
        guess = np.where(corner > high, low, np.where(corner < low, high, left + up - corner))
    else:
        guess = [None, (left + corner + 1) >> 1, (up + corner + 1) >> 1, (up + right + 1) >> 1, left, up, corner, right][predictor]
    return (windows[:, :, 1:, 1:-1] - guess).reshape(*windows.shape[:2], -1)


def windows_of(px: np.ndarray) -> np.ndarray:
    """Blocks (n, components, 64) that stand alone: nothing but zeros around them."""
    n, c, _ = px.shape
    out = np.zeros((n, c, SIDE + 1, SIDE + 2), np.int64)
    out[:, :, 1:, 1:-1] = px.reshape(n, c, SIDE, SIDE)
    return out


def residuals(px: np.ndarray, predictor: int) -> np.ndarray:
    return residuals_of(windows_of(px), predictor)


def filtered(r: np.ndarray, code: int) -> np.ndarray:
    out = r.copy()
    d0, d1, d2 = (r[:, p] for p in PERMUTATIONS[(code >> 4) % 6])
    one = [0, d0, half(d0), half(3 * d0)][(code >> 2) & 3]
    two = [0, d0, d1, half(d0 + d1)][code & 3]
    out[:, 0], out[:, 1], out[:, 2] = d0, d1 - one, d2 - two
    return out


def width(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64) + 1, 0)


def gamma(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, 2 * width(v) - 1, 0)


def run_bits(n: np.ndarray) -> np.ndarray:
    return np.where(n <= 2, n, 2 + gamma(n - 2))


def coded(m: np.ndarray, a: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """A value's bits under the mean, and the next mean."""
    rise, fall = RATIOS[row]
    k = LOW_BITS[row][np.minimum((a + 8) >> 4, 1023)]
    q = m >> k
    bits = np.where(q < 16, q + 1 + k, 16 + gamma(m - 15))
    return bits, np.where(a < m, (m * 16 * rise + a * (16 - rise) + 8) >> 4, (m * 16 * fall + a * (16 - fall) + 8) >> 4)


@lru_cache(len(RATIOS))
def tables(row: int) -> tuple[np.ndarray, np.ndarray]:
    """By mean: where the costs under it begin; and these costs, by mapped value."""
    places = np.array(LOW_BITS[row])[np.minimum((np.arange(16 * LARGEST + 1) + 8) >> 4, 1023)].astype(np.intp) * (LARGEST + 1)
    m = np.arange(LARGEST + 1)
    low = range(int(LOW_BITS[row].max()) + 1)
    return places, np.concatenate([np.where(m >> k < 16, (m >> k) + 1 + k, 16 + gamma(m - 15)) for k in low]).astype(np.int32)


def mapped(v: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, 2 * v, -2 * v - 1)


def fold(m: np.ndarray, orders: list[np.ndarray], row: int, by_runs: bool) -> np.ndarray:
    """Bits of mapped values (steps, n) in each order of the steps: (orders, n). All sequences go step by step together."""
    n, (rise, fall) = m.shape[1], RATIOS[row]
    m = np.ascontiguousarray(m, np.intp)
    total = np.zeros((len(orders), n), np.int32 if m.max(initial=0) <= LARGEST else np.int64)
    some = None  # at which steps any, and which, sequences have nothing to code
    if by_runs:
        coded_here = m > 0
        if not coded_here.all():
            some = ~coded_here.all(axis=1)
        for at, order in enumerate(orders):
            total[at] = 1 + run_sums(coded_here[order].T if some is not None else np.ones((n, len(order)), bool))
        m = np.maximum(m - 1, 0)
    if m.max(initial=0) > LARGEST:  # beyond the tables
        for at, order in enumerate(orders):
            a = np.zeros(n, np.int64)
            for i in order:
                bits, after = coded(m[i], a, row)
                if some is not None and some[i]:
                    bits, after = np.where(coded_here[i], bits, 0), np.where(coded_here[i], after, a)
                total[at] += bits
                a = after
        return total
    places, costs = tables(row)
    falling = m * (16 * fall) + 8
    bits, k = np.empty(n, np.int32), np.empty(n, np.intp)
    for at, order in enumerate(orders):
        own, a, after = total[at], np.zeros(n, np.intp), np.empty(n, np.intp)
        for i in order.tolist():
            v = m[i]
            places.take(a, out=k, mode="clip")
            k += v
            costs.take(k, out=bits, mode="clip")
            np.multiply(a, 16 - fall, out=after)
            after += falling[i]
            after >>= 4
            up = (a < v).nonzero()[0]
            if len(up):
                after[up] = (v[up] * (16 * rise) + a[up] * (16 - rise) + 8) >> 4
            if some is not None and some[i]:
                bits *= coded_here[i]
                np.copyto(a, after, where=coded_here[i])
            else:
                a, after = after, a
            own += bits
    return total


def run_sums(v: np.ndarray) -> np.ndarray:
    """Bits of the lengths of runs of equal neighbours in each row."""
    n, steps = v.shape
    begins = np.ones((n, steps), bool)
    begins[:, 1:] = v[:, 1:] != v[:, :-1]
    at = np.flatnonzero(begins)
    return np.bincount(at // steps, weights=run_bits(np.arange(steps + 1))[np.diff(at, append=n * steps)], minlength=n).astype(np.int64)


def plain(v: np.ndarray, row: int) -> np.ndarray:
    return fold(mapped(v).T, [np.arange(v.shape[1])], row, False)[0]


def runs(v: np.ndarray, row: int) -> np.ndarray:
    return fold(mapped(v).T, [np.arange(v.shape[1])], row, True)[0]


def forms(r: np.ndarray) -> np.ndarray:
    """All sequences that filters make of residuals (n, components, values), each once: (forms, n, values); of_code says which a code takes."""
    pairs = [(t, s) for t in range(3) for s in range(3) if t != s]
    h1, h3 = half(r[:, :3]), half(3 * r[:, :3])
    out = [r[:, c] for c in range(3)] + [r[:, t] - x[:, s] for x in (r, h1, h3) for t, s in pairs]
    out += [r[:, t] - half(sum(r[:, s] for s in range(3) if s != t)) for t in range(3)]
    return np.stack(out + [r[:, c] for c in range(3, r.shape[1])])


@lru_cache(1)
def of_code() -> np.ndarray:
    """The three forms of each filter code."""
    pairs = {(t, s): 3 + i for i, (t, s) in enumerate((t, s) for t in range(3) for s in range(3) if t != s)}
    out = []
    for code in range(96):
        d0, d1, d2 = PERMUTATIONS[(code >> 4) % 6]
        one = [d1, pairs[d1, d0], pairs[d1, d0] + 6, pairs[d1, d0] + 12][(code >> 2) & 3]
        two = [d2, pairs[d2, d0], pairs[d2, d1], 21 + d2][code & 3]
        out.append((d0, one, two))
    return np.array(out)


def search(px: np.ndarray, scans: list[int]) -> list[tuple]:
    return search_windows(windows_of(px), scans)


def search_windows(windows: np.ndarray, scans: list[int]) -> list[tuple]:
    """(best rank, bits, coder, second rank, bits, coder, tuples tried) of each block; one scan for blocks that are not 8x8.

    Codes share the sequences of single components, so these are costed once for all codes; the
    interleaved sequences are costed for each code, SEQUENCES at a time.
    """
    n, components = windows.shape[:2]
    least_r, least_f = np.full(n, np.inf), np.full(n, np.inf)
    blocks, heads, made = [], [], []
    for p in PREDICTOR_ORDER:
        r = residuals_of(windows, p)
        energy = (r.astype(float) ** 2).sum(axis=(1, 2))
        live = ~(energy > least_r * GIVE_UP)
        np.minimum(least_r, energy, out=least_r, where=live)
        made.append(forms(r))
        energies = (made[-1].astype(float) ** 2).sum(axis=2)
        of_codes = energies[of_code()].sum(axis=1) + energies[24:].sum(axis=0)
        for code in FILTER_ORDER:
            energy = of_codes[code]
            keep = live & ~(energy > least_f * GIVE_UP)
            np.minimum(least_f, energy, out=least_f, where=keep)
            own = np.flatnonzero(keep)
            blocks.append(own)
            heads.append(np.full(len(own), p * 96 + code))
    block, head = np.concatenate(blocks), np.concatenate(heads)
    values = mapped(np.stack([made[PREDICTOR_ORDER.index(p)] for p in range(8)]))  # (predictors, forms, n, values)
    form = np.concatenate((of_code()[head % 96], np.tile(np.arange(24, 21 + components), (len(head), 1))), axis=1)
    places = ((head // 96)[:, None] * values.shape[1] + form) * n + block[:, None]  # rows of `flat`
    size = values.shape[3]
    flat = values.reshape(-1, size)
    all_orders = [np.array(o) for o in scan_orders().values()]
    orders = [all_orders[s] if size == N else np.arange(size) for s in scans]
    mixed_orders = [(o[:, None] * components + np.arange(components)).ravel() for o in orders]
    apart = np.zeros((2, len(scans), len(head)), np.int64)
    for c in range(components):
        used, which = np.unique(places[:, c], return_inverse=True)
        for coder in (0, 1):
            row = 3 * coder + (c if c < 3 else 0)
            apart[coder] += np.concatenate([fold(flat[used[i : i + SEQUENCES]].T, orders, row, bool(coder)) for i in range(0, len(used), SEQUENCES)], axis=1)[:, which]
    mixed = np.zeros((2, len(scans), len(head)), np.int64)
    for i in range(0, len(head), SEQUENCES):
        m = flat[places[i : i + SEQUENCES]].transpose(2, 1, 0).reshape(size * components, -1)
        for coder in (0, 1):
            mixed[coder, :, i : i + SEQUENCES] = fold(m, mixed_orders, 6 + coder, bool(coder))
    both = np.stack((apart, mixed), axis=3)  # (coders, scans, heads, interleave)
    rank = ((head[None, :, None] * 8 + np.array(scans)[:, None, None]) * 2 + np.arange(2)).ravel()
    bits, coder = both.min(axis=0).ravel(), both.argmin(axis=0).ravel()
    block = np.broadcast_to(block[None, :, None], both.shape[1:]).ravel()
    order = np.lexsort((rank, bits, block))
    block, rank, bits, coder = block[order], rank[order], bits[order], coder[order]
    start = np.searchsorted(block, np.arange(n + 1))
    out = []
    for i in range(n):
        a, count = start[i], start[i + 1] - start[i]
        first = (int(rank[a]), int(bits[a]), int(coder[a]))
        second = (int(rank[a + 1]), int(bits[a + 1]), int(coder[a + 1])) if count > 1 else (None, None, None)
        out.append((*first, *second, int(count)))
    return out


def dealt(planes: DataFrame) -> DataFrame:
    """Rows in even tasks: a block costs milliseconds, and one row group of a file holds very many."""
    spark = planes.sparkSession
    return planes.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


SCHEMA = "block_id long, best_rank long, best_bits long, best_coder long, second_rank long, second_bits long, second_coder long, tried long"


def searched(planes: DataFrame, scans: list[int] | None = None) -> DataFrame:
    """planes(block_id, c0, c1, c2: 64 values each) -> each block's two cheapest settings; scans: indexes of scan orders, all by default."""
    scans = list(range(len(scan_orders()))) if scans is None else scans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                px = np.stack([part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, N) for c in (1, 2, 3)], axis=1)
                found = search(px, scans)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    whole = F.lit(True)
    for c in ("c0", "c1", "c2"):
        whole = whole & (F.size(c) == N)
    rows = planes.where(whole).select(F.col("block_id").cast("long").alias("block_id"), *(F.col(c).cast("array<long>").alias(c) for c in ("c0", "c1", "c2")))
    return dealt(rows).mapInArrow(run, SCHEMA)
