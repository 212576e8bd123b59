"""N-gram Jaccard join (operator 1): signature trees over word-shingle sets.

Documents link when the Jaccard similarity of their sets of k-word shingles reaches num/den; the
result is each document's component. All steps are exact.

1. `profile`: one scan gives each document's set size, set hash and token bitmap (its shingles
   hashed into a power of two of bits, one to two a shingle), and a count sketch of all shingles.
   Documents with equal sets are one class from here on, so groups of copies, however large, cost
   one row.
2. `postings`: two sets that link share a shingle among the (1 - t) n + 1 first ones of each, in
   any common order. The order puts shingles first that the sketch calls rare, so a passage that
   many documents share rarely is in a prefix. Prefix shingles travel packed (16 bytes each, one
   row a bucket and task); a bucket keeps the shingles that more than one class has.
3. Signature trees hold classes as leaves; a node above ORs its children's bitmaps and spans their
   sizes (fan-out 8, a tree a bitmap width). Two trees are descended together, and a pair of nodes
   is pruned by the largest overlap it can have. Every pair that is compared by set comes out of
   such a traversal. First each shingle's smallest class, its leader, meets the trees of its other
   classes, and what links is merged: that settles a large group of near copies in linear work.
4. What is left are shingles whose classes are not in one component yet; shingles of equal
   postings count once. Their classes meet in blocks: one block a shingle if it is small, else
   blocks of the leader's component against all others, and pairs of blocks among the others.
   In a block the trees of its classes are traversed against each other. Pairs that survive
   are compared by set; a block with more pairs than classes compares them in place, unless
   their components have met already, so that no group sends out all its pairs.

Hashes have 64 bits; two different sets count as equal if their hashes agree (about n^2 / 2^65).

Defined cases: null or empty texts and texts without words have no shingles, link with nothing
and are their own component; a null doc_id takes part in nothing and gets a null component;
repeated rows link as copies do; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components
from .words import U, mix, shingles, words

CELLS = 1 << 22
CELL_ROW = 1 << 14
CHUNK = 2 << 20  # bytes of text hashed at a time
FLUSH = 1 << 19  # prefix shingles that a task holds
BLOCK = 256  # classes of a block
NARROW, WIDE = 64, 1 << 15  # bits of a bitmap
FAN = 8


def parts(batch: pa.RecordBatch, drop_null: bool = True) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_id, text) slices of about CHUNK bytes, without rows whose doc_id is null unless they are to stay."""
    if drop_null and batch.column(0).null_count:
        batch = batch.filter(pc.is_valid(batch.column(0)))
    docs, texts = batch.column(0), batch.column(1)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CHUNK, "right")))
        yield docs.slice(i, j - i), texts.slice(i, j - i)
        i = j


def identity(s: np.ndarray) -> int:
    """A set's hash: order plays no part."""
    return int(mix(np.array([mix(s).sum(dtype=U) + U(len(s))], dtype=U)).view(np.int64)[0])


def width(n: int) -> int:
    return min(WIDE, max(NARROW, 1 << n.bit_length()))


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(width(len(s)), dtype=bool)
    bits[(s & U(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def profiled(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h", pa.int64()), ("bits", pa.binary()), ("cell", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.int32)
        for batch in batches:
            for docs, texts in parts(batch):
                n, h, bits = [], [], []
                for s in shingles(*words(texts), k):
                    n.append(len(s))
                    h.append(identity(s) if len(s) else None)
                    bits.append(bitmap(s) if len(s) else None)
                    counts[(s & U(CELLS - 1)).astype(np.int64)] += 1  # within a set two shingles of a cell count once
                nothing = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
                yield pa.RecordBatch.from_arrays([docs, pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(bits, pa.binary()), *nothing], schema=schema)
        if counts.any():
            rows = range(CELLS // CELL_ROW)
            sums = [zlib.compress(counts[r * CELL_ROW : (r + 1) * CELL_ROW].tobytes(), 1) for r in rows]
            nothing = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(rows, pa.int32()), pa.array(sums, pa.binary())], schema=schema)

    return common.releasing(run)


@common.releasing
def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[cell] = total.get(cell, 0) + np.frombuffer(zlib.decompress(counts), dtype=np.int32).astype(np.int64)
    if total:
        yield pa.RecordBatch.from_pydict({"cell": pa.array(total, pa.int32()), "counts": pa.array([v.tobytes() for v in total.values()], pa.binary()), "n": pa.array([int(v.sum()) for v in total.values()], pa.int64())})


def levels(mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = []
            for counts in batch.column(1).to_pylist():
                times = np.frombuffer(counts, dtype=np.int64) / mean
                ranks.append(np.clip(8 + np.floor(4 * np.log2(np.maximum(times, 1e-9))), 0, 63).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict({"cell": batch.column(0), "ranks": pa.array(ranks, pa.binary())})

    return common.releasing(run)


def commonness(profile: DataFrame) -> np.ndarray:
    """For each cell of the sketch a rank from 0 to 63 that grows with its count."""
    cells = profile.where("cell is not null").select("cell", "counts").repartition(8, "cell").mapInArrow(summed, "cell int, counts binary, n long")
    cells = common.publish(cells, "sketch")
    mean = max(1.0, (cells.agg(F.sum("n").alias("n")).first()["n"] or 0) / CELLS)
    ranks = np.zeros(CELLS, dtype=np.uint8)
    for row in cells.mapInArrow(levels(mean), "cell int, ranks binary").collect():  # CELLS bytes
        ranks[row["cell"] * CELL_ROW : (row["cell"] + 1) * CELL_ROW] = np.frombuffer(row["ranks"], dtype=np.uint8)
    return ranks


def prefixed(k: int, num: int, den: int, rank: np.ndarray, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("hs", pa.binary())])

    def flush(tokens: list[np.ndarray], hs: list[np.ndarray]) -> pa.RecordBatch:
        t, h = np.concatenate(tokens), np.concatenate(hs)
        b = (mix(t) % U(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        t, h = t[order], h[order]
        ends = np.cumsum(np.bincount(b, minlength=buckets))
        full = [(i, a, e) for i, (a, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if e > a]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in full], pa.int32()), pa.array([t[a:e].tobytes() for _, a, e in full], pa.binary()), pa.array([h[a:e].tobytes() for _, a, e in full], pa.binary())], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, hs, held, seen = [], [], 0, set()
        for batch in batches:
            for _, texts in parts(batch):
                for s in shingles(*words(texts), k):
                    n = len(s)
                    if not n or (h := identity(s)) in seen:
                        continue
                    if len(seen) < FLUSH:
                        seen.add(h)
                    key = (rank[(s & U(CELLS - 1)).astype(np.int64)].astype(U) << U(58)) | (s >> U(6))
                    m = n - -(-num * n // den) + 1
                    tokens.append(np.partition(key, m - 1)[:m] if m < n else key)
                    hs.append(np.full(m, h, dtype=np.int64))
                    held += m
                if held >= FLUSH:
                    yield flush(tokens, hs)
                    tokens, hs, held = [], [], 0
        if held:
            yield flush(tokens, hs)

    return common.releasing(run)


@common.releasing
def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's buckets, the shingles with more than one class: (token, h, leader)."""
    tokens, hs = [], []
    for batch in batches:
        for t, h in zip(batch.column(1), batch.column(2), strict=True):
            tokens.append(np.frombuffer(t.as_buffer(), dtype=U).copy())
            hs.append(np.frombuffer(h.as_buffer(), dtype=np.int64).copy())
    if not tokens:
        return
    t, h = np.concatenate(tokens), np.concatenate(hs)
    del tokens, hs
    order = np.argsort(t)
    t, h = t[order], h[order]
    same = np.concatenate((t[1:] == t[:-1], [False]))
    same[1:] |= same[:-1].copy()
    t, h = t[same], h[same]
    if not len(t):
        return
    order = np.lexsort((h, t))
    t, h = t[order], h[order]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])))
    t, h = t[new], h[new]
    starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(t)))
    leader = np.repeat(h[starts], sizes)
    many = np.repeat(sizes, sizes) > 1
    t, h, leader = t[many].view(np.int64), h[many], leader[many]
    for i in range(0, len(t), 100_000):
        yield pa.RecordBatch.from_pydict({"token": t[i : i + 100_000], "h": h[i : i + 100_000], "leader": leader[i : i + 100_000]})


def bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of one long column: two bits a value, `bits` a power of two."""
    row = 1 << 16

    def spots(x: np.ndarray) -> list[np.ndarray]:
        m = mix(x.astype(np.int64).view(U))
        return [(m & U(bits - 1)).astype(np.int64), (m >> U(64 - bits.bit_length() + 1)).astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(bits, dtype=bool)
        for batch in batches:
            for s in spots(batch.column(0).to_numpy(zero_copy_only=False)):
                hit[s] = True
        packed = np.packbits(hit)
        rows = [i for i in range(0, len(packed), row) if packed[i : i + row].any()]
        yield pa.RecordBatch.from_pydict({"at": pa.array(rows, pa.int32()), "bits": pa.array([packed[i : i + row].tobytes() for i in rows], pa.binary())})

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, np.uint8(0)) | np.frombuffer(b, dtype=np.uint8)
        yield pa.RecordBatch.from_pydict({"at": pa.array(total, pa.int32()), "bits": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    found = np.zeros(bits // 8, dtype=np.uint8)
    schema = "at int, bits binary"
    for r in ids.mapInArrow(run, schema).repartition(8, "at").mapInArrow(union, schema).collect():  # `bits` bits at most
        found[r["at"] : r["at"] + row] = np.frombuffer(r["bits"], dtype=np.uint8)
    return found


def fetched(k: int, have: np.ndarray):
    """The shingle sets of documents whose id may be in the filter: (doc_id, h, n, shingles)."""
    bits = 8 * len(have)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.unpackbits(have).astype(bool)
        for batch in batches:
            if batch.column(0).null_count:
                batch = batch.filter(pc.is_valid(batch.column(0)))
            m = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U))
            batch = batch.filter(pa.array(hit[(m & U(bits - 1)).astype(np.int64)] & hit[(m >> U(64 - bits.bit_length() + 1)).astype(np.int64)]))
            for docs, texts in parts(batch):
                sets = list(shingles(*words(texts), k))
                full = [i for i, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": docs.take(pa.array(full, pa.int64())),
                        "h": pa.array([identity(sets[i]) for i in full], pa.int64()),
                        "n": pa.array([len(sets[i]) for i in full], pa.int64()),
                        "s": pa.array([sets[i].tobytes() for i in full], pa.binary()),
                    }
                )

    return common.releasing(run)


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def compared(num: int, den: int):
    """(u, v, set, set) -> the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = [links(np.frombuffer(a.as_buffer(), dtype=U), np.frombuffer(b.as_buffer(), dtype=U), num, den) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, o in zip(us, ok, strict=True) if o], pa.int64()), "v": pa.array([v for v, o in zip(vs, ok, strict=True) if o], pa.int64())})

    return common.releasing(run)


def fold(bits: np.ndarray, words_: int) -> np.ndarray:
    """A bitmap (or rows of them) of fewer bits: shingles that share the lower bits share a bit."""
    while bits.shape[-1] > words_:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class Tree:
    """A signature tree: leaves are sets, an inner node ORs its children's bitmaps and spans their sizes."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        spare = sizes - np.bitwise_count(bits).sum(axis=1)  # shingles beyond the first of each bit
        self.levels = [(bits, sizes, sizes, spare)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, spare = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))


def traversed(a: Tree, b: Tree, num: int, den: int) -> np.ndarray:
    """Pairs (leaf of a, leaf of b) that may link: both trees are descended together."""
    pairs = np.zeros((1, 2), dtype=np.int64)
    down_a, down_b = len(a.levels) - 1, len(b.levels) - 1
    kid = np.arange(FAN)
    while True:
        bits_a, low_a, high_a, spare_a = a.levels[down_a]
        bits_b, low_b, high_b, spare_b = b.levels[down_b]
        pairs = pairs[(pairs[:, 0] < len(low_a)) & (pairs[:, 1] < len(low_b))]
        i, j = pairs[:, 0], pairs[:, 1]
        keep = (den * high_a[i] >= num * low_b[j]) & (den * high_b[j] >= num * low_a[i])
        pairs, i, j = pairs[keep], i[keep], j[keep]
        most = np.bitwise_count(bits_a[i] & bits_b[j]).sum(axis=1) + np.minimum(spare_a[i], spare_b[j])
        most = np.minimum(most, np.minimum(high_a[i], high_b[j]))
        pairs = pairs[(den + num) * most >= num * (low_a[i] + low_b[j])]
        if not down_a and not down_b:
            return pairs
        if down_a >= down_b:
            down_a -= 1
            pairs = np.stack(((pairs[:, 0:1] * FAN + kid).ravel(), np.repeat(pairs[:, 1], FAN)), axis=1)
        else:
            down_b -= 1
            pairs = np.stack((np.repeat(pairs[:, 0], FAN), (pairs[:, 1:2] * FAN + kid).ravel()), axis=1)


def forest(bits: list[np.ndarray], sizes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By bitmap width: the sets' numbers in tree order, bitmaps and sizes."""
    by: dict[int, list[int]] = {}
    for i, b in enumerate(bits):
        by.setdefault(len(b), []).append(i)
    rows = {w: sorted(own, key=lambda i: (sizes[i] // 4, int(bits[i][0]))) for w, own in by.items()}
    return {w: (np.array(own), np.stack([bits[i] for i in own]), np.array([sizes[i] for i in own])) for w, own in rows.items()}


def between(one: dict, other: dict, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs (number in one, number in other) that may link; a wider bitmap is folded to the other's width."""
    found: list[tuple[int, int]] = []
    for w, (own, bits, sizes) in one.items():
        for v, (own2, bits2, sizes2) in other.items():
            if den * sizes.max() >= num * sizes2.min() and den * sizes2.max() >= num * sizes.min():
                least = min(w, v)
                a = Tree(fold(bits, least), sizes)
                p = traversed(a, a if bits is bits2 else Tree(fold(bits2, least), sizes2), num, den)
                found += zip(own[p[:, 0]].tolist(), own2[p[:, 1]].tolist(), strict=True)
    return found


def candidates(bits: list[np.ndarray], sizes: list[int], comps: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of different components that may link."""
    trees = forest(bits, sizes)
    return [(i, j) for i, j in between(trees, trees, num, den) if i < j and comps[i] != comps[j]]


def joined(pairs: list[tuple[int, int]], sets: list[np.ndarray], hs: list[int], comps: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links (h, h) that connect whatever the links among these pairs connect beyond `comps`."""
    up: dict[int, int] = {c: c for c in comps}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    found: list[tuple[int, int]] = []
    for i, j in pairs:
        a, b = root(comps[i]), root(comps[j])
        if a != b and links(sets[i], sets[j], num, den):
            up[max(a, b)] = min(a, b)
            found.append((hs[i], hs[j]))
    return found


BLOCK_ROWS = "u long, v long, token long, i int, j int"
BLOCK_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("token", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])


def blocked(num: int, den: int, with_sets: bool):
    """Rows sorted by (token, i, j): (token, i, j, h, comp, n, bits[, s]).

    Without sets: candidate pairs (u, v), or the block's key where there are more pairs than classes.
    With sets: links (u, v).
    """

    def groups(batches: Iterator[pa.RecordBatch]):
        key, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            columns = [batch.column(c).to_pylist() for c in range(3, batch.num_columns)]
            for k, *row in zip(keys, *columns, strict=True):
                if k != key and rows:
                    yield key, rows
                    rows = []
                key = k
                rows.append(row)
        if rows:
            yield key, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for key, rows in groups(batches):
            hs, comps, sizes = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
            if len(set(comps)) > 1:
                pairs = candidates([np.frombuffer(r[3], dtype=U) for r in rows], sizes, comps, num, den)
                if with_sets:
                    found += [(u, v, None, None, None) for u, v in joined(pairs, [np.frombuffer(r[4], dtype=U) for r in rows], hs, comps, num, den)]
                elif len(pairs) > len(rows):
                    found.append((None, None, *key))
                else:
                    found += [(hs[a], hs[b], None, None, None) for a, b in pairs]
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)

    return common.releasing(run)


def led(num: int, den: int):
    """(class, leader, n, bits, m, the leader's bits) -> (u, v): the leaders' trees against those of their classes in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaders = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(leaders, kind="stable")
            bits, sizes = [np.frombuffer(x, dtype=U) for x in batch.column(3).to_pylist()], batch.column(2).to_pylist()
            keep: list[int] = []
            for own in np.split(order, np.flatnonzero(np.diff(leaders[order])) + 1) if len(order) else []:
                lead = forest([np.frombuffer(batch.column(5)[own[0]].as_py(), dtype=U)], [batch.column(4)[own[0]].as_py()])
                keep += [int(own[i]) for _, i in between(lead, forest([bits[i] for i in own], [sizes[i] for i in own]), num, den)]
            yield batch.select([0, 1]).take(pa.array(sorted(keep), pa.int64()))

    return common.releasing(run)


def fetched_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted(h, rep) -> (h, s): one scan of the documents, of which a Bloom filter lets few through."""
    wanted = common.publish(wanted, "wanted")
    count = wanted.count()
    have = bloom(wanted.select("rep"), min(1 << 26, max(1 << 19, 1 << (16 * count).bit_length())))
    sets = docs.mapInArrow(fetched(k, have), "doc_id long, h long, n long, s binary").withColumnRenamed("h", "_h")
    sets = sets.join(wanted, (F.col("doc_id") == F.col("rep")) & (F.col("_h") == F.col("h"))).select("h", "s")
    return common.publish(sets.dropDuplicates(["h"]), "sets")


def verified(docs: DataFrame, pairs: DataFrame, active: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of pairs(u, v), those that link."""
    pairs = common.publish(pairs, "pairs")
    ends = pairs.select(F.col("u").alias("h")).union(pairs.select("v")).distinct()
    sets = fetched_sets(docs, ends.join(active, "h").select("h", "rep"), k)
    a, b = sets.toDF("u", "s"), sets.toDF("v", "s2")
    return common.publish(common.join_hot(pairs, b, ["v"]).join(a, "u").select("u", "v", "s", "s2").mapInArrow(compared(num, den), "u long, v long"), "linked")


def classed(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, h, component, comp) of all rows with an id: h is a set's hash, component the smallest doc_id, comp one h of the component; without words all three are null."""
    spark = docs.sparkSession
    n_parts = common.partitions(spark)
    docs = common.documents(docs)
    rows = common.publish(docs.mapInArrow(profiled(k), "doc_id long, n long, h long, bits binary, cell int, counts binary"), "profile")
    rank = commonness(rows)
    profile = rows.where("doc_id is not null").select("doc_id", "n", "h")

    packed = docs.mapInArrow(prefixed(k, num, den, rank, 4 * n_parts), "bucket int, tokens binary, hs binary")
    postings = common.publish(packed.repartition(n_parts, "bucket").mapInArrow(shared, "token long, h long, leader long"), "postings")
    classes = profile.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("rep"))
    active = postings.select("h").distinct().join(classes, "h").withColumnRenamed("h", "_h")
    active = rows.join(active, (F.col("doc_id") == F.col("rep")) & (F.col("h") == F.col("_h"))).select("h", "rep", "n", "bits").dropDuplicates(["h"])
    active = common.publish(active, "active")
    other = active.select(F.col("h").alias("leader"), F.col("n").alias("m"), F.col("bits").alias("bits2"))
    verify = lambda pairs: verified(docs, pairs, active, k, num, den)

    pairs = common.publish(postings.where("h <> leader").select("h", "leader").distinct(), "led")
    sides = common.join_hot(pairs, other, ["leader"]).join(active.select("h", "n", "bits"), "h").select("h", "leader", "n", "bits", "m", "bits2")
    stars = verify(sides.mapInArrow(led(num, den), "u long, v long"))
    met = components(stars)

    # Shingles whose classes are not all in one component.
    of = met.select(F.col("node").alias("h"), "comp")
    lead = met.select(F.col("node").alias("leader"), F.col("comp").alias("lead"))
    known = common.publish(common.join_hot(postings, of, ["h"], "left"), "known")
    known = common.join_hot(known, lead, ["leader"], "left").select("token", "h", F.coalesce("comp", "h").alias("comp"), (F.coalesce("comp", "h") == F.coalesce("lead", "leader")).alias("led"))
    tokens = known.groupBy("token").agg(
        F.count(F.when(F.col("led"), 1)).alias("x"),
        F.count(F.when(~F.col("led"), 1)).alias("u"),
        F.bit_xor(F.xxhash64("h")).alias("same1"),
        F.bit_xor(F.xxhash64("h", F.lit(1))).alias("same2"),
    )
    # Two classes of which one leads have been compared already.
    tokens = tokens.where("u > 1 or (u = 1 and x > 1)").groupBy("x", "u", "same1", "same2").agg(F.min("token").alias("token"))
    nx, nu = F.ceil(F.col("x") / BLOCK).cast("int"), F.ceil(F.col("u") / BLOCK).cast("int")
    tokens = tokens.select("token", "x", "u", nx.alias("nx"), nu.alias("nu"))
    small = (F.col("x") + F.col("u")) <= BLOCK
    mine = F.pmod(F.xxhash64("h", "token"), F.when(F.col("led"), F.col("nx")).otherwise(F.col("nu"))).cast("int")
    open_ = known.join(tokens, "token").withColumn("mine", mine)
    zero = F.lit(0)
    key = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    # i = -1 - a block of the leader's component, j a block of the others; or i <= j, two blocks of the others.
    own = F.transform(F.sequence(zero, F.col("nu") - 1), lambda t: key(-1 - F.col("mine"), t))
    with_x = F.transform(F.sequence(zero, F.col("nx") - 1), lambda t: key(-1 - t, F.col("mine")))
    with_u = F.transform(F.sequence(zero, F.col("nu") - 1), lambda t: key(F.least(F.col("mine"), t), F.greatest(F.col("mine"), t)))
    places = F.when(small, F.array(key(zero, zero))).when(F.col("led"), own).otherwise(F.concat(with_x, with_u))
    placed = common.publish(open_.withColumn("at", F.explode(places)).select("token", "at.i", "at.j", "h", "comp"), "placed")
    at = ["token", "i", "j"]
    sides = placed.join(active.select("h", "n", "bits"), "h").select(*at, "h", "comp", "n", "bits")
    tried = sides.repartition(n_parts, *at).sortWithinPartitions(*at).mapInArrow(blocked(num, den, False), BLOCK_ROWS)
    tried = common.publish(tried, "tried")
    more = verify(tried.where("u is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    dense = tried.where("u is null").select(*at)
    if not dense.isEmpty():
        inside = common.publish(placed.join(dense, at), "dense")
        sets = fetched_sets(docs, inside.select("h").distinct().join(active, "h").select("h", "rep"), k)
        full = inside.join(active.select("h", "n", "bits"), "h").join(sets, "h").select(*at, "h", "comp", "n", "bits", "s")
        links_ = full.repartition(n_parts, *at).sortWithinPartitions(*at).mapInArrow(blocked(num, den, True), BLOCK_ROWS).select("u", "v")
        more = more.union(common.publish(links_, "links"))

    final = components(stars.union(more))
    named = classes.join(final.select(F.col("node").alias("h"), "comp"), "h").select("h", "rep", "comp")
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component"))
    joined_ = named.join(smallest, "comp").select("h", "component", "comp")
    named = classes.join(joined_, "h", "left").select("h", F.coalesce("component", "rep").alias("component"), F.coalesce("comp", "h").alias("comp"))
    return common.join_hot(profile, common.publish(named, "named"), ["h"], "left").select("doc_id", "n", "h", "component", "comp")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link at a Jaccard similarity of num/den or more."""
    found = classed(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    lost = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.union(lost)


def hashed(k: int, text: int):
    """Adds the set's hash to each row, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, text):
                h = [identity(s) if len(s) else None for s in shingles(*words(batch.column(text)), k)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h, pa.int64())], names=[*batch.schema.names, "_h"])

    return common.releasing(run)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """All columns of one document a component: a row of the smallest doc_id.

    Rows without an id or without words stay. Rows that share an id are documents of their own: each
    goes or stays by its own text, and of those that repeat a set of shingles under an id one stays.
    """
    found = common.publish(classed(docs, k, num, den), "classed")
    count = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    many = common.publish(count.where("n > 1").select("doc_id"), "repeated")
    stay = found.where("h is null or doc_id = component").join(many, "doc_id", "left_anti").select(F.col("doc_id").alias("_id"))
    kept = docs.join(stay, F.col("doc_id").cast("long") == F.col("_id"), "left_semi").unionByName(docs.where("doc_id is null"))
    if many.isEmpty():
        return kept
    some = common.small_batches(docs).join(many.select(F.col("doc_id").alias("_id")), F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    some = some.withColumn("text", F.col("text").cast("string"))
    some = common.publish(some.mapInArrow(hashed(k, some.columns.index("text")), T.StructType([*some.schema.fields, T.StructField("_h", T.LongType())])), "hashed")
    stay = found.where("doc_id = component").join(many, "doc_id").groupBy(F.col("doc_id").alias("_id"), "comp").agg(F.min("h").alias("_h")).select("_id", "_h")
    alone = some.where("_h is not null").withColumn("_id", F.col("doc_id").cast("long")).groupBy("_id", "_h").agg(F.min_by(F.struct(*docs.columns), F.struct(F.crc32(F.col("text").cast("binary")), F.xxhash64(*docs.columns))).alias("_row"))
    alone = alone.join(stay, ["_id", "_h"]).select("_row.*").select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in docs.schema))
    return kept.unionByName(alone).unionByName(some.where("_h is null").select(*docs.columns))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"), k=3, num=90, den=100)
