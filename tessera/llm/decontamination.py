"""Benchmark decontamination (operator 6): greedy string tiling.

Words are compared without case and punctuation. A document and a benchmark item are candidates
if they share a seed: `mml` consecutive words (the whole item if it is shorter). For each
candidate pair greedy string tiling marks the longest match that overlaps no earlier one, again
and again down to `mml` words, of equally long ones the first in the item, then in the document.
Matches are found by running Karp-Rabin: rolling hashes (differences of prefix sums) of all unmarked
windows of a search length, which is halved in on the largest length that still has a match. The
share of an item's words in tiles is its coverage; passages in another order still count.

The benchmark is collected in blocks of at most `block_bytes` (a proven bound on what is sent to
executors and held by the driver), one after another; each block is one scan of the documents.
Documents are never shuffled with a single block; with more, rows are numbered and what the blocks
find meets in one partial aggregation by number.

Defined cases: null or empty texts and items match nothing; a document's item is the one of the
largest coverage, ties to the smaller item_id, null last; items of equal id and text count once;
rows that repeat a doc_id, and rows without one, are rows of their own with any number of blocks; an
empty benchmark leaves all documents clean; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_join import parts
from .words import PUNCTUATION, U, grams, powers, words

MML = 5
THRESHOLD = 0.5
BLOCK_BYTES = 32 << 20
SCHEMA = "doc_id long, contaminated int, item_id long, matched_words long, item_words long, coverage double"
ARROW = pa.schema([("doc_id", pa.int64()), ("contaminated", pa.int32()), ("item_id", pa.int64()), ("matched_words", pa.int64()), ("item_words", pa.int64()), ("coverage", pa.float64())])
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class Windows:
    """A word sequence whose unmarked windows of any length have rolling hashes."""

    def __init__(self, h: np.ndarray):
        self.h, self.free = h, np.ones(len(h), bool)
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(h * powers(FACTOR, len(h) + 1)[: len(h)], dtype=U)))
        self.back = powers(INVERSE, len(h) + 1)

    def of(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and Karp-Rabin hash of each window of s unmarked words."""
        marked = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(marked[s:] == marked[: max(0, len(marked) - s)])
        return at, (self.sums[at + s] - self.sums[at]) * self.back[at]


def tile(item: np.ndarray, doc: np.ndarray, mml: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, words) of greedy string tiling, longest first."""
    i, d = Windows(item), Windows(doc)
    tiles: list[tuple[int, int, int]] = []
    high = min(len(item), len(doc))
    while high >= mml:
        low, s = mml, 0
        while low <= high:  # the largest length with a match
            middle = (low + high) // 2 if s else low
            if np.isin(i.of(middle)[1], d.of(middle)[1]).any():
                s, low = middle, middle + 1
            else:
                high = middle - 1
        if not s:
            break
        places: dict[int, deque[int]] = defaultdict(deque)
        for b, x in zip(*(c.tolist() for c in d.of(s)), strict=True):
            places[x].append(b)
        for a, x in zip(*(c.tolist() for c in i.of(s)), strict=True):
            own = places.get(x)
            while own and i.free[a : a + s].all():
                b = own.popleft()  # marked or taken: of no use to later windows of this length
                if d.free[b : b + s].all() and (item[a : a + s] == doc[b : b + s]).all():
                    i.free[a : a + s] = d.free[b : b + s] = False
                    tiles.append((a, b, s))
        high = s - 1
    return tiles


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, ids: list, texts: list, mml: int):
        h, first = words(pa.array(texts, pa.string()), PUNCTUATION)
        self.ids, self.mml = ids, mml
        self.items = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.seeds: dict[int, dict[int, list[int]]] = {}
        for i, item in enumerate(self.items):
            if n := min(mml, len(item)):
                seeds = self.seeds.setdefault(n, {})
                for x in set(grams(item, n).tolist()):
                    seeds.setdefault(x, []).append(i)
        self.sorted = {n: np.array(sorted(s), dtype=U) for n, s in self.seeds.items()}
        self.maybe = {}
        for n, s in self.sorted.items():
            self.maybe[n] = np.zeros(1 << 20, dtype=bool)
            self.maybe[n][(s >> U(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(place, seed length, seed) of all seeds in a batch's words."""
        out = []
        for n, known in self.sorted.items():
            g = grams(h, n)
            at = np.flatnonzero(self.maybe[n][(g >> U(44)).astype(np.int64)])
            i = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
            at = at[known[i] == g[at]]
            out += [(a, n, x) for a, x in zip(at.tolist(), g[at].tolist(), strict=True)]
        return sorted(out)

    def best(self, h: np.ndarray, hits: list[tuple[int, int, int]]) -> tuple | None:
        """The item of largest coverage: (item_id, words in tiles, words)."""
        around: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a, n, x in hits:
            if a + n <= len(h):
                for i in self.seeds[n][x]:
                    around[i].append((a, a + n))
        best = None
        for i, places in around.items():
            item = self.items[i]
            # Tiles lie where seeds are: other words of the document become one word that matches nothing.
            keep = np.zeros(len(h) + 1, dtype=bool)
            for a, b in places:
                keep[a:b] = True
            keep[1:] |= keep[:-1].copy()
            near = np.flatnonzero(keep[:-1])
            doc = np.where(np.append(keep[:-1], False)[near], h[near], U(0))
            gap = np.concatenate(([False], np.diff(near) > 1))
            doc = np.insert(doc, np.flatnonzero(gap), U(0))
            matched = sum(n for _, _, n in tile(item, doc, min(self.mml, len(item))))
            found = (-matched / len(item), self.ids[i] is None, self.ids[i] or 0, matched, len(item), self.ids[i])
            best = found if best is None else min(best, found, key=lambda x: x[:5])
        return best and (best[5], best[3], best[4])


def scanned(index: Index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, texts in parts(batch, drop_null=False):
                h, first = words(texts, PUNCTUATION)
                n = len(docs)
                found: list[tuple | None] = [None] * n
                by_row: dict[int, list] = defaultdict(list)
                hits = index.hits(h)
                rows = np.searchsorted(first, [a for a, _, _ in hits], "right") - 1
                for r, (a, length, x) in zip(rows.tolist(), hits, strict=True):
                    by_row[r].append((a - int(first[r]), length, x))
                for r, own in by_row.items():
                    found[r] = index.best(h[first[r] : first[r + 1]], own)
                cols = [[f and f[i] for f in found] for i in range(3)]
                share = [f[1] / f[2] if f else 0.0 for f in found]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array([int(s >= threshold) for s in share], pa.int32()), *(pa.array(c, pa.int64()) for c in (cols[0], [x or 0 for x in cols[1]], cols[2])), pa.array(share, pa.float64())], schema=ARROW
                )

    return common.releasing(run)


def indexes(benchmark: DataFrame, mml: int, block_bytes: int) -> Iterator[tuple[Index, int]]:
    """The benchmark in blocks of about half of `block_bytes` (one block if it is no larger), with their number."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-2 * size // block_bytes) if size > block_bytes else 1
    for b in range(blocks):
        rows = (items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b) if blocks > 1 else items).collect()
        yield Index([r["item_id"] for r in rows], [r["text"] for r in rows], mml), blocks


def tiled(docs: DataFrame, benchmark: DataFrame, mml: int = MML, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row a document: contaminated (0 or 1) and its best item with the words in tiles, the item's words and the coverage."""
    docs = common.documents(docs)
    numbered, found = None, []
    for index, blocks in indexes(benchmark, mml, block_bytes):
        if blocks == 1:
            return docs.mapInArrow(scanned(index, threshold), SCHEMA)
        if numbered is None:
            numbered = common.publish(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        some = numbered.select(F.col("row").alias("doc_id"), "text").mapInArrow(scanned(index, threshold), SCHEMA)
        found.append(common.publish(some.where("item_words is not null"), "tiles"))
    names = ["contaminated", "item_id", "matched_words", "item_words", "coverage"]
    order = F.struct("coverage", F.col("item_id").isNotNull(), -F.col("item_id"), *(F.col(c).alias(f"_{c}") for c in names))
    best = reduce(DataFrame.union, found).groupBy(F.col("doc_id").alias("row")).agg(F.max(order).alias("b")).select("row", *(F.col(f"b._{c}").alias(c) for c in names))
    nothing = {"contaminated": 0, "matched_words": 0, "coverage": 0.0}
    return numbered.select("row", "doc_id").join(best, "row", "left").fillna(nothing).select("doc_id", *names)


def filtered(index: Index, threshold: float, doc: int, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanned(index, threshold)
        for batch in batches:
            narrow = pa.RecordBatch.from_arrays([batch.column(doc), batch.column(text)], names=["doc_id", "text"])
            bad = [x for b in scan(iter([narrow])) for x in b.column(1).to_pylist()]
            yield batch.filter(pa.array([not x for x in bad], pa.bool_()))

    return common.releasing(run)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, mml: int = MML, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of the documents that cover no item's words to the threshold; a filter for each block, no shuffle."""
    out = common.small_batches(docs)
    for index, blocks in indexes(benchmark, mml, block_bytes):
        out = out.mapInArrow(filtered(index, threshold, docs.columns.index("doc_id"), docs.columns.index("text")), docs.schema)
        out = out if blocks == 1 else common.publish(out, "kept")
    return out


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
