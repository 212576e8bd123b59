"""Exact top-k search (operator 5): M-tree best-first search for the largest inner products.

Components become floor(1024 * x). The largest inner product is a nearest-neighbour query once
every vector gets one more coordinate that lifts it to the table's largest norm R: then
|q - v|^2 = |q|^2 + R^2 - 2 q.v, a metric, so an M-tree applies.

Each partition bulk-loads an M-tree over its vectors: pages of at most PAGE entries, a routing
vector, a covering radius and the distance to the parent a node. Queries descend in lockstep. A
node's routing distance is computed only if |d(q, parent) - d(node, parent)| - radius does not rule
it out already; pages are then visited best first, each query in the order of its own bounds, until
no page can hold a better entry, and entries whose stored distance to the page's routing vector
rules them out are skipped. Scores are exact integers; bounds are floats with a margin above the
rounding of norms. A partition returns its k best of each query, and the k best of those are merged.

Queries go to executors in blocks of at most `block_bytes`, a stated query set against all rows, one
block after another: the driver holds one at a time.

Defined cases: vectors that are null, empty or of another length than `dims` (by default the most
frequent length), or that hold null or non-finite components take no part, nor do rows without an
id; repeated ids are candidates of their own, of equal query ids the smallest vector asks, and a
query's id is never its candidate; ties go to
the smaller vec_id; fewer candidates than k give fewer rows; an empty table gives no rows.
Components may be of any size: where a sum may leave the exact range of a double, scores are summed
as integers of any length; components end at 2^62 and scores at the limits of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE = 1024
PAGE = 64
FAN = 16
BLOCK_BYTES = 16 << 20
TREE_BYTES = 64 << 20
TOGETHER = 1024  # queries that search a tree in lockstep
MARGIN = 1e-6  # of the norms
MOST, LONG = 1 << 62, (1 << 63) - 1


def integers(table: DataFrame, dims: int | None) -> tuple[DataFrame, int]:
    """(vec_id, v array<long>) of the vectors that take part, and their length."""
    vec = F.col("embedding").cast("array<double>")
    rows = table.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("v"))
    rows = rows.where("size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    if dims is None:
        sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        dims = sizes["d"] if sizes else 1
    return rows.where(F.size("v") == dims).select("vec_id", F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long")).alias("v")), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)


class MTree:
    """Bulk-loaded over rows x (already lifted): leaf pages of rows, and levels of nodes above them."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = self.split(np.arange(len(x)))
        self.pages = [order[i : i + PAGE] for i in range(0, len(order), PAGE)]
        self.routing = np.array([x[p].mean(axis=0) for p in self.pages])
        self.stored = [np.sqrt(((x[p] - r) ** 2).sum(axis=1)) for p, r in zip(self.pages, self.routing, strict=True)]
        radius = np.array([d.max() for d in self.stored])
        self.levels = [(self.routing, radius, None)]  # routing vector, covering radius, distance to the parent
        while len(self.levels[-1][0]) > FAN:
            centres, radii, _ = self.levels[-1]
            at = np.arange(0, len(centres), FAN)
            sizes = np.diff(np.append(at, len(centres)))
            parents = np.add.reduceat(centres, at, axis=0) / sizes[:, None]
            apart = np.sqrt(((centres - np.repeat(parents, sizes, axis=0)) ** 2).sum(axis=1))
            self.levels[-1] = (centres, radii, apart)
            self.levels.append((parents, np.maximum.reduceat(apart + radii, at), None))

    def split(self, rows: np.ndarray) -> np.ndarray:
        """An order in which neighbours are close: halves along the line between two far rows."""
        if len(rows) <= PAGE:
            return rows
        x = self.x[rows]
        a = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        b = x[((x - a) ** 2).sum(axis=1).argmax()]
        side = np.argsort(x @ (b - a), kind="stable")
        half = -(-len(rows) // (2 * PAGE)) * PAGE
        return np.concatenate((self.split(rows[side[:half]]), self.split(rows[side[half:]])))

    def dive(self, q: np.ndarray, low: np.ndarray) -> np.ndarray:
        """For each query the page at the end of the path of smallest bounds."""
        node = low.argmin(axis=1)
        for centres, radii, _ in reversed(self.levels[:-1]):
            kids = np.minimum(node[:, None] * FAN + np.arange(FAN), len(centres) - 1)
            d = np.sqrt(((q[:, None, :] - centres[kids]) ** 2).sum(axis=2)) - radii[kids]
            node = np.take_along_axis(kids, d.argmin(axis=1)[:, None], 1)[:, 0]
        return node

    def search(self, q: np.ndarray, score, worst: np.ndarray, margin: float) -> None:
        """Calls score(queries, rows) for all entries that can be among the nearest; score keeps worst[i], query i's k-th distance so far."""
        centres, radii, _ = self.levels[-1]
        d = np.sqrt(((q[:, None, :] - centres) ** 2).sum(axis=2))
        low = np.maximum(0, d - radii)
        first = self.dive(q, low)
        for p in np.unique(first).tolist():
            score(np.flatnonzero(first == p), self.pages[p])
        for centres, radii, apart in reversed(self.levels[:-1]):
            parent = np.arange(len(centres)) // FAN
            # Stored distances first: only where they leave a node open is its own distance computed.
            cheap = np.maximum(low[:, parent], np.abs(d[:, parent] - apart) - radii)
            open_ = cheap <= worst[:, None] + margin
            low, d = np.full(cheap.shape, np.inf), np.full(cheap.shape, np.inf)
            for j in np.flatnonzero(open_.any(axis=0)).tolist():
                i = np.flatnonzero(open_[:, j])
                d[i, j] = np.sqrt(((q[i] - centres[j]) ** 2).sum(axis=1))
                low[i, j] = np.maximum(cheap[i, j], d[i, j] - radii[j])
        low[np.arange(len(q)), first] = np.inf
        best = np.argsort(low, axis=1, kind="stable")
        live = np.arange(len(q))
        for turn in range(low.shape[1]):
            page = best[live, turn]
            keep = (low[live, page] <= worst[live] + margin) & np.isfinite(low[live, page])
            live, page = live[keep], page[keep]
            if not len(live):
                return
            for p in np.unique(page).tolist():
                i = live[page == p]
                wanted = (np.abs(d[i, p][:, None] - self.stored[p]) <= worst[i][:, None] + margin).any(axis=0)
                if wanted.any():
                    score(i, self.pages[p][wanted])


def searched(q_ids: np.ndarray, q: np.ndarray, dims: int, k: int, largest: float, wide: bool):
    """The k best of a partition for each query; `wide`: sums may leave the exact range of a double."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    none = np.iinfo(np.int64).min if wide else -np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), dims)) for b in batches if b.num_rows]
        if not got or not len(q):
            return
        ids, v = np.concatenate([i for i, _ in got]), np.concatenate([x for _, x in got])
        real = v.astype(float)
        exact = v.astype(object) if wide else real
        tree = MTree(np.column_stack((real, np.sqrt(np.maximum(0, largest - (real**2).sum(axis=1))))))
        for a in range(0, len(q), TOGETHER):
            part, part_ids = q[a : a + TOGETHER].astype(float), q_ids[a : a + TOGETHER]
            asked = q[a : a + TOGETHER].astype(object) if wide else part
            norms = (part**2).sum(axis=1)
            square = norms + largest
            best_score = np.full((len(part), k), none)
            best_id = np.full((len(part), k), np.iinfo(np.int64).max)
            worst = np.full(len(part), np.inf)

            def score(i: np.ndarray, rows: np.ndarray, asked=asked, part_ids=part_ids, square=square, best_score=best_score, best_id=best_id, worst=worst) -> None:
                s = asked[i] @ exact[rows].T
                if wide:
                    s = np.clip(s, -LONG, LONG).astype(np.int64)
                s[part_ids[i][:, None] == ids[rows]] = none
                s = np.concatenate((best_score[i], s), axis=1)
                n = np.concatenate((best_id[i], np.broadcast_to(ids[rows], (len(i), len(rows)))), axis=1)
                order = np.lexsort((n, ~s if wide else -s), axis=1)[:, :k]
                best_score[i], best_id[i] = np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)
                last = best_score[i, k - 1]
                full = last > none
                worst[i] = np.where(full & (last.astype(float) > -LONG), np.sqrt(np.maximum(0, square[i] - 2 * np.where(full, last, 0).astype(float))), np.inf)

            tree.search(np.column_stack((part, np.zeros(len(part)))), score, worst, MARGIN * (np.sqrt(largest) + np.sqrt(norms.max()) + 1))
            i, j = np.nonzero(best_score > none)
            yield pa.RecordBatch.from_arrays([pa.array(part_ids[i]), pa.array(best_id[i, j]), pa.array(best_score[i, j].astype(np.int64))], schema=schema)

    return common.releasing(run)


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, dims: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k largest inner products over the table, without its own id."""
    spark = table.sparkSession
    rows, dims = integers(table, dims)
    rows = common.publish(rows, "vectors")
    asked = integers(queries, dims)[0].groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = common.publish(asked, "queries")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = lambda t: t.agg(F.max(norm).alias("m"), F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most")).first()
    stats, of = size(rows), size(asked)
    largest, wide = float(stats["m"] or 0), float(stats["most"] or 0) * float(of["most"] or 0) * dims >= 2**53
    blocks = max(1, -(-of["n"] * dims * 8 // block_bytes))
    # A partition per about TREE_BYTES of vectors at least, so that its tree fits a task.
    n = max(common.partitions(spark), -(-stats["n"] * dims * 8 // TREE_BYTES))
    dealt = common.publish(rows.repartition(n), "dealt") if blocks > 1 else rows.repartition(n)
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b)
        got = part.toArrow()  # about block_bytes
        ids, q = got.column(0).to_numpy(), matrix(got.column(1), dims) if len(got) else np.zeros((0, dims), np.int64)
        one = dealt.mapInArrow(searched(ids, q, dims, k, largest, wide), "query_id long, vec_id long, score long")
        one = one if blocks == 1 else common.publish(one, "found")
        out = one if out is None else out.union(one)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = common.table(spark, sf_dir, "embeddings")
    return top_k(table, table.where("vec_id % 100 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
