"""Toxicity (operator 10): nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample (`examples` rows, by hash of the id) of labelled documents whose
crc32(doc_id as text) mod 3 is not 1. Terms are all words of the sample; their document
frequencies are counted over all documents. A term weighs TF-IDF times one plus its evidence (how
well its presence tells the labels apart in the sample, as a likelihood ratio); no word is left
out. Each document's nearest examples come exactly from a block-max inverted index: examples lie in
blocks of similar ones; postings give the rarer terms' part of every cosine; of frequent terms a
block keeps its largest weights, which bound what they can add in the block, and their weights
themselves are read only in blocks that the bound does not rule out for a k-th neighbour. Votes are
weighted by distance; a logistic curve fitted to leave-one-out votes calibrates the score. The
nearest example is given as evidence.

One task makes the index of the published examples; only its bytes pass through the driver, on their
way to a broadcast. Everything sent to executors is bounded by `examples` documents and `most_words` distinct words in
them altogether; the sample is taken in the order of a hash of the id. Words are compared
without case and punctuation; whole texts are read. labels, lang, source and doc_id are no input.

Defined cases: null or empty texts and texts without known terms score the calibrated rate of
the examples; null labels, labels other than 0 and 1 and null ids teach nothing; without usable
labels every score is 0.5 and predicted is 0; copies of an example count once a label, so that copies
with different labels teach both; repeated rows score alike; ties between neighbours
go to the smaller example; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_join import parts
from .words import PUNCTUATION, Memo, U, words

EXAMPLES = 8000
WORDS = 8 << 20  # distinct words of the examples, summed
NEIGHBOURS = 25
THRESHOLD = 0.7
FREQUENT = 256  # terms of many examples, held as a table
BLOCK = 32  # examples of a block
PROJECTED = 32  # dimensions of the space in which examples are dealt to blocks
LEAD = 10  # blocks that give a first k-th cosine
TOGETHER = 64  # documents searched at a time
POSTINGS = 1 << 20  # postings read at a time
KEPT = 200_000  # scores of texts that a task remembers
PACKED = 1024  # document frequencies in a row
PIECE = 1 << 20  # bytes of the index in a row


@common.releasing
def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) -> (doc_id, toxic, sorted distinct word hashes, their counts)."""
    for batch in batches:
        h, first = words(batch.column(2), PUNCTUATION)
        found = [np.unique(h[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(0),
                "toxic": batch.column(1),
                "words": pa.array([w.tobytes() for w, _ in found], pa.binary()),
                "counts": pa.array([zlib.compress(n.astype(np.int32).tobytes(), 1) for _, n in found], pa.binary()),
            }
        )


def likelihood_ratio(a: np.ndarray, b: np.ndarray, p: int, n: int) -> np.ndarray:
    """G squared of presence (a of p positives, b of n negatives) against the label."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    share = (a + b) / (p + n)
    return 2 * (part(a, p * share) + part(b, n * share) + part(p - a, p * (1 - share)) + part(n - b, n * (1 - share)))


class Lookup:
    """Places of word hashes in a table of terms."""

    def __init__(self, terms: np.ndarray):
        self.terms = Memo(len(terms))
        self.terms.put(terms, np.arange(len(terms)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into h that are terms, and which."""
        place = self.terms.find(h)
        at = np.flatnonzero(place >= 0)
        return at, place[at].astype(np.int64)


def clustered(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """An order of the rows in which those of a block are close: halves along the line between two far ones."""
    if len(rows) <= BLOCK:
        return rows
    y = x[rows]
    a = y[((y - y.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    b = y[((y - a) ** 2).sum(axis=1).argmax()]
    side = np.argsort(y @ (b - a), kind="stable")
    half = -(-len(rows) // (2 * BLOCK)) * BLOCK
    return np.concatenate((clustered(x, rows[side[:half]]), clustered(x, rows[side[half:]])))


class Index:
    """Labelled examples as a block-max inverted index; places are examples in the order of the blocks.

    Examples' weights are rounded to single precision; all sums are in double precision.
    """

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: list[int], labels: np.ndarray, vectors: list[tuple], k: int):
        self.terms, self.idf, self.k = terms, idf, k
        self.n = n = len(ids)
        self.vectors = [(t, w.astype(np.float32)) for t, w in (self.weigh(t, c) for t, c in vectors)]
        term = np.concatenate([t for t, _ in self.vectors]) if n else np.zeros(0, np.int32)
        example = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in self.vectors])
        weight = np.concatenate([w for _, w in self.vectors]) if n else np.zeros(0, np.float32)
        often = np.argsort(-np.bincount(term, minlength=len(terms)), kind="stable")[:FREQUENT]
        self.column = np.full(len(terms), -1, np.int32)
        self.column[often] = np.arange(len(often))
        column = self.column[term]
        table = np.zeros((n, len(often)), np.float32)
        table[example[column >= 0], column[column >= 0]] = weight[column >= 0]
        few = table @ np.random.default_rng(0).standard_normal((len(often), PROJECTED))
        self.age = clustered(few, np.arange(n))  # the example at each place
        place = np.argsort(self.age)
        self.ids, self.labels = [ids[e] for e in self.age], labels[self.age]
        self.vectors = [self.vectors[e] for e in self.age]
        blocks = -(-n // BLOCK)
        padded = np.zeros((blocks * BLOCK, len(often)), np.float32)
        padded[:n] = table[self.age]
        self.table = padded.reshape(blocks, BLOCK, len(often))
        self.largest = self.table.max(axis=1, initial=0).astype(float)
        term, example, weight = (x[column < 0] for x in (term, example, weight))
        order = np.argsort(term, kind="stable")
        block, inside = np.divmod(place[example[order]], BLOCK)
        self.spot, self.weight = (block * TOGETHER * BLOCK + inside).astype(np.int32), weight[order]  # where its first document's score lies
        self.starts = np.searchsorted(term[order], np.arange(len(terms) + 1)).astype(np.int32)
        self.slope, self.shift = 1.0, 0.0
        self.rest = 0.5  # vote of documents without a neighbour

    def weigh(self, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[t]
        norm = math.sqrt(float((w * w).sum()))
        return t, w / norm if norm else w

    def portions(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
        """Bounds of portions of the rows: TOGETHER at most, with about POSTINGS postings."""
        sizes = np.cumsum([0, *(int((self.starts[t + 1] - self.starts[t]).sum()) for t, _ in rows)])
        i = 0
        while i < len(rows):
            j = min(i + TOGETHER, max(i + 1, int(np.searchsorted(sizes, sizes[i] + POSTINGS, "right")) - 1), len(rows))
            yield i, j
            i = j

    def add(self, score: np.ndarray, c: np.ndarray, asked: np.ndarray) -> None:
        """Adds the frequent terms' part in the (block, document) places asked for."""
        for b in np.flatnonzero(asked.any(axis=1)).tolist():
            i = np.flatnonzero(asked[b])
            score[b, i] += c[i] @ self.table[b].T.astype(float)

    def nearest(self, asked: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each (terms, weights), TOGETHER at most, the k (cosine, place) of largest cosine above 0, exactly; ties to the smaller example."""
        m, blocks = len(asked), len(self.table)
        if not blocks or not m:
            return [[] for _ in asked]
        t, w = (np.concatenate([q[i] for q in asked]) for i in (0, 1))
        row = np.repeat(np.arange(m), [len(q[0]) for q in asked])
        column = self.column[t]
        c = np.zeros((m, self.table.shape[2]))
        c[row[column >= 0], column[column >= 0]] = w[column >= 0]
        t, w, row = (x[column < 0] for x in (t, w, row))
        start = self.starts[t]
        size = self.starts[t + 1] - start
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.spot[at] + np.repeat(row * BLOCK, size), weights=np.repeat(w, size) * self.weight[at], minlength=blocks * TOGETHER * BLOCK)
        score = score.astype(float, copy=False).reshape(blocks, TOGETHER, BLOCK)[:, :m]
        if skip is not None:
            score[np.array(skip) // BLOCK, np.arange(m), np.array(skip) % BLOCK] = -np.inf
        most = score.max(axis=2) + self.largest @ c.T + 1e-9
        lead = np.argpartition(most, -min(blocks, LEAD), axis=0)[-min(blocks, LEAD) :]
        done = np.zeros(most.shape, dtype=bool)
        done[lead, np.arange(m)] = True
        self.add(score, c, done)
        # The k-th cosine in the leading blocks: no smaller one can be among the nearest.
        sure = score[lead, np.arange(m)].transpose(1, 0, 2).reshape(m, -1)
        low = np.partition(sure, -self.k, axis=1)[:, -self.k] if sure.shape[1] >= self.k else np.full(m, -np.inf)
        rest = (most >= low) & ~done
        self.add(score, c, rest)
        done |= rest
        out = []
        for i in range(m):
            own = np.flatnonzero(done[:, i])
            cosine = np.round(score[own, i].ravel(), 12)
            least = max(np.partition(cosine, -self.k)[-self.k] if len(cosine) >= self.k else 0.0, 1e-12)
            found = np.flatnonzero(cosine >= least)
            place = own[found // BLOCK] * BLOCK + found % BLOCK
            order = np.lexsort((self.age[place], -cosine[found]))[: self.k]
            out.append(list(zip(cosine[found][order].tolist(), place[order].tolist(), strict=True)))
        return out

    def vote(self, found: list[tuple[float, int]]) -> float:
        if not found:
            return self.rest
        weights = [1 / (1.05 - min(1.0, c)) for c, _ in found]
        base = 2.0  # two votes of the rest steady a few far neighbours
        return (sum(w * self.labels[e] for w, (_, e) in zip(weights, found, strict=True)) + base * self.rest) / (sum(weights) + base)

    def calibrate(self) -> None:
        """Takes the examples' rate for the rest, then fits a logistic curve to their leave-one-out votes."""
        self.rest = (float(self.labels.sum()) + 1) / (self.n + 2)
        votes = []
        for i, j in self.portions(self.vectors):
            votes += [self.vote(f) for f in self.nearest(self.vectors[i:j], list(range(i, j)))]
        x = np.array([math.log(v / (1 - v)) for v in np.clip(votes, 1e-3, 1 - 1e-3)])
        y = self.labels
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton's method with a weak pull towards the identity
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + b])
            q = p * (1 - p)
            hess = np.array([[(q * x * x).sum() + 1, (q * x).sum()], [(q * x).sum(), q.sum() + 1]])
            step = np.linalg.solve(hess, g)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.slope, self.shift = max(1e-3, float(a)), float(b)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, int | None]]:
        """(score, nearest example's id) of each row's (terms, counts)."""
        out = []
        for i, j in self.portions(rows):
            for found in self.nearest([self.weigh(*r) for r in rows[i:j]]):
                v = min(1 - 1e-3, max(1e-3, self.vote(found)))
                out.append((1 / (1 + math.exp(-(self.slope * math.log(v / (1 - v)) + self.shift))), self.ids[found[0][1]] if found else None))
        return out


def counted(terms: np.ndarray):
    """Partial document frequencies of each task: rows of PACKED terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, df, n = Lookup(terms), np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for docs, texts in parts(batch, drop_null=False):
                h, first = words(texts, PUNCTUATION)
                at, term = look.find(h)
                row = np.searchsorted(first, at, "right") - 1
                some, rows = np.unique(np.unique(row * len(terms) + term) % max(1, len(terms)), return_counts=True)
                df[some] += rows
                n += len(docs)
        for i in range(0, len(terms), 256 * PACKED):
            at = range(i, min(i + 256 * PACKED, len(terms)), PACKED)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "df": pa.array([df[j : j + PACKED].astype(np.int32).tobytes() for j in at], pa.binary()), "n": pa.array([n if j == 0 else 0 for j in at], pa.int64())})

    return common.releasing(run)


@common.releasing
def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the partial document frequencies by place."""
    df: dict[int, np.ndarray] = {}
    n: dict[int, int] = {}
    for batch in batches:
        for at, some, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            df[at] = df.get(at, 0) + np.frombuffer(some, np.int32).astype(np.int64)
            n[at] = n.get(at, 0) + rows
    yield pa.RecordBatch.from_pydict({"at": pa.array(df, pa.int32()), "df": pa.array([d.tobytes() for d in df.values()], pa.binary()), "n": pa.array(n.values(), pa.int64())})


def scored(model: Index | Broadcast, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("nearest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value if isinstance(model, Broadcast) else model
        look, width = Lookup(index.terms), max(1, len(index.terms))
        seen: dict[bytes, tuple[float, int | None]] = {}
        for batch in batches:
            for docs, texts in parts(batch, drop_null=False):
                h, first = words(texts, PUNCTUATION)
                at, term = look.find(h)
                row = np.searchsorted(first, at, "right") - 1
                both, counts = np.unique(row * width + term, return_counts=True)
                term, edges = both % width, np.searchsorted(both // width, np.arange(len(docs) + 1))
                rows = [(term[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                keys = [blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest() for t, c in rows]
                new = {k: r for k, r in zip(keys, rows, strict=True) if k not in seen}
                if len(seen) > KEPT:
                    seen, new = {}, dict(zip(keys, rows, strict=True))
                seen |= zip(new, index.scores(list(new.values())), strict=True)
                scores = [seen[k] for k in keys]
                s = [x for x, _ in scores]
                yield pa.RecordBatch.from_arrays([docs, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array([e for _, e in scores], pa.int64())], schema=schema)

    return common.releasing(run)


class Pickled:
    """Bytes that unpickle as what they hold."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def __reduce__(self) -> tuple:
        return pickle.loads, (self.raw,)


def examples_of(batches: Iterator[pa.RecordBatch], most_words: int) -> list[tuple]:
    """(doc_id, toxic, words, counts) of the examples, in the order of their ids, while they hold most_words at most."""
    all_rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    rows, held = [], 0
    for _, doc, toxic, w, c in sorted(all_rows, key=lambda r: r[:3]):
        held += len(w) // 8
        if held > most_words:
            break
        rows.append((doc, toxic, np.frombuffer(w, dtype=U), np.frombuffer(zlib.decompress(c), dtype=np.int32)))
    return sorted(rows, key=lambda r: (r[0], r[1], r[2].tobytes()))


def evidence_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The examples' distinct words and each one's evidence; none where a label is missing."""
    p = sum(r[1] for r in rows)
    n = len(rows) - p
    if not p or not n:
        return np.zeros(0, U), np.zeros(0)
    vocab, both = np.unique(np.concatenate([r[2] for r in rows]), return_counts=True)
    pos, a = np.unique(np.concatenate([r[2] for r in rows if r[1]]), return_counts=True)
    of = np.zeros(len(vocab))
    of[np.searchsorted(vocab, pos)] = a
    return vocab, likelihood_ratio(of, both - of, p, n)


def in_pieces(raw: bytes) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(raw), PIECE):
        yield pa.RecordBatch.from_pydict({"piece": pa.array([raw[i : i + PIECE]], pa.binary())})


def vocabulary(most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_pieces(evidence_of(examples_of(batches, most_words))[0].tobytes())

    return common.releasing(run)


def built(vocab: np.ndarray, df: np.ndarray, total: int, k: int, most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = examples_of(batches, most_words)
        weight = (np.log((1 + total) / (1 + df)) + 1) * (1 + evidence_of(rows)[1])
        # Where there is no vocabulary, nothing is learnt and no example keeps a word.
        vectors = [(np.searchsorted(vocab, w).astype(np.int32), c) if len(vocab) else (np.zeros(0, np.int32), c[:0]) for _, _, w, c in rows]
        ids, labels = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)
        del rows
        index = Index(vocab, weight, ids, labels, vectors, k)
        if len(vocab):
            index.calibrate()
        index.vectors = []
        yield from in_pieces(pickle.dumps(index, protocol=5))

    return common.releasing(run)


def gathered(rows: DataFrame, run) -> bytes:
    """What one task makes of the examples, as bytes."""
    pieces = [bytes(r["piece"]) for r in rows.coalesce(1).mapInArrow(run, "piece binary").toLocalIterator()]
    return b"".join(pieces or [p for batch in run(iter([])) for p in batch.column(0).to_pylist()])  # no task where there is no example


def fitted(docs: DataFrame, labels: DataFrame, examples: int, k: int, most_words: int = WORDS) -> bytes:
    """The pickled index, made in a task. docs(doc_id, text), labels(doc_id, toxic); only rows whose crc32(doc_id as text) mod 3 is not 1 teach."""
    teach = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    teach = teach.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    chosen = teach.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(examples)
    sample = docs.join(F.broadcast(chosen), "doc_id").where("text is not null").select("doc_id", "toxic", "text")  # broadcast: `examples` rows of two numbers
    found = sample.mapInArrow(presence, "doc_id long, toxic int, words binary, counts binary")
    found = found.groupBy("toxic", "words", "counts").agg(F.min("doc_id").alias("doc_id"))  # copies of an example would count twice
    found = found.withColumn("h", F.xxhash64("doc_id")).select("h", "doc_id", "toxic", "words", "counts")
    rows = common.publish(found.orderBy("h", "doc_id", "toxic").limit(examples), "examples")
    vocab = np.frombuffer(gathered(rows, vocabulary(most_words)), U)
    df, total = np.zeros(len(vocab), np.int64), 0
    schema = "at int, df binary, n long"
    if len(vocab):
        counts = docs.mapInArrow(counted(vocab), schema)
        for r in counts.repartition(common.partitions(docs.sparkSession), "at").mapInArrow(added, schema).collect():  # 8 bytes a term
            df[r["at"] : r["at"] + PACKED] = np.frombuffer(r["df"], np.int64)
            total += r["n"]
    raw = gathered(rows, built(vocab, df, total, k, most_words))
    common.give_back()
    return raw


def fit(docs: DataFrame, labels: DataFrame, examples: int, k: int, most_words: int = WORDS) -> Index:
    return pickle.loads(fitted(docs, labels, examples, k, most_words))


def sent(spark: SparkSession, raw: bytes) -> Broadcast:
    """The index for executors; the driver keeps neither it nor its bytes."""
    return spark.sparkContext.broadcast(Pickled(raw))


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """A row a document: doc_id, held_out, score, predicted and the nearest example's id (null: none)."""
    docs = common.documents(docs)
    model = sent(docs.sparkSession, fitted(docs, labels, examples, k))
    out = docs.mapInArrow(scored(model, threshold), "doc_id long, score double, predicted int, nearest long")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "nearest")


def filtered(model: Index | Broadcast, threshold: float, doc: int, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scored(model, threshold)
        for batch in batches:
            narrow = pa.RecordBatch.from_arrays([batch.column(doc), batch.column(text)], names=["doc_id", "text"])
            toxic = [x for b in score(iter([narrow])) for x in b.column(2).to_pylist()]
            yield batch.filter(pa.array([not x for x in toxic], pa.bool_()))

    return common.releasing(run)


def without_toxic(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents that the operator does not reject; one scan after fitting, no shuffle of texts."""
    model = sent(docs.sparkSession, fitted(common.documents(docs), labels, examples, k))
    return docs.mapInArrow(filtered(model, threshold, docs.columns.index("doc_id"), docs.columns.index("text")), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
