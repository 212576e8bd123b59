"""Token counts (operator 4): a linear longest-match automaton.

The vocabulary's pieces (bytes, with one mark after a word's last byte) form a trie. Every node
has a failure link and the count of pieces that are final ("popped") when matching falls back
along it, both precomputed, so a word's number of greedy longest-match pieces comes from one pass
over its bytes, without backtracking and without building a piece. Words are maximal runs without
white space, A-Z folded; every byte is a piece, so each word has a count.

Distinct words run through the automaton in lockstep, a NumPy step a byte; counts are kept by word
hash in each Python worker. One scan, no shuffle; the automaton (a few MB, bounded by the
vocabulary) is built on the driver and sent along.

Defined cases: null or empty texts and texts of white space have 0 tokens; texts of any length are
counted whole; repeated rows count alike; a null doc_id stays null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_join import parts
from .words import LOWER, SPACE, Memo, buffers, hashes, spans

VOCABULARY = "word_bpe_49k.json"
MARK = 256  # the symbol after a word's last byte
KEPT = 1_000_000


def pieces(vocabulary: str = VOCABULARY) -> list[tuple[int, ...]]:
    """The vocabulary as symbol sequences; its strings spell bytes as printable characters."""
    import json

    import public_tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    with open(path) as f:
        vocab = json.load(f)["model"]["vocab"]
    return [tuple(shown[c] for c in t.removesuffix("</w>")) + (MARK,) * t.endswith("</w>") for t in vocab if all(c in shown for c in t)]


class Automaton:
    """Trie nodes with a failure link and popped-piece counts; node 0 is the root."""

    def __init__(self, vocabulary: list[tuple[int, ...]]):
        child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for c in piece:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    final.append(False)
                node = child[node][c]
            final[node] = True
        for c in range(MARK + 1):  # every symbol is a piece, so that matching never fails
            if c not in child[0]:
                child[0][c] = len(child)
                child.append({})
                final.append(False)
            final[child[0][c]] = True
        self.fail, self.popped = np.zeros(len(child), np.int32), np.zeros(len(child), np.int32)
        queue = [0]
        for u in queue:
            for c, v in child[u].items():
                queue.append(v)
                if final[v]:
                    self.popped[v] = 1  # falls back to the root with one piece more
                    continue
                z, n = int(self.fail[u]), int(self.popped[u])
                while c not in child[z]:
                    z, n = int(self.fail[z]), n + int(self.popped[z])
                self.fail[v], self.popped[v] = child[z][c], n
        keys = np.array([u * 512 + c for u, kids in enumerate(child) for c in kids], np.int64)
        values = np.array([v for kids in child for v in kids.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def step(self, state: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> None:
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo].astype(np.int64) * 512 + symbol[todo]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            state[todo[hit]] = self.values[i[hit]]
            todo = todo[~hit]
            count[todo] += self.popped[state[todo]]
            state[todo] = self.fail[state[todo]]

    def counts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of pieces of each word raw[start:end]."""
        out = np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first: the words still running are a prefix
        s, n = starts[order], (ends - starts)[order]
        state, count = np.zeros(len(s), np.int32), np.zeros(len(s), np.int64)
        for i in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -i, "left"))
            self.step(state[:live], LOWER[raw[s[:live] + i]].astype(np.int64), count[:live])
        self.step(state, np.full(len(s), MARK, np.int64), count)
        while (left := np.flatnonzero(state)).size:
            count[left] += self.popped[state[left]]
            state[left] = self.fail[state[left]]
        out[order] = count
        return out


def counted(automaton: Automaton):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(KEPT)
        for batch in batches:
            for docs, texts in parts(batch, drop_null=False):
                raw, off = buffers(texts)
                starts, ends, first = spans(raw, off, SPACE)
                n = memo.get(hashes(raw, starts, ends), lambda new, raw=raw, starts=starts, ends=ends: automaton.counts(raw, starts[new], ends[new]))
                total = np.concatenate(([0], np.cumsum(n)))[first]
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.diff(first), pa.int64()), pa.array(np.diff(total), pa.int64())], schema=schema)

    return common.releasing(run)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row."""
    docs = common.documents(docs)
    return docs.mapInArrow(counted(Automaton(pieces(vocabulary))), "doc_id long, n_words long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
