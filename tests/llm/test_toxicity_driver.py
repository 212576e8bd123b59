"""The toxicity index is made in a task: the driver holds no example, no posting and no index."""

import zlib

import pytest

from tessera.llm import toxicity as T


def tables(spark, n=60):
    docs = [(i, ("vile awful insult " if i % 2 else "kind gentle praise ") + f"word{i} common") for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")


def test_the_driver_makes_no_index(spark, monkeypatch):
    docs, labels = tables(spark)
    index = T.fit(docs, labels, 8000, 25)
    want = dict(zip(range(60), (s for s, _ in index.scores(rows_of(docs, index))), strict=True))

    def refuse(*args):
        raise AssertionError("an index in the driver")

    monkeypatch.setattr(T.Index, "__init__", refuse)
    got = {r["doc_id"]: r["score"] for r in T.toxicity(docs, labels).collect()}
    assert got == pytest.approx(want)
    assert T.without_toxic(docs, labels).count() == sum(x < T.THRESHOLD for x in want.values())


def rows_of(docs, index):
    import numpy as np
    import pyarrow as pa

    from tessera.llm.words import PUNCTUATION, words

    h, first = words(pa.array([r["text"] for r in docs.orderBy("doc_id").collect()]), PUNCTUATION)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        _, term = T.Lookup(index.terms).find(h[a:b])
        out.append(np.unique(term, return_counts=True))
    return out


def test_words_of_examples_are_bounded_in_the_order_of_the_hash(spark):
    docs, labels = tables(spark)
    whole, half = T.fit(docs, labels, 8000, 5), T.fit(docs, labels, 8000, 5, most_words=100)
    assert whole.n == sum(1 for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert half.n == 100 // 5 and set(half.ids) < set(whole.ids)
