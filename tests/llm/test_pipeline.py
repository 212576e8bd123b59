"""The pipeline on a small corpus against what each stage must do to it."""

import random
import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import ids  # noqa: E402
from tessera.llm.pii import NO_KEY, pseudonymiser  # noqa: E402
from tests.llm.test_ngram_join import brute  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    r = random.Random(3)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    item = " ".join(r.choice(words) for _ in range(40))
    docs, labels = {}, []
    for i in range(900):
        text = [r.choice(words) for _ in range(r.randrange(20, 90))]
        if i % 7 == 0:
            text[r.randrange(len(text))] = r.choice(["vile", "rotten"])
        if i < 600:
            labels.append((i, int(i % 7 == 0)))
        docs[i] = " ".join(text)
    docs[901] = docs[1]
    docs[902] = docs[2].replace(docs[2].split()[-1], "changed")
    docs[903] = f"some words {item} and more"
    docs[904] = "clean " * 3 + "pay with 4111 1111 1111 1111 today or 10.1.2.3"
    docs[905], docs[906], docs[907] = None, "", ""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs


def test_stages(spark, corpus):
    d, docs = corpus
    at, kept = spark.read.parquet(f"{d}/documents.parquet"), [{i: t for i, t in docs.items()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, d)
        assert out.columns == at.columns, name
        at = spark.createDataFrame(out.collect(), SCHEMA)
        kept.append({r["doc_id"]: r["text"] for r in at.collect()})
    start, clean, single, fair, private = kept
    toxic = {i for i, t in start.items() if re.search(r"\b(vile|rotten)\b", t or "")}
    assert set(start) - set(clean) == toxic
    groups = brute(list(clean.items()), 5, 80, 100)
    assert set(single) == {i for i, (_, c) in groups.items() if c == i}
    assert 901 not in single and 902 not in single and {905, 906, 907} <= set(single)
    assert set(single) - set(fair) == {903}
    one = pseudonymiser(NO_KEY.encode())
    assert private == {i: t if t is None else one(t)[0] for i, t in fair.items()}
    assert "4111" not in private[904] and "10.1.2.3" not in private[904]


def test_run(spark, corpus):
    d, docs = corpus
    rows = corpus_pipeline.run(spark, d).collect()
    assert len(rows) > 500 and not {901, 902, 903} & {r["doc_id"] for r in rows}
    tokenizer = ids.coder(ids.VOCABULARY).tokenizer
    for r in rows[:50]:
        t = np.array([*tokenizer.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        if r["doc_id"] < 904:
            assert zlib.crc32(t[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_stages_on_odd_tables(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = SCHEMA + ", h long, row string, n_pii int, score double"
    odd = [(None, "some words of no id at all", "en", "a", 3), (None, None, None, None, None), (1, "", "en", "a", 0), (2, "word " * 50_000, "en", "a", 1), (3, "one two three four five six", "en", "a", 1), (3, "one two three four five six", "en", "a", 1), (4, None, None, None, None)]
    docs = spark.createDataFrame([(*r, 7, "r", 8, 0.5) for r in odd], schema)
    for at, left in ((docs, 6), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == docs.columns, name
            at = spark.createDataFrame(at.collect(), schema)
        assert at.count() == left
        assert (corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() > 0) == (left > 0)
