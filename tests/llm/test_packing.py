import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ids, packing

TRICKY = ["Don't it's WE'LL ŒUVRE ÿ ß İstanbul ΣΑΣ a b \x1cq <|endoftext|> x<|startoftext|> é １２ ½ a--b 'scd \x85 Ÿé ſ", None, "", "\n", "É À×÷ÞŸ ß ÿ \x00 é", "word " * 5000, "12345 a1b2 ***&&&"]


def test_ids_equal_the_tokenizer():
    flat, first = ids.encode(pa.array(TRICKY))
    tokenizer = ids.coder(ids.VOCABULARY).tokenizer
    assert [flat[a:b].tolist() for a, b in zip(first, first[1:])] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TRICKY]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_ids_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    flat, first = ids.encode(pa.array(texts, pa.string()))
    tokenizer = ids.coder(ids.VOCABULARY).tokenizer
    assert [flat[a:b].tolist() for a, b in zip(first, first[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack(spark):
    r = np.random.default_rng(2)
    texts = [" ".join("abcdefg"[i] for i in r.integers(0, 7, n)) for n in [*r.integers(0, 3000, 60), 2047, 2048, 4095, 0]] + TRICKY
    docs = list(enumerate(texts)) + [(0, texts[0]), (None, "x y")]
    rows = packing.pack(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, sequence_id int").repartition(3)).collect()
    tokenizer = ids.coder(ids.VOCABULARY).tokenizer
    whole = sorted((i if i is not None else -1, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in docs)
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["doc_tokens"]) for x in rows if x["start"] == 0) == whole
    by = dict(docs)
    for x in rows:
        t = np.array([*tokenizer.encode(by[x["doc_id"]] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert zlib.crc32(t[x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"]
    sequences = {}
    for x in rows:
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LENGTH


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 500), max_size=12))
def test_patterns_serve_the_demand(demand):
    used = packing.solve(demand, 32)
    got = {}
    for pattern, times in used:
        assert times > 0 and sum(c * k for c, k in pattern.items()) <= 32
        for c, k in pattern.items():
            got[c] = got.get(c, 0) + k * times
    assert got == {c: n for c, n in demand.items() if n}
    rooms: list[int] = []
    for c in sorted((c for c, n in demand.items() for _ in range(n)), reverse=True):
        i = next((i for i, room in enumerate(rooms) if room >= c), None)
        if i is None:
            rooms.append(32 - c)
        else:
            rooms[i] -= c
    assert sum(t for _, t in used) <= len(rooms) + len(demand)
