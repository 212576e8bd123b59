import random
import zlib

import pytest

from tessera.llm import sharding


def docs():
    texts = [f"text {i}" for i in range(60)] + ["hot"] * 50 + [f"pair {i // 3}" for i in range(60)] + [None, None, "", ""]
    return list(enumerate(texts)) + [(3, "text 3"), (None, "x")]


@pytest.mark.parametrize("shards", [8, 3])
def test_laws(spark, shards):
    rows = docs()
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, shard string").repartition(3)
    got = sharding.sharded(df, shards).collect()
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == want
    counts = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(shards)]
    assert all(c == list(range(len(c))) for c in counts)
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    groups = {}
    for r in got:
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    hot = groups[zlib.crc32(b"hot")]
    assert len(hot) <= -(-50 // (len(rows) // shards)) + 1
    small = [groups[zlib.crc32(f"pair {i}".encode())] for i in range(20)]
    assert sum(len(g) - 1 for g in small) <= 2  # hash placement would cut nearly all of them
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_empty(spark):
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("texts, copies", [(403, 2), (41, 10)])
def test_every_text_repeats(spark, texts, copies):
    rows = [(i, f"text {i % texts}") for i in range(texts * copies)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    counts = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    groups = {}
    for r in got:
        groups.setdefault(r["doc_id"] % texts, set()).add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) <= 7  # a cut at the end of each shard but the last


@pytest.mark.parametrize("copies, groups, singles", [(2, 80, 0), (3, 55, 5), (3, 57, 0)])
def test_no_group_is_cut_where_all_fit(spark, copies, groups, singles):
    r = random.Random(copies)
    rows = [(i, f"text {i % groups}" if i < copies * groups else f"single {i}") for i in range(copies * groups + singles)]
    r.shuffle(rows)
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    found = {}
    for row in got:
        if row["doc_id"] < copies * groups:
            found.setdefault(row["doc_id"] % groups, set()).add(row["shard"])
    assert sum(len(g) > 1 for g in found.values()) <= max(0, groups - sum(c // copies for c in counts))


def test_full_shards_exchange():
    flow = sharding.circulation([[0, 5, 0, 0], [3, 0, 2, 0], [2, 0, 0, 4], [0, 0, 0, 0]], [0, 0, 0, 3])
    assert [row[:4] for row in flow[:4]] == [[0, 5, 0, 0], [3, 0, 2, 0], [2, 0, 0, 3], [0, 0, 0, 0]]
