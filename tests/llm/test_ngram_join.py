import os
import random

import pytest

from tessera.llm import ngram_join as N

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(docs, k, num, den):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().translate(FOLD).split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            n = len(sets[i] & sets[j])
            if n and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus():
    r = random.Random(5)
    words = [f"w{j}" for j in range(40)]
    docs = []
    for _ in range(8):
        base = [r.choice(words) for _ in range(r.choice([4, 9, 30, 60, 200]))]
        for _ in range(r.choice([2, 5, 30])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.03, 0.06]))):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append((len(docs), " ".join(w)))
    n = len(docs)
    docs += [(n + j, " ".join(r.choice(words[:6]) for _ in range(r.choice([1, 2, 3, 12])))) for j in range(40)]
    return [*docs, (900, None), (901, ""), (902, "  \n"), (903, "A b"), (904, "a B"), (905, "a b c"), (906, "a b c")]


@pytest.mark.parametrize("block,k,num", [(256, 3, 90), (4, 3, 90), (4, 5, 80)])
def test_equals_brute_force(spark, monkeypatch, block, k, num):
    monkeypatch.setattr(N, "BLOCK", block)
    docs = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.jaccard_components(rows, k, num, 100).collect()}
    assert got == brute(docs, k, num, 100)


def test_odd_rows(spark):
    text = "one two three four five six"
    rows = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, text, 6), (None, text, 7), (3, None, None)], "doc_id long, text string, h long")
    got = sorted(N.jaccard_components(rows).collect(), key=str)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = N.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3]


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    long = lambda a: " ".join(f"{a}{j}" for j in range(40))
    docs = [(1, long("a"), 0), (5, long("a") + " more", 1), (5, long("b"), 2), (5, long("b"), 3), (5, None, 4), (5, "", 5), (6, long("b"), 6), (7, long("c"), 7), (7, long("d"), 8), (None, long("a"), 9)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, _h int")
    kept = N.one_of_each(rows.withColumnRenamed("_h", "mark"))
    got = sorted(r["mark"] for r in kept.collect())
    assert [m for m in got if m not in (2, 3)] == [0, 4, 5, 7, 8, 9] and len(got) == 7


def test_hot_keys_join_as_others_do(spark):
    from tessera.llm import common

    rows = common.publish(spark.range(4000).selectExpr("case when id < 2000 then 7 when id < 2100 then null else id end as k", "id as v"), "rows")
    table = spark.range(0, 4000, 2).selectExpr("id + 1 as k", "id as w")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(table, "k", how).select("k", "v", "w").collect()), key=str)
        assert sorted(map(tuple, common.join_hot(rows, table, ["k"], how).select("k", "v", "w").collect()), key=str) == want
        plan = common.join_hot(rows, table, ["k"], how)._jdf.queryExecution().toString()
        assert "Anti" in plan


def test_pairs_come_from_the_traversal(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 62, 50).astype(np.uint64)) for _ in range(3)]
    bits, sizes = [np.frombuffer(N.bitmap(s), dtype=np.uint64) for s in sets], [len(s) for s in sets]
    copies = [0, 0, 1, 2, 2, 2]
    batch = pa.RecordBatch.from_pydict({"h": list(range(6)), "leader": [9, 9, 9, 7, 7, 7], "n": [sizes[i] for i in copies], "bits": [N.bitmap(sets[i]) for i in copies], "m": [sizes[0]] * 3 + [sizes[2]] * 3, "bits2": [N.bitmap(sets[0])] * 3 + [N.bitmap(sets[2])] * 3})
    pairs = lambda: [tuple(p.values()) for b in N.led(90, 100)(iter([batch])) for p in b.to_pylist()]
    inside = lambda: sorted(N.candidates([bits[i] for i in copies], [sizes[i] for i in copies], list(range(6)), 90, 100))
    assert pairs() == [(0, 9), (1, 9), (3, 7), (4, 7), (5, 7)] and inside() == [(0, 1), (3, 4), (3, 5), (4, 5)]
    monkeypatch.setattr(N, "traversed", lambda *_: np.zeros((0, 2), np.int64))
    assert pairs() == [] and inside() == []


@pytest.mark.parametrize("num,den", [(1, 10), (20, 100)])
def test_low_similarities_lose_no_pair(num, den):
    import numpy as np

    r = np.random.default_rng(3)
    whole = r.integers(0, 1 << 62, 900).astype(np.uint64)
    sets = [np.unique(whole[:n]) for n in (70, 90, 130, 300, 500, 900)]
    pairs = set(N.candidates([np.frombuffer(N.bitmap(s), dtype=np.uint64) for s in sets], [len(s) for s in sets], list(range(6)), num, den))
    want = {(i, j) for j in range(6) for i in range(j) if N.links(sets[i], sets[j], num, den)}
    assert want <= {(min(p), max(p)) for p in pairs} and len(want) > 5


def test_published_tables_can_be_cleared(spark):
    from tessera.llm import common

    path = common.publish(spark.range(3), "three").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    common.clear(spark)
    assert not os.path.exists(path) and not common._published


def test_empty(spark):
    assert N.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_loses_no_pair():
    import numpy as np

    r = np.random.default_rng(1)
    sets = []
    for _ in range(12):
        base = r.integers(0, 1 << 62, 150).astype(np.uint64)
        for _ in range(8):
            keep = base[r.random(150) > 0.03]
            sets.append(np.unique(keep))
    bits, sizes = [np.frombuffer(N.bitmap(s), dtype=np.uint64) for s in sets], [len(s) for s in sets]
    pairs = {(min(p), max(p)) for p in N.candidates(bits, sizes, list(range(len(sets))), 90, 100)}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if N.links(sets[i], sets[j], 90, 100)}
    assert want <= pairs and len(pairs) < len(sets) ** 2 / 8
