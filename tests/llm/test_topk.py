import math
import random

from tessera.llm import topk


def brute(rows, k):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in vectors:
        if i % 10 == 0:
            asked[i] = min(asked.get(i, v), v)
    for i, q in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def rows():
    r = random.Random(2)
    centres = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    out = [(i, [c + r.gauss(0, 0.1) for c in centres[i % 5]]) for i in range(900)]
    out += [(1000 + i, out[7][1]) for i in range(40)]
    return [*out, (2000, None), (2010, [1.0] * 7 + [None]), (2020, [float("nan")] * 8), (2030, [float("inf")] + [0.0] * 7), (2040, [1.0] * 3), (None, [1.0] * 8), (2050, []), (20, [0.5] * 8)]


def test_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, score int").repartition(2)
    asked = df.where("vec_id % 10 = 0")
    want = brute(data, 10)
    assert sorted(map(tuple, topk.top_k(df, asked).collect())) == want
    assert sorted(map(tuple, topk.top_k(df, asked, block_bytes=1000).collect())) == want


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 512 * 1024)]
    assert topk.top_k(df.limit(0), df).count() == 0


def test_large_components(spark):
    r = random.Random(4)
    data = [(i, [r.choice([1e7, 1e16, 3.5, -2e9, 1e300, -1e300, 2.0**20]) * r.uniform(0.5, 1) for _ in range(8)]) for i in range(150)]
    data += [(200 + i, [r.uniform(-1, 1) * 2**21 for _ in range(8)]) for i in range(150)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(2)
    for part in (data, data[150:]):
        want = []
        vectors = [(i, [math.floor(max(-(2.0**62), min(2.0**62, 1024 * x))) for x in v]) for i, v in part]
        for i, q in vectors:
            if i % 10 == 0:
                best = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in vectors if j != i)[:10]
                want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
        some = df.where(f"vec_id >= {part[0][0]}")
        assert sorted(map(tuple, topk.top_k(some, some.where("vec_id % 10 = 0")).collect())) == sorted(want)
