"""The vectorised search against one that tries setting after setting."""

import numpy as np

from tessera.functions import arrays, costs
from tessera.operators import block_search as B


def half(v):
    return v // 2 if v >= 0 else -(-v // 2)


def guess(p, a, b, c, d):
    if p == 0:
        return min(a, b) if c > max(a, b) else max(a, b) if c < min(a, b) else a + b - c
    return [0, (a + c + 1) // 2, (b + c + 1) // 2, (b + d + 1) // 2, a, b, c, d][p]


def one_by_one(block, scans):
    at = lambda v, y, x: int(v[y * 8 + x]) if y >= 0 and 0 <= x < 8 else 0
    least_r = least_f = float("inf")
    found = {}
    for p in B.PREDICTOR_ORDER:
        r = [[at(v, y, x) - guess(p, at(v, y, x - 1), at(v, y - 1, x), at(v, y - 1, x - 1), at(v, y - 1, x + 1)) for y in range(8) for x in range(8)] for v in block]
        e = sum(x * x for v in r for x in v)
        if e > least_r * 1.3:
            continue
        least_r = min(least_r, e)
        for code in B.FILTER_ORDER:
            perm = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)][code >> 4]
            f = [[], [], []]
            for i in range(64):
                d0, d1, d2 = (r[k][i] for k in perm)
                f[0].append(d0)
                f[1].append(d1 - [0, d0, half(d0), half(3 * d0)][code >> 2 & 3])
                f[2].append(d2 - [0, d0, d1, half(d0 + d1)][code & 3])
            e = sum(x * x for v in f for x in v)
            if e > least_f * 1.3:
                continue
            least_f = min(least_f, e)
            for s in scans:
                order = list(arrays.scan_orders().values())[s]
                v = [np.array([[c[i] for i in order]]) for c in f]
                mixed = np.stack(v, axis=2).reshape(1, -1)
                for i, bits in ((0, [sum(int(B.plain(v[c], c)[0]) for c in range(3)), sum(int(B.runs(v[c], 3 + c)[0]) for c in range(3))]), (1, [int(B.plain(mixed, 6)[0]), int(B.runs(mixed, 7)[0])])):
                    found[((p * 96 + code) * 8 + s) * 2 + i] = min(bits)
    best = sorted((b, k) for k, b in found.items())[:2]
    return best, len(found)


def blocks():
    r = np.random.default_rng(6)
    y, x = np.mgrid[0:8, 0:8]
    smooth = np.stack([(32 * x).ravel(), (32 * y).ravel(), (16 * (x + y)).ravel()])
    return np.stack([smooth, np.full((3, 64), 7), np.clip(smooth + r.integers(-9, 9, (3, 64)), 0, 255), r.integers(0, 256, (3, 64))])


def test_search_tries_what_the_order_leaves():
    px = blocks()
    for block, got in zip(px[:3], B.search(px[:3], [0, 3])):
        best, tried = one_by_one(block, [0, 3])
        assert [(got[1], got[0]), (got[4], got[3])] == best and got[6] == tried


def test_costs_equal_the_folds(spark):
    values = np.concatenate([B.residuals(blocks(), 4)[:, 0], np.where(np.abs(B.residuals(blocks(), 0)[:, 1]) < 20, 0, 5)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "i int, v array<long>")
    got = df.select("i", costs.plain_bits("v", 6).alias("p"), costs.run_length_bits("v", 7).alias("r")).orderBy("i").collect()
    assert [r["p"] for r in got] == B.plain(values, 6).tolist()
    assert [r["r"] for r in got] == B.runs(values, 7).tolist()


def test_rows(spark):
    px = blocks()
    rows = [(i, *(c.tolist() for c in b)) for i, b in enumerate(px)] + [(9, [1], [1], [1]), (10, None, None, None)]
    got = B.searched(spark.createDataFrame(rows, "block_id int, c0 array<int>, c1 array<int>, c2 array<int>"), [0]).collect()
    assert sorted(r["block_id"] for r in got) == [0, 1, 2, 3]
    assert all(r["best_bits"] <= r["second_bits"] for r in got)


def test_queries_search_all_scans(spark, monkeypatch):
    import __spark_entry__

    from tessera.plans import q_blocks, q_more
    from tessera.sources import gen8

    rows = [(i, *(c.tolist() for c in b)) for i, b in enumerate(blocks()[:3])]
    planes = spark.createDataFrame(rows, "block_id long, c0 array<int>, c1 array<int>, c2 array<int>")
    monkeypatch.setattr(q_blocks.X, "planes", lambda spark, d: planes)
    monkeypatch.setattr(q_more.X, "planes", lambda spark, d: planes)
    queries = __spark_entry__.queries()
    want = B.search(blocks()[:3], list(range(8)))
    got = sorted(queries["q_block_search"](spark, "").collect())
    assert [tuple(r)[1:] for r in got] == want
    assert any(r["best_rank"] // 2 % 8 for r in got)
    sizes = {r["block_id"]: r["bytes"] for r in q_more.round_trips(spark, "", "gen8").collect()}
    assert sizes == {i: len(gen8.encode(b.reshape(3, 8, 8).transpose(1, 2, 0).astype(np.uint8))) for i, b in enumerate(blocks()[:3])}


def test_many_small_images_are_searched_together(monkeypatch):
    from tessera.sources import gen8

    calls = []
    search = B.search_windows
    monkeypatch.setattr(gen8.B, "search_windows", lambda windows, scans: calls.append(len(windows)) or search(windows, scans))
    images = [b.reshape(3, 8, 8).transpose(1, 2, 0).astype(np.uint8) for b in blocks()] + [np.full((5, 11, 4), 9, np.uint8)]
    files = gen8.encode_all(images, [0, 3])
    assert calls == [4, 1, 1]
    assert files == [gen8.encode(i, [0, 3]) for i in images]
    assert all((gen8.decode(f) == i).all() for f, i in zip(files, images, strict=True))


def test_sequences_shared_by_codes_are_costed_once(monkeypatch):
    """A flat block keeps all 768 heads; their components have 24 forms a predictor, and three places."""
    sizes = []
    fold = B.fold
    monkeypatch.setattr(B, "fold", lambda m, orders, row, by_runs: sizes.append((row, m.shape[1])) or fold(m, orders, row, by_runs))
    assert B.search(np.zeros((1, 3, 64), np.int64), [0])[0][6] == 1536
    assert [n for row, n in sizes if row < 6] == [24, 24, 168, 168, 96, 96]


def test_values_beyond_the_tables():
    far = np.random.default_rng(2).integers(-30000, 30000, (1, 3, 64))
    far[0, :, 20:30] = 0
    got = B.search(far, [0, 5])[0]
    best, tried = one_by_one(far[0], [0, 5])
    assert [(got[1], got[0]), (got[4], got[3])] == best and got[6] == tried


def test_blocks_are_dealt_to_even_tasks(spark):
    one = spark.createDataFrame([(i, [i] * 64, [0] * 64, [1] * 64) for i in range(64)], "block_id long, c0 array<int>, c1 array<int>, c2 array<int>").coalesce(1)
    sizes = B.dealt(one).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 8 and max(sizes) <= 16
