"""Runs of equal neighbours: from one sort, in partitions that grow in number, not in size."""

from tessera.operators import dataset


def test_runs_with_nulls_and_single_rows(spark):
    rows = [(k, i, v) for k, vs in enumerate([[1, 1, None, None, 1], [None], [2, 3, 3, 2, 2, 2], [0]]) for i, v in enumerate(vs)]
    got = dataset.runs(spark.createDataFrame(rows, "k long, i long, v long"), ["k"], ["i"], "v")
    assert got.columns == ["k", "run", "value", "length"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(0, 1, 1, 2), (0, 2, None, 2), (0, 3, 1, 1), (1, 1, None, 1), (2, 1, 2, 1), (2, 2, 3, 2), (2, 3, 2, 3), (3, 1, 0, 1)], key=str)


def test_runs_hold_no_table_and_no_large_partition(spark, monkeypatch):
    monkeypatch.setattr(dataset, "ROWS", 100)
    rows = spark.range(4000).selectExpr("id div 4 as k", "id as i", "id % 3 as v")
    got = dataset.runs(rows, ["k"], ["i"], "v")
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() == 40
    assert got.count() == 4000
