"""Order statistics, held against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import profile, selection


def check(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}").repartition(3)
    counts = selection.value_counts(df, "x")
    order = sorted((v for v in values if v is not None and v == v), key=lambda v: v)
    order = [None] * (len(values) - len(order)) + order
    n, found = selection.at_places(counts, lambda n: range(n))
    assert n == len(values) and [found[i].value for i in range(n)] == order
    for i in range(n):
        assert found[i].below == order.index(order[i]) and found[i].count == order.count(order[i])


@pytest.mark.parametrize("bins", [2, 5, 4096])
def test_places(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    rng = random.Random(bins)
    check(spark, [rng.choice([None, 1, 5, 5, 5, -3, 10**6]) for _ in range(25)], "long")
    check(spark, [2**63 - 1, -(2**63), 2**62, 2**62 + 1, 2**62 + 2, 0, None, -1], "long")
    check(spark, [rng.choice([None, float("nan"), 1e308, -1e308, 1e-300, 0.0, 0.1, 2.5, rng.random()]) for _ in range(20)], "double")
    check(spark, [7] * 9, "int")
    assert selection.at_places(selection.value_counts(spark.createDataFrame([], "x long"), "x"), lambda n: [0]) == (0, {})


def test_median(spark):
    for values, expected in (([], None), ([None], None), ([3], 3.0), ([1, None, 2], 1.5), ([5, 1, 9], 5.0)):
        assert selection.median(selection.value_counts(spark.createDataFrame([(v,) for v in values], "x long"), "x")) == expected


@pytest.mark.parametrize("sizes", [[4] * 40, [i % 7 for i in range(40)], [None] * 15 + list(range(25)), [float("nan")] * 5 + [1.0] * 35])
def test_between_places(spark, sizes):
    kind = "double" if isinstance(sizes[-1], float) else "long"
    rows = [(s, f"k{i:02d}") for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, f"size {kind}, key string").repartition(4, "key")
    order = sorted(rows, key=lambda r: (r[0] is not None and r[0] == r[0], r[0] if r[0] is not None and r[0] == r[0] else 0, r[1]))
    for first, last in ((1, 40), (5, 36), (20, 20), (1, 1), (40, 40), (7, 12)):
        got = selection.between_places(df, "size", "key", lambda n, p=first: p, lambda n, p=last: p)
        assert sorted(r.key for r in got.collect()) == sorted(k for _, k in order[first - 1 : last])
    assert selection.between_places(df, "size", "key", lambda n: 0, lambda n: 99).count() == 0


def test_no_window_and_no_percentile_in_the_plans(spark):
    df = spark.range(100).selectExpr("id", "id % 13 AS size", "array(id, id + 1) AS para_lens")
    for made in (profile.spread(df, "size"), profile.index_percentiles(df, [50], "size"), profile.middle(df, "size", "id"), profile.typical(df, "size", "id"), profile.recommended(df)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "percentile" not in plan
    assert profile.spread(df.where("id < 0"), "size").first().asDict() == {"n": 0, "min_x": None, "max_x": None, "mean_x": None, "median_x": None}
    got = profile.spread(df.select(F.col("size").cast("double").alias("size")), "size").first()
    assert (got.n, got.min_x, got.max_x, got.mean_x, got.median_x) == (100, 0.0, 12.0, 5, 6)
