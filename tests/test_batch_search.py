"""The batch search by blocks, held against the column expression over all pairs."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions import vector as v
from lexiforge.operators import retrieval as r


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_blocks_return_what_all_pairs_give(spark, monkeypatch, metric):
    rng = random.Random(3)
    base = [[float(rng.randint(-3, 3)) for _ in range(6)] for _ in range(60)]
    vectors = [rng.choice(base) for _ in range(300)] + [[2 * x for x in b] for b in base] + [[0.0] * 6] * 5
    rows = [(i, x) for i, x in enumerate(vectors)] + [(900, None), (901, [None] + [1.0] * 5), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    if metric == "l2":
        df = df.where("id <> 900")
    asked = df.where("id % 20 = 0 OR id > 900").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    far = v.distance(F.col("embedding"), F.col("query"), metric).alias("distance")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    want = df.crossJoin(asked).select("query_id", "id", far).withColumn("rank", place).where("rank <= 7")
    monkeypatch.setattr(r, "ROW_BLOCK", 50)
    monkeypatch.setattr(r, "QUERY_BLOCK", 10)
    assert sorted(map(str, r.top_k_batch(df, asked, 7, metric).collect())) == sorted(map(str, want.collect()))


def test_no_pair_of_a_row_and_a_query_is_a_row_of_the_plan(spark):
    df = spark.range(100).selectExpr("id", "array(cast(id AS float), 1f) AS embedding")
    plan = r.top_k_batch(df, df.selectExpr("id AS query_id", "embedding AS query"), 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CoGroup" in plan
    assert r.top_k_batch(df, df.limit(0).selectExpr("id AS query_id", "embedding AS query"), 3).count() == 0
