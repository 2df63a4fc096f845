"""The inverted lists, held against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import vector_index as vi
from lexiforge.operators.retrieval import top_k, top_k_batch


def recall(index, rows, k=10, key="vec_id", **options):
    asked = rows.where(f"{key} % 100 = 0").select(F.col(key).alias("query_id"), F.col(index.vector).alias("query"))
    exact = {(r.query_id, r[key]) for r in top_k_batch(rows, asked, k, index.metric, index.vector, key).collect()}
    made = index.search(asked, k, **options).collect()
    assert len(made) == len({(r.query_id, r[key]) for r in made})
    return len(exact & {(r.query_id, r[key]) for r in made}) / len(exact)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24)) * 4
    x = centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 24))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").cache()


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_recall_and_probes_on_clusters(spark, clustered, tmp_path, metric):
    index = vi.VectorIndex.build(clustered, f"{tmp_path}/{metric}", "vec_id", metric=metric)
    assert index.rows().count() == 3000
    assert recall(index, clustered) >= 0.9
    assert recall(index, clustered, probes=len(index.centroids)) == 1.0  # all lists: exact
    if metric != "ip":
        assert index.count <= len(index.centroids) / 4
    again = vi.VectorIndex(spark, f"{tmp_path}/{metric}")
    assert again.count == index.count and np.array_equal(again.centroids, index.centroids)
    query = [float(v) for v in clustered.where("vec_id = 7").first().embedding]
    one = [r.vec_id for r in again.nearest(query, 10, probes=len(index.centroids)).collect()]
    assert one == [r.vec_id for r in top_k(clustered, query, 10, metric, key="vec_id").collect()]


def test_recall_on_the_table(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert recall(vi.VectorIndex.build(rows, f"{tmp_path}/x", "vec_id"), rows) >= 0.9


def test_a_probe_opens_its_lists_only(spark, clustered, tmp_path):
    index = vi.VectorIndex.build(clustered, f"{tmp_path}/x", "vec_id")
    plan = index.nearest([1.0] * 24, 5, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_adding_removing_and_a_hot_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "LIST_ROWS", 50)
    same = [(i, [1.0, 0.0]) for i in range(400)]
    other = [(1000 + i, [float(np.cos(i)), float(np.sin(i))]) for i in range(200)]
    rows = spark.createDataFrame(same + other + [(5000, None)], "vec_id long, embedding array<double>")
    index = vi.VectorIndex.build(rows, f"{tmp_path}/x", "vec_id", lists=8)
    assert index.parts.max() >= 8 and index.rows().groupBy("list", "part").count().agg(F.max("count")).first()[0] < 120
    index.add(spark.createDataFrame([(9000, [0.6, 0.8]), (9001, None)], "vec_id long, embedding array<double>"))
    assert index.rows().count() == 601
    query = spark.createDataFrame([(1, [0.6, 0.8])], "query_id long, query array<double>")
    assert index.search(query, 1).first().vec_id == 9000
    index.remove(spark.createDataFrame([(9000,), (3,), (77777,)], "vec_id long"))
    left = {r.vec_id for r in index.rows().collect()}
    assert len(left) == 599 and not left & {9000, 3}


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = vi.VectorIndex.build(empty, f"{tmp_path}/x", "vec_id")
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>")).count() == 0
