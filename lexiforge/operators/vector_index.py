"""A nearest-neighbour index: inverted lists by trained centroids, kept as Parquet, with an exact rerank.

build() trains centroids with Spark's KMeans on a bounded sample (SAMPLE rows a list) and then deals *every* row to the list
of its nearest centroid. The table is partitioned by list, so that a search reads the lists it probes and no others. A
list of more than LIST_ROWS rows is cut into parts by the hash of the key, and probes are dealt to all parts, so that a
list that holds a third of all rows is many tasks' work. search() brings queries and parts of lists together and computes true distances in the lists probed: what it
returns is exact but for rows of lists that it didn't probe. How many to probe is measured, not guessed: CALIBRATING indexed
rows are searched for exactly, in one pass over all rows, and the places that the lists of their neighbours have in each
row's order of lists tell how many lists hold the share RECALL of neighbours. Vectors in clusters need few lists,
vectors without structure about half of them. Centroids are sent to the tasks; their number and width are
checked against CENTROID_BYTES first.

Rows without a vector aren't indexed. Vectors of another width than the index's are an error. Ties go by key.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions import vector as v
from lexiforge.sources.shared import written

SAMPLE, LIST_ROWS, CENTROID_BYTES = 64, 20_000, 64 << 20
#: Queries that meet a part of a list in one task.
QUERIES = 20_000
MOST_LISTS, ROUNDS, SEED = 4096, 15, 11
#: What probes are calibrated for: the share of the nearest NEIGHBOURS that a search finds.
RECALL, NEIGHBOURS, CALIBRATING = 0.95, 10, 200


def lists_for(n: int) -> int:
    """As many lists as a list has rows."""
    return max(1, min(MOST_LISTS, round(math.sqrt(n))))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def _far(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """What orders centroids by their distance from each vector."""
    if metric == "l2":
        return (centroids**2).sum(axis=1) - 2 * (x @ centroids.T)
    return -((_unit(x) if metric == "cosine" else x) @ centroids.T)


def _nearest(x: np.ndarray, query: np.ndarray, metric: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k nearest rows of x and their distances; ties by place. Distances are rounded to 12 digits, below
    which equal vectors may differ by the order of sums."""
    if metric == "l2":
        far = ((x - query) ** 2).sum(axis=1)
    else:
        far = x @ query
        if metric == "cosine":
            size = np.linalg.norm(x, axis=1) * np.linalg.norm(query)
            far = np.divide(far, size, out=np.zeros_like(far), where=size > 0)
        far = 1 - far
    far = np.round(far, 12)
    found = np.arange(len(far)) if len(far) <= k else np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
    found = found[np.argsort(far[found], kind="stable")][:k]
    return found, far[found]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    if len(flat) != len(column) * width:
        raise ValueError(f"vectors of another width than {width}")
    return flat.reshape(-1, width)


def train(rows: DataFrame, vector: str, metric: str, lists: int, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of a sample of `sample` rows a list, or so."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    share = min(1.0, sample * lists / max(1, n))
    some = rows.select(vector) if share == 1.0 else rows.select(vector).sample(share, SEED)
    own = F.transform(F.col(vector), lambda x: x.cast("double"))
    if metric == "cosine":
        size = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + x * x))
        own = F.transform(own, lambda x: F.coalesce(F.try_divide(x, size), x))
    fit = written(some.select(own.alias("v")), "sample").select(array_to_vector("v").alias("features"))
    model = KMeans(k=lists, maxIter=ROUNDS, seed=SEED).fit(fit)
    centroids = np.array(model.clusterCenters())
    return _unit(centroids) if metric == "cosine" else centroids


class VectorIndex:
    """An index in a folder; search() and add() use what build() wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._rows = spark, folder.rstrip("/"), None
        said = json.loads(spark.read.text(f"{self.folder}/about", wholetext=True).first()[0])
        self.metric, self.key, self.vector, self.count = said["metric"], said["key"], said["vector"], said["probes"]
        rows = spark.read.parquet(f"{self.folder}/centroids").orderBy("list").collect()
        self.centroids = np.array([r.centroid for r in rows])
        self.parts = np.array([r.parts for r in rows], np.int64)

    @classmethod
    def build(cls, rows: DataFrame, folder: str, key: str = "id", vector: str = "embedding", metric: str = "cosine", lists: int | None = None) -> VectorIndex:
        spark, folder = rows.sparkSession, folder.rstrip("/")
        own = rows.where(F.col(vector).isNotNull()).select(key, vector)
        n = own.count()
        width = own.select(F.size(vector)).first()[0] if n else 0
        lists = min(lists or lists_for(n), max(1, CENTROID_BYTES // (8 * max(1, width))))
        centroids = train(own, vector, metric, lists) if n else np.zeros((1, 0))
        dealt = _dealt(own, key, vector, centroids, metric)
        sizes = {r.list: r["count"] for r in dealt.groupBy("list").count().collect()}  # a row a list
        parts = [max(1, -(-sizes.get(i, 0) // LIST_ROWS)) for i in range(len(centroids))]
        table = [(i, [float(x) for x in c], p) for i, (c, p) in enumerate(zip(centroids, parts, strict=True))]
        spark.createDataFrame(table, "list int, centroid array<double>, parts int").write.parquet(f"{folder}/centroids")
        made = cls.__new__(cls)
        made._rows = None
        made.spark, made.folder, made.metric, made.key, made.vector = spark, folder, metric, key, vector
        made.centroids, made.parts, made.count = centroids, np.array(parts, np.int64), len(centroids)
        made._write(dealt)
        if n:
            made.count = made._calibrated()
        about = {"metric": metric, "key": key, "vector": vector, "probes": made.count}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{folder}/about")
        return made

    def _calibrated(self) -> int:
        rows, metric, width = self.rows(), self.metric, self.centroids.shape[1]
        some = rows.select(F.col(self.key).alias("query_id"), F.col(self.vector).alias("query")).orderBy(F.xxhash64("query_id")).limit(CALIBRATING)
        some = written(some, "calibrating").collect()  # CALIBRATING rows
        kind, queries = rows.schema[self.key].dataType.simpleString(), np.array([r.query for r in some], float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(2), width)
                    near = [(i, *_nearest(x, q, metric, NEIGHBOURS + 1)) for i, q in enumerate(queries)]
                    at = pa.array(np.concatenate([places for _, places, _ in near]))
                    asked = np.repeat([i for i, _, _ in near], [len(places) for _, places, _ in near])
                    columns = [pa.array(asked, pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate([far for _, _, far in near]))]
                    yield pa.RecordBatch.from_arrays(columns, names=["asked", "key", "list", "far"])

        near = rows.select(self.key, "list", self.vector).mapInArrow(run, f"asked int, key {kind}, list int, far double")
        place = F.row_number().over(W.partitionBy("asked").orderBy("far", "key"))
        found = near.withColumn("place", place).where(F.col("place") <= NEIGHBOURS + 1).collect()  # as many for each
        near = [(r.asked, r.list) for r in found if r.key != some[r.asked].query_id]
        if not near:
            return len(self.centroids)
        order = np.argsort(_far(queries[[q for q, _ in near]], self.centroids, self.metric), axis=1, kind="stable")
        places = np.sort((order == np.array([at for _, at in near])[:, None]).argmax(axis=1))
        return int(places[math.ceil(RECALL * len(places)) - 1]) + 1

    def _write(self, dealt: DataFrame) -> None:
        part = F.pmod(F.xxhash64(self.key), F.element_at(F.array(*map(F.lit, self.parts.tolist())), F.col("list") + 1)).cast("int")
        placed = dealt.withColumn("part", part).repartition("list", "part")
        placed.write.mode("append").partitionBy("list").parquet(f"{self.folder}/rows")
        self._rows = None

    def rows(self) -> DataFrame:
        """The table; its files are listed once, and again after a change."""
        if self._rows is None:
            self._rows = self.spark.read.parquet(f"{self.folder}/rows")
        return self._rows

    def add(self, rows: DataFrame) -> None:
        """Deals further rows to the lists that there are."""
        self._write(_dealt(rows.where(F.col(self.vector).isNotNull()).select(self.key, self.vector), self.key, self.vector, self.centroids, self.metric))

    def remove(self, keys: DataFrame) -> None:
        """Rewrites the lists that hold any of the keys (a column named like the index's), each from a copy outside."""
        hit = [r.list for r in self.rows().join(keys.select(self.key).distinct(), self.key, "left_semi").select("list").distinct().collect()]  # MOST_LISTS at most
        if not hit:
            return
        left = written(self.rows().where(F.col("list").isin(hit)).join(keys.select(self.key).distinct(), self.key, "left_anti"), "left")
        empty = set(hit) - {r.list for r in left.select("list").distinct().collect()}
        left.repartition("list", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{self.folder}/rows")
        self._rows = None
        jvm = self.spark._jvm
        for i in empty:
            gone = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows/list={i}")
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def probes(self, queries: DataFrame, count: int) -> DataFrame:
        """query_id, query, list, part: what each query has to look into."""
        centroids, parts, metric = self.centroids, self.parts, self.metric
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = _far(_matrix(batch.column(1), centroids.shape[1]), centroids, metric)
                near = np.argpartition(far, min(count, far.shape[1]) - 1, axis=1)[:, :count]
                lists = near.ravel()
                row = np.repeat(np.repeat(np.arange(batch.num_rows), near.shape[1]), parts[lists])
                own = np.repeat(lists, parts[lists])
                part = np.arange(len(own)) - np.repeat(np.cumsum(parts[lists]) - parts[lists], parts[lists])
                columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(own, pa.int32()), pa.array(part, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "query", "list", "part"])

        vectors = queries.where("query IS NOT NULL").select("query_id", F.transform("query", lambda x: x.cast("double")).alias("query"))
        return vectors.mapInArrow(run, f"query_id {kind}, query array<double>, list int, part int")

    def search(self, queries: DataFrame, k: int = 40, probes: int | None = None) -> DataFrame:
        """query_id, key, distance, rank: the k nearest rows of the lists probed, for each of queries (query_id, query)."""
        if not self.centroids.shape[1]:
            return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{self.key}` string, distance double, rank int")
        count = min(len(self.centroids), probes or self.count)
        slices = max(1, -(-queries.count() * count // (len(self.centroids) * QUERIES)))
        asked = self.probes(queries, count).withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"))
        rows = self.rows().join(asked.select("list").distinct(), "list", "left_semi")  # so that lists that nobody asks for aren't moved
        rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        key, vector, metric, width = self.key, self.vector, self.metric, self.centroids.shape[1]
        kinds = [queries.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString()]

        def meet(mine: pa.Table, held: pa.Table) -> pa.Table:
            held = held.sort_by(key)
            x, q = (_matrix(c.combine_chunks(), width) for c in (held.column(vector), mine.column("query")))
            near = [_nearest(x, v_, metric, k) for v_ in q] if len(x) else []
            row = np.repeat(np.arange(len(near)), [len(places) for places, _ in near]) if near else np.empty(0, int)
            at, far = (np.concatenate([n[i] for n in near]) if near else np.empty(0) for i in (0, 1))
            return pa.table({"query_id": mine.column("query_id").take(pa.array(row)), key: held.column(key).take(pa.array(at.astype(np.int64))), "distance": pa.array(far, pa.float64())})

        place = ["list", "part", "slice"]
        near = asked.groupBy(*place).cogroup(rows.groupBy(*place)).applyInArrow(meet, f"query_id {kinds[0]}, `{key}` {kinds[1]}, distance double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", self.key))
        return near.withColumn("rank", rank).where(F.col("rank") <= k)

    def nearest(self, query: list[float], k: int = 40, probes: int | None = None) -> DataFrame:
        """The k nearest rows to one query: its lists are named in the plan, so the scan opens no others."""
        count = min(len(self.centroids), probes or self.count)
        far = _far(np.array([query], float), self.centroids, self.metric)[0]
        lists = np.argpartition(far, count - 1)[:count].tolist()
        own = self.rows().where(F.col("list").isin(lists))
        return own.select(self.key, v.distance(F.col(self.vector), v.literal(query), self.metric).alias("distance")).orderBy("distance", self.key).limit(k)


def _dealt(rows: DataFrame, key: str, vector: str, centroids: np.ndarray, metric: str) -> DataFrame:
    """key, vector, list of each row, written to the shared folder: it is counted and then dealt."""
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{vector}` {rows.schema[vector].dataType.simpleString()}, list int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _far(_matrix(batch.column(1), centroids.shape[1]), centroids, metric).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32())], names=[key, vector, "list"])

    return written(rows.select(key, vector).mapInArrow(run, schema), "dealt")
