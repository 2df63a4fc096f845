"""Incremental ingest: batch by state tables, and as a stream of new files.

Files are marked open before they are parsed, and the mark goes after their rows are stored, so what a lost run left
open is done again; a second run over the same files stores nothing new, and a batch of a stream is stored exactly once."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiforge.models.base import Embedder, embedded
from lexiforge.operators import catalog
from lexiforge.sources.collection import Collection
from lexiforge.sources.readers import CHUNKS, chunked


def stored_rows(chunks: DataFrame, files: DataFrame, model: Embedder, strict: bool = False, **limits: int) -> DataFrame:
    """Rows for the collection: chunks with ids and vectors, and one row with a zero vector for a file without
    chunks. strict keeps a chunk's own metadata out."""
    own = files.select("path", "checksum").join(chunks, "path", "left")
    own = own.withColumn("id", F.concat_ws(":", "path", F.coalesce("chunk_index", F.lit(0)))).withColumn("text", F.coalesce("text", F.lit("")))
    vectors = embedded(own.select("id", "path", "checksum", "text", "tags", "urls", "section_header", "summary", "chunk_index"), model, **limits)
    extra = [] if strict else [x for c in ("urls", "section_header", "summary", "chunk_index") for x in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.map_filter(F.create_map(F.lit("path"), F.col("path"), F.lit("tags"), F.col("tags"), *extra), lambda k, v: v.isNotNull())
    return vectors.select("id", "path", "checksum", F.col("text").alias("document"), "tags", "embedding", metadata.alias("metadata"))


MARKS = "path string, checksum string"


def _open_marks(collection: Collection) -> list[str]:
    """Folders that name the files of a run, one a run that hasn't ended."""
    fs, target = collection._fs(f"{collection.folder}/open")
    return [s.getPath().toString() for s in fs.listStatus(target)] if fs.exists(target) else []


def left_open(collection: Collection, marks: list[str] | None = None) -> DataFrame:
    """path, checksum of files that a run marked and didn't finish."""
    found = _open_marks(collection) if marks is None else marks
    spark = collection.spark
    return spark.read.schema(MARKS).parquet(*found) if found else spark.createDataFrame([], MARKS)


def ingest(files: DataFrame, collection: Collection, model: Embedder, open_: DataFrame | None = None, txn: tuple[str, int] | None = None, **options) -> DataFrame:
    """Parses, embeds and stores what isn't stored yet; returns the rejects. files: path, checksum, content.
    open_: what to do again besides; by default what runs before left open. A transaction (application, version) is
    stored with the rows; one that is stored already does nothing at all. The marks that go are this run's own and,
    where it did what others left open, theirs, if those files were among its own."""
    spark = collection.spark
    empty = spark.createDataFrame([], "path string, checksum string, stage string, reason string")
    if txn is not None and collection.done(*txn):
        return empty
    others = _open_marks(collection) if open_ is None else []
    new = catalog.needs_processing(files, collection.rows(), left_open(collection, others) if open_ is None else open_)
    marks = f"{collection.folder}/open/{uuid.uuid4().hex}"
    new.select("path", "checksum").write.parquet(marks)
    todo = spark.read.schema(MARKS).parquet(marks)
    new = files.join(todo.select("path", "checksum").distinct(), ["path", "checksum"], "left_semi")  # as it was when marked
    chunks, rejects = chunked(new, **options)
    refused = f"{collection.folder}/rejects/" + (uuid.uuid4().hex if txn is None else f"{re.sub('[^A-Za-z0-9-]', '_', txn[0])}-{txn[1]}")
    rejects.write.mode("overwrite").parquet(refused)
    rejects = spark.read.schema(rejects.schema).parquet(refused)
    accepted = new.join(rejects.select("path"), "path", "left_anti")
    if not todo.isEmpty():
        collection.append(stored_rows(chunks.select(*CHUNKS), accepted, model), todo.join(rejects.select("path"), "path", "left_anti"), txn)
    fs, _ = collection._fs(marks)
    done = [m for m in others if left_open(collection, [m]).join(todo, ["path", "checksum"], "left_anti").isEmpty()]
    for m in [marks, *done]:
        fs.delete(collection._fs(m)[1], True)
    return rejects


def stream(spark: SparkSession, path: str, collection: Collection, model: Embedder, state: str, pattern: str = "*", **options) -> StreamingQuery:
    """Watches a folder; each micro-batch of new files is ingested once: its number is committed with its rows, as a
    transaction of the query that the checkpoint in `state` belongs to, so that a batch that is replayed because
    its run ended between that commit and the checkpoint's changes nothing."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    files = files.select(F.regexp_replace("path", r"^file:(//)?", "").alias("path"), F.sha2("content", 256).alias("checksum"), "content")

    def store(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        application = json.loads(own.read.text(f"{state.rstrip('/')}/metadata").first().value)["id"]
        ingest(batch, collection, model, txn=(application, number), **options)

    return files.writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start()


def log_interaction(spark: SparkSession, folder: str, question: str, answer: str, ts: str) -> None:
    """Appends one question and answer to the log, partitioned by day."""
    row = spark.createDataFrame([(ts, question, answer)], "ts string, question string, answer string")
    row.withColumn("day", F.substring("ts", 1, 10)).write.mode("append").partitionBy("day").parquet(folder)


def day_logs(log: DataFrame) -> DataFrame:
    """day, markdown: each day's entries in order under one heading."""
    entry = F.concat(F.lit("## "), F.col("ts"), F.lit("\n\n**Question:** "), F.col("question"), F.lit("\n\n**Answer:** "), F.col("answer"), F.lit("\n"))
    made = log.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("ts", entry.alias("e")))).alias("all"))
    return made.select("day", F.concat(F.lit("# "), F.col("day").cast("string"), F.lit("\n\n"), F.array_join(F.transform("all", lambda x: x["e"]), "\n")).alias("markdown"))


def day_summaries(log: DataFrame, days: list[str] | None, summarise) -> DataFrame:
    """day, summary by a model, for the given days (those that changed) or all."""
    import pandas as pd

    own = day_logs(log if days is None else log.where(F.col("day").cast("string").isin(days)))

    def run(parts):
        for part in parts:
            yield pd.DataFrame({"day": part["day"].astype(str), "summary": [summarise(x) for x in part["markdown"]]})

    return own.mapInPandas(run, "day string, summary string")
