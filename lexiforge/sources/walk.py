"""Listing of a tree of folders as a distributed worklist, for what Spark's own listing leaves out.

A round lists the folders of the frontier, each in one task, and hands on their subfolders; those that a glob excludes
are left before anything below them is read. Names that begin with a dot or an underscore are listed like others.
Links to folders aren't followed, so there are no cycles; links to files are files. Each round is written to the shared
folder, so a lost executor repeats a part of one round. The driver counts folders, it holds no names.

Folders are read by os.scandir where the path is local (a mount that all machines have), and by pyarrow.fs elsewhere. A folder
or a file that can't be read becomes a problem row instead of an end.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.errors import ScanError
from lexiforge.functions import text as t
from lexiforge.sources.scan import HASHES, excluded
from lexiforge.sources.shared import written

FOUND = "path string, folder boolean, size long, modified double, problem string"
#: Rows of a batch that a task returns, and bytes that are read at a time.
BATCH, READ = 10_000, 1 << 20


def _local(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def plain(path: str) -> str:
    """A path without the scheme of local files."""
    return re.sub(r"^file:/+", "/", path) if _local(path) else path


def _entries(folder: str) -> Iterator[tuple]:
    """path, folder, size, modified, problem of what is in a folder."""
    if _local(folder):
        with os.scandir(folder) as found:
            for x in found:
                try:
                    is_folder = x.is_dir(follow_symlinks=False)
                    if not is_folder and not x.is_file():  # a link to a folder, a pipe, or a link that leads nowhere
                        continue
                    s = x.stat()
                    yield x.path, is_folder, None if is_folder else s.st_size, s.st_mtime, None
                except OSError as error:
                    yield x.path, False, None, None, str(error)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    head = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    for x in store.get_file_info(fs.FileSelector(path)):
        is_folder = x.type == fs.FileType.Directory
        yield head + x.path, is_folder, None if is_folder else x.size, x.mtime.timestamp() if x.mtime else None, None


def _listed(frontier: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("modified", pa.float64()), ("problem", pa.string())])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows: list[tuple] = []
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    for row in _entries(folder):
                        rows.append(row)
                        if len(rows) >= BATCH:
                            yield made(rows)
                            rows = []
                except OSError as error:
                    rows.append((folder, True, None, None, str(error)))
        if rows:
            yield made(rows)

    return written(frontier.select("path").mapInArrow(run, FOUND), "listed")


def below(path: Column, root: str) -> Column:
    return F.substr(path, F.lit(len(root.rstrip("/")) + 2))


def walked(spark: SparkSession, root: str, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (path, size, modified) under a folder, and problems (path, stage, reason). exclude: globs held against each
    part of the path below the root, and against all of it; a folder that one matches is not opened."""
    root = plain(root).rstrip("/")
    frontier = spark.createDataFrame([(root,)], "path string")
    rounds, wide = [], spark.sparkContext.defaultParallelism * 4
    count = 1
    while count:
        found = _listed(frontier.repartition(min(count, wide)))
        found = found.where(~excluded(below(F.col("path"), root), exclude or []) | F.col("problem").isNotNull())
        rounds.append(found)
        frontier = found.where("folder AND problem IS NULL").select("path")
        count = frontier.count()
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    files = every.where("NOT folder AND problem IS NULL").select("path", "size", F.timestamp_seconds("modified").alias("modified"))
    return files, every.where("problem IS NOT NULL").select("path", F.lit("scan").alias("stage"), F.col("problem").alias("reason"))


def scan_tree(
    spark: SparkSession, root: str, extensions: list[str] | None = None, exclude: list[str] | None = None, algorithm: str = "sha256", content: bool = False
) -> tuple[DataFrame, DataFrame]:
    """As scan_files, hidden names included: path, size, checksum, modified (and content), and problems."""
    if algorithm not in HASHES:
        raise ScanError(f"unknown hash {algorithm!r}")
    files, problems = walked(spark, root, exclude)
    if extensions:
        files = files.where(t.extension(F.col("path")).isin([e.lower().lstrip(".") for e in extensions]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                sums, raw, problem = None, None, None
                try:
                    sums, raw = _read(path, algorithm, content)
                except OSError as error:
                    problem = str(error)
                one = batch.slice(i, 1)
                columns = [*one.columns, pa.array([sums], pa.string()), pa.array([raw], pa.binary()), pa.array([problem], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "size", "modified", "checksum", "content", "problem"])

    read = files.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(run, "path string, size long, modified timestamp, checksum string, content binary, problem string")
    read = written(read, "read")
    refused = read.where("problem IS NOT NULL").select("path", F.lit("scan").alias("stage"), F.col("problem").alias("reason"))
    return read.where("problem IS NULL").select("path", "size", "checksum", "modified", *(["content"] if content else [])), problems.unionByName(refused)


def _read(path: str, algorithm: str, content: bool) -> tuple[str, bytes | None]:
    sums, parts = hashlib.new(algorithm), []
    if _local(path):
        source = open(path, "rb")  # noqa: SIM115  closed below
    else:
        from pyarrow import fs

        store, own = fs.FileSystem.from_uri(path)
        source = store.open_input_stream(own)
    with source:
        while part := source.read(READ):
            sums.update(part)
            if content:
                parts.append(part)
    return sums.hexdigest(), b"".join(parts) if content else None
