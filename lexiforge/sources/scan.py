"""File scans: extension list, exclusion globs, content hash; one row a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.errors import ScanError
from lexiforge.functions import text as t

HASHES = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "sha384": lambda c: F.sha2(c, 384), "sha224": lambda c: F.sha2(c, 224), "sha1": F.sha1, "md5": F.md5}


def excluded(relative: Column, patterns: list[str]) -> Column:
    """A part of the path, the path below the root, or the name matches a glob."""
    if not patterns:
        return F.lit(False)
    return F.exists(F.split(relative, "/"), lambda p: t.any_glob(p, patterns)) | t.any_glob(relative, patterns)


def excluded_from_right(path: Column, patterns: list[str]) -> Column:
    """The profiler's rule: a glob of n parts is held against the last n parts of each folder above the file."""
    out = F.lit(False)
    for p in patterns:
        out = out | _tail_matches(F.split(path, "/"), p.strip("/").split("/"))
    return out


def _tail_matches(parts: Column, globs: list[str]) -> Column:
    """The parts of some folder above the file, and as many before it as there are globs, match them one by one."""
    n = len(globs)
    above = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: i >= n)

    def here(i: Column) -> Column:
        hit = F.lit(True)
        for k, g in enumerate(globs):
            hit = hit & t.glob(F.element_at(parts, (i - (n - 1 - k)).cast("int")), g)
        return hit

    return F.exists(above, here)


def scan_files(spark: SparkSession, path: str, pattern: str | None = None, extensions: list[str] | None = None, exclude: list[str] | None = None, algorithm: str = "sha256", content: bool = False) -> DataFrame:
    """path, size, checksum, modified (and content) of the files at or under path. Spark lists no file below a
    folder, and none, whose name begins with a dot or an underscore."""
    if algorithm not in HASHES:
        raise ScanError(f"unknown hash {algorithm!r}")
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        raise ScanError(f"no such path: {path}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    root = fs.makeQualified(target).toUri().getPath().rstrip("/")
    plain = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    rows = reader.load(path).withColumn("path", plain)
    if fs.getFileStatus(target).isDirectory():
        rows = rows.where(~excluded(F.substr("path", F.lit(len(root) + 2)), exclude or []))
    if extensions:
        rows = rows.where(t.extension(F.col("path")).isin([e.lower().lstrip(".") for e in extensions]))
    kept = ["content"] if content else []
    return rows.select("path", F.col("length").alias("size"), HASHES[algorithm](F.col("content")).alias("checksum"), F.col("modificationTime").alias("modified"), *kept)


def file_metadata(path: Column, modified: Column, root: str) -> list[Column]:
    """The eight fields that describe a file; times are ISO strings."""
    relative = F.when(path.startswith(root.rstrip("/") + "/"), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)
    name, time = t.file_name(path), F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss")
    return [
        path.alias("path"), relative.alias("relative_path"), F.regexp_replace(path, "/[^/]*$", "").alias("directory"), name.alias("filename_full"),
        F.regexp_replace(name, r"(?<=.)\.[^.]+$", "").alias("filename_stem"), t.extension(path).alias("file_type"), time.alias("created_at"), time.alias("last_modified"),
    ]
