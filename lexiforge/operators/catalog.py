"""Catalogue operators over stored rows: listing, counting, tags, search, removal, what needs processing."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions import text as t
from lexiforge.functions.predicates import metadata_contains
from lexiforge.operators.patterns import as_table, matches, table

#: Patterns that are written into the plan.
INLINE = 32
IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "svg", "heic")


def by_glob(rows: DataFrame, pattern: str | None, path: str = "path") -> DataFrame:
    own = rows.where(F.col(path).isNotNull())
    return own if pattern in (None, "", "*") else own.where(t.glob(F.col(path), pattern))


def unique_documents(rows: DataFrame, first_by: str | None = None) -> DataFrame:
    """One row for each (path, checksum); the first by `first_by`, else any."""
    if first_by is None:
        return rows.dropDuplicates(["path", "checksum"])
    rank = F.row_number().over(W.partitionBy("path", "checksum").orderBy(first_by))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def document_count(rows: DataFrame) -> DataFrame:
    return rows.select("path", "checksum").distinct().agg(F.count("*").alias("n_documents"))


def type_counts(rows: DataFrame, path: str = "path") -> DataFrame:
    kind = F.coalesce(F.substring_index(path, ".", -1), F.lit("unknown"))
    return rows.groupBy(kind.alias("file_type")).agg(F.count("*").alias("n"))


def extension_sizes(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """extension, n, bytes, smallest, largest: what follows the last dot in lower case, or all of a path without any."""
    kind = F.substring_index(F.lower(path), ".", -1)
    return files.groupBy(kind.alias("extension")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.min(size).alias("smallest"), F.max(size).alias("largest"))


def type_counts_shown(rows: DataFrame) -> DataFrame:
    """By file_type, else by the path's suffix, else under "-"."""
    own = F.when(F.col("file_type") != "", F.col("file_type"))
    suffix = t.extension(F.col("path"))
    return rows.groupBy(F.coalesce(own, F.when(suffix != "", suffix), F.lit("-")).alias("file_type")).agg(F.count("*").alias("n"))


def with_metadata(rows: DataFrame) -> DataFrame:
    some = F.lit(False)
    for c in ("file_type", "chunk_count", "last_modified"):
        some = some | F.coalesce(~F.col(c).cast("string").isin("", "-"), F.lit(False))
    return rows.agg(F.count_if(some).alias("n_with_metadata"))


def distinct_tags(rows: DataFrame, tags: str = "tags") -> DataFrame:
    items = rows.select(F.explode(t.split_csv(F.col(tags))).alias("tag"))
    return items.select(F.lower("tag").alias("tag")).distinct().orderBy("tag")


def duplicate_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def row_id(key: Column, path: Column, place: Column) -> Column:
    return F.coalesce(F.nullif(key, F.lit("")), F.nullif(path, F.lit("")), place.cast("string"))


def metadata_search(rows: DataFrame, needle: str, metadata: str = "metadata", key: str = "id") -> DataFrame:
    return rows.where(F.col(key).isNotNull() & metadata_contains(F.col(metadata), needle)).select(key)


def facet(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def incomplete(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Skipped rows, rows without chunks, and images; strict: images alone."""
    images = t.extension(F.col("path")).isin(*IMAGES)
    if strict:
        return rows.where(images)
    skipped = F.coalesce(F.col("skipped"), F.lit(False)) | F.col("skip_reason").isNotNull() | (F.coalesce("chunk_count", F.lit(-1)) == 0)
    return rows.where(images | skipped)


def needs_processing(scanned: DataFrame, stored: DataFrame, open_: DataFrame | None = None) -> DataFrame:
    """Scanned rows whose checksum isn't stored, and those that an earlier run left open."""
    new = scanned.join(stored.select("checksum").distinct(), "checksum", "left_anti")
    if open_ is None:
        return new
    return new.union(scanned.join(open_.select("checksum").distinct(), "checksum", "left_semi").select(new.columns)).distinct()


def normalised_patterns(patterns: list[str], root: str) -> list[str]:
    """Patterns without wildcards become absolute paths."""
    return [p if any(c in p for c in "*?[") else os.path.normpath(os.path.join(root, p)) for p in patterns]


def removal_matches(rows: DataFrame, patterns: list[str] | DataFrame, path: str = "path") -> DataFrame:
    """pattern and path, once each: what each pattern matches. A few patterns are filters of one scan; more than
    INLINE of them, or a table of them (pattern), are joined by their literal parts."""
    if isinstance(patterns, DataFrame):
        return matches(rows, table(patterns), path)
    if len(patterns) > INLINE:
        return matches(rows, as_table(rows.sparkSession, patterns), path)
    hits = F.filter(F.array(*(F.when(t.glob(F.col(path), p), F.lit(p)) for p in patterns)), lambda p: p.isNotNull())
    return rows.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.explode(hits).alias("pattern")).distinct()


def removal_report(before: DataFrame, after: DataFrame, patterns: list[str]) -> DataFrame:
    """pattern, path, status (removed, failed, not_found): a row for each match, or for a pattern without any."""
    spark = before.sparkSession
    hits = removal_matches(before, patterns)
    still = after.select("path").distinct().withColumn("__still", F.lit(True))
    asked = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    found = asked.join(hits, "pattern", "left").join(still, "path", "left")
    status = F.when(F.col("path").isNull(), "not_found").when(F.col("__still"), "failed").otherwise("removed")
    return found.select("pattern", "path", status.alias("status"))
