"""Jobs over a collection that a scheduler may run: removing all files of a kind, and ingesting incomplete ones again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.errors import RemovalError
from lexiforge.models.base import Embedder
from lexiforge.operators import catalog
from lexiforge.sources.collection import Collection
from lexiforge.sources.walk import scan_tree
from lexiforge.streaming.ingest import ingest


def remove_kind(collection: Collection, extension: str = "pdf") -> DataFrame:
    """Removes all files with an extension, whatever its case, in one commit; pattern, path, status of each. A file that is
    still there afterwards is an error."""
    letters = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension.lstrip("."))
    report = collection.remove([f"*.{letters}"])
    failed = report.where("status = 'failed'").select("path").first()
    if failed:
        raise RemovalError("some files are still there", requires_cleanup=True, document_id=failed.path)
    return report


def incomplete_files(collection: Collection) -> DataFrame:
    """path, checksum of what was stored without a chunk's text, and of images."""
    rows = collection.rows().groupBy("path", "checksum").agg(F.count_if(F.col("document") != "").alias("chunk_count"))
    whole = rows.withColumn("skipped", F.lit(False)).withColumn("skip_reason", F.lit(None).cast("string"))
    return catalog.incomplete(whole).select("path", "checksum")


def reprocess_incomplete(collection: Collection, model: Embedder, root: str, **options) -> DataFrame:
    """Reads the incomplete files below root again and stores them anew; the rejects."""
    todo = incomplete_files(collection)
    files, _ = scan_tree(collection.spark, root, content=True)  # Spark's own listing has no empty files
    again = files.join(todo.select("path").distinct(), "path", "left_semi").select("path", "checksum", "content")
    return ingest(again, collection, model, again.select("path", "checksum"), **options)
