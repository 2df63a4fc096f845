"""add, list, remove and query from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiforge.config import Config
from lexiforge.models.base import EchoAnswerer, HashEmbedder
from lexiforge.operators import catalog
from lexiforge.plans.rag import Settings, ask, shown
from lexiforge.sources.collection import Collection
from lexiforge.sources.scan import scan_files
from lexiforge.streaming.ingest import ingest


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiforge")
    p.add_argument("--config")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--add", nargs="+", metavar="PATH")
    what.add_argument("--list", nargs="?", const="*", metavar="GLOB", help="a glob, or incomplete")
    what.add_argument("--remove", nargs="+", metavar="PATTERN")
    what.add_argument("--query", nargs="?", const="", metavar="QUESTION", help="without a question: asks until exit or quit")
    p.add_argument("--detail", action="store_true")
    p.add_argument("--summary", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    config = Config.load(args.config) if args.config else Config()
    spark = spark or SparkSession.builder.appName("lexiforge").getOrCreate()
    store = Collection(spark, config.get("VECTOR_STORE.PERSIST_DIRECTORY"), config.get("VECTOR_STORE.COLLECTION_NAME"), config.get("VECTOR_STORE.DISTANCE_METRIC"))
    embedder = HashEmbedder(config.get("EMBEDDING_MODEL.DIMENSIONS"))
    if args.add:
        sizes = {"max_size": config.get("DOCUMENT_PROCESSING.MAX_CHUNK_SIZE"), "min_size": config.get("DOCUMENT_PROCESSING.MIN_CHUNK_SIZE"), "overlap": config.get("DOCUMENT_PROCESSING.CHUNK_OVERLAP")}
        for path in args.add:
            files = scan_files(spark, path, None, config.get("FILE_SCANNER.ALLOWED_EXTENSIONS"), config.get("FILE_SCANNER.EXCLUDE_PATTERNS"), config.get("FILE_SCANNER.HASH_ALGORITHM"), content=True)
            for r in ingest(files, store, embedder, sizes=sizes).collect():
                print(f"rejected {r.path}: {r.reason}")
    elif args.list is not None:
        rows = store.rows().select("path", "checksum", "tags", F.col("metadata")["summary"].alias("summary"))
        if args.list == "incomplete":
            rows = catalog.incomplete(rows, strict=True)
        else:
            rows = catalog.by_glob(rows, args.list)
        for r in catalog.unique_documents(rows).orderBy("path").toLocalIterator():
            print(r.path, *([f"checksum={r.checksum} tags={r.tags}"] if args.detail else []), *([r.summary or "not available"] if args.summary else []))
        for r in catalog.type_counts(catalog.unique_documents(rows)).orderBy("file_type").collect():
            print(f"{r.file_type}: {r.n}")
    elif args.remove:
        for r in store.remove(args.remove, config.get("FILE_SCANNER.DOCUMENT_PATH")).collect():
            print(r.status, r.pattern, r.path or "")
    else:
        s = Settings(k=config.get("QUERY.TOP_K"), min_similarity=config.get("QUERY.MIN_SIMILARITY"), preferred=config.get("QUERY.PREFERRED_SOURCES"), budget=config.get("QUERY.CONTEXT_WINDOW"))
        question = args.query
        while True:
            if not args.query:
                question = input("> ").strip()
                if question in ("", "exit", "quit"):
                    break
            print(shown(ask(question, store.rows(), embedder, EchoAnswerer(), s)))
            if args.query:
                break
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
