"""Retrieval: top-k by distance, hybrid score, best chunk of each document, thresholds, word budget, context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions import text as t
from lexiforge.functions import vector as v
from lexiforge.functions.predicates import tags_match, where

#: Queries are sent to all tasks up to this many bytes; more than that are dealt in blocks.
QUERY_BYTES = 64 << 20
#: Rows and queries that meet in one task.
ROW_BLOCK, QUERY_BLOCK = 16_384, 4096


def top_k(rows: DataFrame, query: list[float], k: int = 40, metric: str = "cosine", spec: dict | None = None, vector: str = "embedding", key: str = "id") -> DataFrame:
    """The k nearest rows (0: 40), ties by key: each task keeps its own k, and the driver's merge is of those."""
    near = rows.where(where(spec)).withColumn("distance", v.distance(F.col(vector), v.literal(query), metric))
    return near.orderBy("distance", key).limit(k or 40)


def top_k_batch(rows: DataFrame, queries: DataFrame, k: int = 40, metric: str = "cosine", vector: str = "embedding", key: str = "id") -> DataFrame:
    """query_id, key, distance, rank for a stated set of queries (query_id, query) against all rows.

    Rows and queries are dealt in blocks, and each pair of blocks meets in one task as two matrices: their product says
    which rows can be among a query's k, and the distances of these are computed as `vector.distance` does, sum by sum.
    A task returns k rows a query. Vectors that aren't finite numbers at the queries' width go row by row.
    """
    width = queries.select(F.max(F.size("query"))).first()[0] or 1
    kinds = [queries.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString()]
    asked, held = queries.select("query_id", "query"), rows.select(key, vector)
    here, there = max(1, -(-held.count() // ROW_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    plain, whole = _plain("query", width), _plain(vector, width)

    def meet(mine: pa.Table, held: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held, sort_keys=[(key, "ascending")], null_placement="at_start"))
        q, x = (np.asarray(t_.column(c).combine_chunks().flatten(), np.float64).reshape(-1, width) for t_, c in ((mine, "query"), (held, vector)))
        row, at, far = v.nearest(q, x, k, metric)
        return pa.table({"query_id": mine.column("query_id").take(pa.array(row)), key: held.column(key).take(pa.array(at)), "distance": pa.array(far, pa.float64())})

    i, j = F.pmod(F.xxhash64("query_id"), F.lit(there)).cast("int"), F.pmod(F.xxhash64(key), F.lit(here)).cast("int")
    dealt_queries = asked.where(plain).select("query_id", "query", i.alias("query_block"), F.explode(F.sequence(F.lit(0), F.lit(here - 1))).alias("row_block"))
    dealt_rows = held.where(whole).select(key, vector, F.explode(F.sequence(F.lit(0), F.lit(there - 1))).alias("query_block"), j.alias("row_block"))
    place = ["query_block", "row_block"]
    out = dealt_queries.groupBy(*place).cogroup(dealt_rows.groupBy(*place)).applyInArrow(meet, f"query_id {kinds[0]}, `{key}` {kinds[1]}, distance double")
    for some, others in ((asked, held.where(~whole)), (asked.where(~plain), held.where(whole))):
        if not some.isEmpty() and not others.isEmpty():
            out = out.union(_row_by_row(some, others, width, metric, vector, key))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _plain(column: str, width: int) -> Column:
    """Whether a vector has the width and finite entries whose squares are far from overflow."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > 1e100))
    return F.coalesce((F.size(column) == width) & ~odd, F.lit(False))


def _row_by_row(queries: DataFrame, rows: DataFrame, width: int, metric: str, vector: str, key: str) -> DataFrame:
    """query_id, key, distance of all pairs; queries are broadcast in blocks of at most QUERY_BYTES, and the rank filter is
    applied before anything moves."""
    blocks = max(1, -(-queries.count() * width * 8 // QUERY_BYTES))
    out = None
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        near = rows.join(F.broadcast(mine)).select("query_id", key, v.distance(F.col(vector), F.col("query"), metric).alias("distance"))
        out = near if out is None else out.union(near)
    return out


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return F.when(path.startswith(root), F.regexp_replace(F.substr(path, F.lit(len(root) + 1)), "^/+", "")).otherwise(path)


def as_sources(hits: DataFrame, document: Column, chunk: str = "document", context: int = 200, key: str = "id") -> DataFrame:
    """Hits with similarity (1 - distance, within 0 and 1), original_similarity, context and rank."""
    rank = F.row_number().over(W.orderBy("distance", key))  # of k rows
    raw = 1 - F.col("distance")
    return hits.select(
        "*", document.alias("source_document"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("similarity"),
        raw.alias("original_similarity"), F.substring(chunk, 1, context).alias("context"), rank.alias("rank"),
    )


def age_days(date: Column, as_of: str) -> Column:
    """Days from a date (epoch seconds or a usual spelling of a timestamp) to as_of; null if it can't be read."""
    formats = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/MM/dd", "dd MMM yyyy", "MMM d, yyyy"]
    read = F.coalesce(F.expr("try_cast(NULL AS timestamp)"), date.try_cast("timestamp"), *(F.try_to_timestamp(date, F.lit(f)) for f in formats))
    epoch = F.coalesce(date.try_cast("double"), F.unix_timestamp(read).cast("double"))
    return (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - epoch) / 86400


def hybrid_score(
    sources: DataFrame, keywords: list[str], preferred: list[str], tag_boost: float = 1.5, source_boost: float = 1.0,
    recency_boost: float = 1.0, date: str | None = None, as_of: str | None = None, strict: bool = False,
) -> DataFrame:
    """similarity times each boost that applies, once. strict compares a tag string's single characters."""
    tags = F.transform(F.filter(F.split("tags", ""), lambda c: c != ""), F.lower) if strict else F.transform(t.split_csv(F.col("tags")), F.lower)
    boost = F.when(tags_match(tags, keywords), F.lit(tag_boost)).otherwise(F.lit(1.0))
    boost = boost * F.when(t.any_glob(F.col("source_document"), preferred), F.lit(source_boost)).otherwise(F.lit(1.0))
    if date is not None and as_of is not None:
        boost = boost * F.when(age_days(F.col(date).cast("string"), as_of) < 365, F.lit(recency_boost)).otherwise(F.lit(1.0))
    return sources.withColumn("boost", boost).withColumn("similarity", F.col("similarity") * F.col("boost"))


def best_of_document(scored: DataFrame, document: str = "source_document") -> DataFrame:
    """The most similar chunk of each document, the earlier one of equals."""
    best = F.row_number().over(W.partitionBy(document).orderBy(F.desc("similarity"), "rank"))
    return scored.withColumn("__best", best).where("__best = 1").drop("__best")


def filtered(best: DataFrame, keywords: list[str], min_similarity: float = 0.2, tag_min_similarity: float = 0.1) -> DataFrame:
    """Rows over the threshold (direct), then rows that match a tag and pass the lower one; place is their order."""
    tagged = tags_match(F.transform(t.split_csv(F.col("tags")), F.lower), keywords)
    direct = F.col("similarity") >= min_similarity
    kept = best.withColumn("direct", direct).where(direct | (tagged & (F.col("similarity") >= tag_min_similarity)))
    place = F.row_number().over(W.orderBy(F.desc("direct"), F.desc("similarity"), "rank"))  # of k rows
    return kept.withColumn("place", place)


def within_budget(sources: DataFrame, budget: int = 4096, chunk: str = "document") -> DataFrame:
    """The rows before the first one that would exceed the budget of words."""
    n = t.word_count(F.col(chunk))
    used = F.sum("n_words").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return sources.withColumn("n_words", n).withColumn("used_words", used).where(F.col("used_words") <= budget)


def context_text(sources: DataFrame, chunk: str = "document") -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(chunk).alias("chunk")))), lambda x: F.concat(F.lit("\n---\n"), x["chunk"]))
    return sources.agg(F.array_join(parts, "").alias("context"), F.count("*").alias("n_sources"))


def candidates(rows: DataFrame, tags: list[str], needles: list[str], key: str = "id") -> DataFrame:
    """key, place: what a tag or a keyword finds in the metadata, in one scan, each key once and in the order in which the
    searches, one after the other, would see it first: place is the number of the search. Informational; retrieval doesn't use it."""
    from lexiforge.functions.predicates import metadata_contains

    place = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate([*tags, *needles]))):
        place = F.when(metadata_contains(F.col("metadata"), n), F.lit(i)).otherwise(place)
    found = rows.select(key, place.alias("place")).where(F.col("place").isNotNull())
    return found.groupBy(key).agg(F.min("place").alias("place"))
