"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a document's hash. A bucket splits on the next bit only while
it holds more bytes than a shard may, so buckets have depths of their own. Bytes are summed by prefix first
(`step` bits at a time), so what moves is counts of prefixes, not documents; prefixes that are still too
large go on to their next bits.

A shard is over the limit only if it holds one row that is itself larger, or rows that no bit of the hash
tells apart. Rows that repeat (same doc_id) have the same hash; where those alone exceed a shard, a salt of
their text's hash and of their place deals them on. Null ids hash as their text. A null text has no bytes.
An empty table gives an empty table. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiforge.llm._shared import fresh_path, saved, unused

SHARD_BYTES = 64 << 20
BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    """row (docs' columns), __h, __bytes: the row goes along as one column, so that its names can't clash with others."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), text))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, hash_bits(key).alias("__h"), F.octet_length(text).cast("long").alias("__bytes"))


def directory(hashed: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """Leaves of the trie: __lo, __hi (bounds of the hash), depth, shard_bytes, shard_docs. hashed: __h, __bytes."""
    spark = hashed.sparkSession
    spans = saved(hashed.groupBy("__h").agg(F.sum("__bytes").alias("b"), F.count("*").alias("n")), "hashes")
    leaves, open_ = None, spans
    for base in range(0, BITS, step):
        sums = open_.groupBy(F.shiftright("__h", BITS - base - step).alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        sums = saved(sums, "prefixes")
        first = 0 if base == 0 else base + 1
        levels = sums.select(F.explode(F.expr(f"sequence({first}, {base + step})")).alias("depth"), "p", "b", "n")
        levels = levels.groupBy("depth", F.expr(f"shiftright(p, {base + step} - depth)").alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        levels = saved(levels, "levels")
        fits = F.expr(f"b <= {limit} OR n = 1 OR depth = {BITS}")
        up = levels.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up"))
        born = levels.join(up, (levels["depth"] == up["depth"]) & (F.shiftright(levels["p"], 1) == up["up"]), "left_semi")
        if base == 0:
            born = born.union(levels.where("depth = 0"))
        else:  # what was too large at depth `base` has been opened, so its children are born
            born = born.union(levels.where(f"depth = {base + 1}"))
        new = born.where(fits).select(
            F.expr(f"shiftleft(p, {BITS} - depth)").alias("__lo"), F.expr(f"shiftleft(p + 1, {BITS} - depth)").alias("__hi"),
            "depth", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"),
        )
        leaves = new if leaves is None else leaves.union(new)
        stuck = saved(born.where(~fits & (F.col("depth") == base + step)).select("p"), "open")
        if base + step >= BITS or stuck.isEmpty():
            break
        open_ = saved(open_.join(stuck, F.shiftright("__h", BITS - base - step) == F.col("p"), "left_semi"), "hashes")
    return saved(leaves.distinct(), "directory")


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """docs with shard (its prefix as 0s and 1s), depth, shard_bytes, shard_docs; columns of those names are replaced."""
    added = ["shard", "depth", "shard_bytes", "shard_docs"]
    docs = docs.drop(*added)
    hashed = _sized(docs)
    alike = hashed.groupBy("__h").agg(F.sum("__bytes").alias("b"), F.count("*").alias("n")).where(f"b > {limit} AND n > 1")
    many = saved(alike.select(F.col("__h").alias("__many")), "alike")
    if not many.isEmpty():  # what is salted is written before it is used: a repeated task can't deal its rows otherwise
        salted = hashed.join(many, F.col("__h") == F.col("__many"), "left")
        salt = F.concat_ws(":", F.col("__h").cast("string"), F.md5(F.coalesce(F.col("row.text"), F.lit(""))), F.monotonically_increasing_id().cast("string"))
        hashed = saved(salted.withColumn("__h", F.when(F.col("__many").isNull(), F.col("__h")).otherwise(hash_bits(salt))).drop("__many"), "salted")
    leaves = directory(hashed.select("__h", "__bytes"), limit)
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # BITS + 1 values at most
    # the leaf of a hash: its prefix at one of the depths that leaves have; probes are of ids, and one of them hits
    leaf = leaves.select(F.concat_ws(":", "depth", F.expr(f"shiftright(__lo, {BITS} - depth)")).alias("__leaf"), "depth", "shard_bytes", "shard_docs", F.col("__lo").alias("__first"))
    prefix = F.expr(f"if(depth = 0, '', substring(lpad(bin(__first), {BITS}, '0'), 1, depth))")
    if len(depths) <= 1:
        probed = hashed.withColumn("__leaf", F.expr(f"concat_ws(':', {depths[0] if depths else 0}, shiftright(__h, {BITS - (depths[0] if depths else 0)}))"))
    else:
        hashes = hashed.select("__h").distinct()
        probes = hashes.select("__h", F.explode(F.array(*(F.lit(d) for d in depths))).alias("__d"))
        probes = probes.select("__h", F.concat_ws(":", "__d", F.expr(f"shiftright(__h, {BITS} - __d)")).alias("__leaf"))
        found = saved(probes.join(leaf.select("__leaf"), "__leaf", "left_semi"), "found").select(F.col("__h").alias("__g"), "__leaf")
        probed = hashed.join(found, F.col("__h") == F.col("__g"))
    out = probed.join(leaf, "__leaf").withColumn("shard", prefix)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns], *added)


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder a shard (`at=p` and its prefix), and in it one file: rows of a shard meet in one task, which its byte
    limit bounds."""
    at = unused(assigned, "at")
    assigned.withColumn(at, F.concat(F.lit("p"), F.col("shard"))).repartition(at).write.partitionBy(at).parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Written shards; schema: of what was assigned."""
    return spark.read.schema(schema).parquet(path).select(*(F.col(f"`{c}`") for c in schema.names))


def sharded(docs: DataFrame, limit: int = SHARD_BYTES, path: str | None = None) -> DataFrame:
    """`assign`'s rows, read from the shards that are written to path (default: in the shared folder)."""
    spark, assigned = docs.sparkSession, assign(docs, limit)
    path = path or fresh_path(spark, "shards")
    write_shards(assigned, path)
    return read_shards(spark, path, assigned.schema)
