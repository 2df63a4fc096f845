"""What several operators need: the shared folder, written tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word of every contract here: a run without ASCII white space.
WORD_SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a `sieve`: it takes 4 MB, however many keys it is made of.
SIEVE = 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if the
    executors are this process, and an error on a cluster, whose machines don't share one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexiforge-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; it is removed when the driver exits."""
    path = f"{shared_dir(spark)}/lexiforge/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001  the session or its gateway is gone; the folder's owner cleans up
        pass


def unused(df: DataFrame, name: str) -> str:
    """A column name that begins with `name` and that df, whatever the case, doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sieve(keys: DataFrame) -> DataFrame:
    """A bitmap of the hashes in keys (h long): page, bits; one row a page of 32768 bits, SIEVE bits at most."""
    bit = keys.select(F.expr(f"pmod(h, {SIEVE}L)").alias("bit")).selectExpr("bit div 32768 AS page", "bit % 32768 AS place")
    return saved(bit.repartition("page").groupBy("page").agg(F.expr("bitmap_construct_agg(place)").alias("bits")), "sieve")


def sifted(rows: DataFrame, h: Column, pages: DataFrame, name: str) -> DataFrame:
    """rows with boolean `name`: false only where the hash h is none of the sieve's keys. Rows don't move; the sieve does,
    whose size is bounded. Where there are too many keys for it, it is true of more rows than need be, and of none less."""
    own, page, bits = (unused(rows, f"sieve_{x}") for x in ("bit", "page", "bits"))
    sent = F.broadcast(pages.select(F.col("page").alias(page), F.col("bits").alias(bits)))
    met = rows.withColumn(own, F.pmod(h, F.lit(SIEVE))).join(sent, F.expr(f"`{own}` div 32768") == F.col(page), "left")
    byte = f"cast(conv(hex(substring(`{bits}`, cast(`{own}` % 32768 div 8 AS int) + 1, 1)), 16, 10) AS int)"
    hit = F.expr(f"coalesce(shiftright({byte}, cast(`{own}` % 8 AS int)) & 1, 0) = 1")
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), hit.alias(name))


def numbered(rows: DataFrame, by: list[str], name: str, order: list[str] | None = None) -> DataFrame:
    """rows with `name`: 1, 2, ... in each group of equal `by` (nulls are equal), in the order of the `order` columns.

    A group is numbered in blocks of 4096 rows at most, which are written first, so that no group has to meet in one
    task; only the blocks' counts do. Rows that are equal in `by` and `order` are numbered arbitrarily.
    """
    block, place, count, past = (unused(rows, f"numbered_{x}") for x in ("block", "place", "count", "past"))
    own = [*by, *(order or []), block]
    held = saved(rows.withColumn(block, F.expr("shiftright(monotonically_increasing_id(), 12)")), "blocks")
    counts = held.groupBy(*own).agg(F.count("*").alias(count))
    upto = F.sum(count).over(W.partitionBy(*by).orderBy(*own[len(by) :]).rowsBetween(W.unboundedPreceding, 0))
    before = counts.select(*(F.col(c).alias(f"{past}_{i}") for i, c in enumerate(own)), (upto - F.col(count)).alias(past))
    same = F.lit(True)
    for i, c in enumerate(own):
        same = same & F.col(c).eqNullSafe(F.col(f"{past}_{i}"))
    placed = held.withColumn(place, F.row_number().over(W.partitionBy(*own).orderBy(F.lit(0)))).join(before, same)
    return placed.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col(past) + F.col(place)).alias(name))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps; each round is written to the shared folder, so that a
    lost executor repeats one round only. Hubs are aggregated by min() before they shuffle; the joins are
    plain equi-joins on both sides' own exchanges, which adaptive execution may split.
    """
    now = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = saved(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.expr("cast(hash(a, b) as decimal(20,0))"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
