"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of `share` times all sizes, at most `most` times its own size; what
that cuts off goes to the others by weight, until none is above. A document of a source is expected to occur
target / source size times: its whole copies are certain, and the rest of the target is sampled. Inclusion
chances rise with a document's length by a factor of up to `TILT`, so that short scraps don't displace prose,
and are fitted so that the expected size is the rest of the target; those that reach one are certain. A
document's rank is the odds of its random number divided by its inclusion odds, and the sample of fixed size
is the documents of lowest rank up to the point nearest to the rest of the target.

That point is found by histograms of the ranks' bits, two levels of 4096 buckets for each source; only the
different documents of one last bucket are put in order, so that no source has to be sorted or to meet in one
task. Rows that repeat are counted there, and numbered in blocks where the cut runs through them.

Random numbers are the MD5 of a document's id (null: of its text) and the seed: reruns agree. Rows that are
repeated have the same rank, and are taken in an arbitrary order of equals. A null text has size 0; a
document of size 0 never adds to what is taken. A null source is a source of its own, the last one. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm._shared import WORD_SPACE, numbered, saved, unused

SEED = 11
TILT = 1.5
MOST = 3
WEIGHTS = (1, 2, 3)
BITS = 48


def word_count(text: str = "text"):
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WORD_SPACE, -1), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """source, source_size, target: one row for each source of sizes (source, size).

    Sources in the order in which a rising level would cap them: the level that shares what is left, after the caps of
    all before a source, by the weights of it and all after it, is the final one at the first source that it doesn't cap.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    table = saved(total.select("source", "source_size", weight.alias("w"), F.expr(f"{most!r}D * source_size").alias("cap")), "sources")
    order = W.orderBy(F.expr("cap / w"), F.encode("source", "UTF-8"))  # one row a source
    upto, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    goal = F.sum("source_size").over(W.partitionBy()) * float(share)
    levels = table.where("source_size > 0").select("cap", "w", ((goal - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(after)).alias("level"))
    level = levels.where("w * level <= cap").agg(F.max("level")).first()[0]
    level = float("inf") if level is None else level
    return saved(table.select("source", "source_size", F.expr(f"if(source_size > 0, least(cap, w * double('{level!r}')), 0D)").alias("target")), "targets")


def _uniform(key, seed: int):
    """A number in (0, 1) from 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def _on_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with table's columns; one row a source. Rows keep their places where the table is small enough to send."""
    t = table.withColumnRenamed("source", "__s")
    return rows.join(t, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


def _fitted(rows: DataFrame) -> DataFrame:
    """source, scale: chance = least(1, scale * tilt), whose expected size is `need`. rows: source, size, tilt, need.

    The longer the tilt, the sooner a document is certain. So sizes add up by tilt, of which there are 4096 a source at
    most, and after the certain ones of the longest k tilts the scale is what is left of the need over the rest's mass:
    the final one at the first k whose rest has none that is certain.
    """
    flat = rows.groupBy("source", "tilt").agg(F.first("need").alias("need"), F.sum("size").alias("size"))
    order = W.partitionBy("source").orderBy(F.desc("tilt"))
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    sure = F.coalesce(F.sum("size").over(before), F.lit(0))
    scales = flat.select("source", "tilt", "need", sure.alias("sure"), F.sum(F.expr("size * tilt")).over(rest).alias("mass"))
    scales = scales.selectExpr("source", "tilt", "if(mass > 0, (need - sure) / mass, 1D) AS scale")
    fits = scales.where("scale * tilt < 1").groupBy("source").agg(F.max_by("scale", "tilt").alias("scale"))
    every = flat.select("source").distinct().withColumnRenamed("source", "__o")
    return saved(every.join(fits, F.col("__o").eqNullSafe(F.col("source")), "left").select(F.col("__o").alias("source"), F.coalesce("scale", F.lit(1.0)).alias("scale")), "scale")


def mix(sized: DataFrame, table: DataFrame, seed: int = SEED) -> DataFrame:
    """sized (doc_id, source, size, and key, which random numbers come from) with source_size, target, copies."""
    rows = _on_source(sized, table)
    ratio = "if(source_size > 0, target / source_size, 0D)"
    rows = rows.select("*", F.expr(f"cast(floor({ratio} + 1e-12) AS int)").alias("whole"))
    rows = rows.select("*", F.expr("greatest(0D, target - whole * source_size)").alias("need"), F.expr(f"1 + {TILT - 1}D * least(1D, ln(1D + least(size, 4095)) / ln(4096D))").alias("tilt"))
    rows = saved(rows, "sized")
    fitted = _on_source(rows, _fitted(rows)).withColumn("p", F.expr("least(1D, scale * tilt)"))
    fitted = fitted.withColumn("u", _uniform(F.col("key"), seed))
    # odds of u over odds of p, as an integer of BITS bits that grows with it; certain documents come first
    rank = F.expr(f"CASE WHEN need <= 0 OR p <= 0 THEN NULL WHEN p >= 1 THEN 0L ELSE 1L + cast((u * (1 - p)) / (u * (1 - p) + p * (1 - u)) * {float((1 << BITS) - 2)!r}D AS bigint) END")
    ranked = saved(fitted.select(*rows.columns, rank.alias("rank")), "ranked")

    open_ = ranked.where("rank > 0").select("source", "size", "rank", "key", "need")
    sure = saved(ranked.where("rank = 0").groupBy("source").agg(F.sum("size").alias("sure")), "sure")  # certain documents come before all buckets
    past = None  # for each source: the size of what lies before the bucket that is still open, and that bucket
    for level in (1, 2):
        shift = BITS - 12 * level
        sums = open_.groupBy("source", F.shiftright("rank", shift).alias("b")).agg(F.sum("size").alias("s"), F.first("need").alias("need"))
        if past is not None:
            sums = _on_source(sums, past.select("source", "before"))
        else:
            sums = _on_source(sums, sure).withColumn("before", F.coalesce("sure", F.lit(0).cast("long"))).drop("sure")
        upto = F.sum("s").over(W.partitionBy("source").orderBy("b"))  # 4096 rows a source at most
        edge = sums.withColumn("upto", F.col("before") + upto).where("upto >= need").groupBy("source").agg(F.min(F.struct("b", "upto", "s")).alias("e"))
        past = saved(edge.selectExpr("source", "e.b AS b", "e.upto - e.s AS before"), "edge")
        open_ = _on_source(open_, past.select("source", F.col("b").alias("eb"))).where(f"shiftright(rank, {shift}) = eb").drop("eb")
    # rows that repeat count as one unit here: a source's last bucket holds few units, however often they repeat
    units = open_.groupBy("source", "rank", "key", "size").agg(F.count("*").alias("same"), F.first("need").alias("need"))
    units = _on_source(units, past.select("source", "before"))
    upto = F.sum(F.expr("size * same")).over(W.partitionBy("source").orderBy("rank", "key", "size").rowsBetween(W.unboundedPreceding, 0))
    units = units.withColumn("start", F.col("before") + upto - F.expr("size * same"))
    # the place nearest to the need: a row is taken if its middle lies before it
    takes = "if(size = 0, if(start <= need, same, 0), least(same, cast(floor((need - start) / size + 0.5D) AS bigint)))"
    units = units.withColumn("takes", F.expr(takes)).where("takes > 0")
    stop = units.groupBy("source").agg(F.max(F.struct("rank", "key", "size", "takes", "same")).alias("e"))
    cut = _on_source(past.select("source", F.col("b").alias("edge")), stop.selectExpr("source", "e.rank AS cr", "e.key AS ck", "e.size AS cs", "e.takes AS takes", "e.same AS same"))
    cut = saved(cut, "cut")
    got = _on_source(ranked, cut)
    shift = BITS - 24
    inside = "cr IS NOT NULL AND (rank, key, size) <= (cr, ck, cs)"
    extra = F.expr(f"CASE WHEN rank IS NULL THEN 0 WHEN rank = 0 THEN 1 WHEN edge IS NULL OR shiftright(rank, {shift}) < edge THEN 1 WHEN shiftright(rank, {shift}) > edge THEN 0 WHEN {inside} THEN 1 ELSE 0 END")
    got = got.withColumn("extra", extra)
    # only the unit at the cut itself can have rows on both sides of it
    if not cut.where("takes < same").isEmpty():
        at = F.expr("coalesce(takes < same AND (rank, key, size) = (cr, ck, cs), false)")
        equals = numbered(got.where(at), ["source", "rank", "key", "size"], "nth").withColumn("extra", F.expr("if(nth <= takes, 1, 0)"))
        got = got.where(~at).unionByName(equals.drop("nth"))
    return got.select(*sized.columns, "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key of every row."""
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select("doc_id", "source", word_count().alias("size"), key.alias("key"))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), source, copies."""
    sized = saved(sized_documents(docs), "sizes")
    got = mix(sized, targets(sized))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with docs' columns."""
    sized = saved(sized_documents(docs), "sizes")
    got = mix(sized, targets(sized)).groupBy("key", "source", "size").agg(F.sum("copies").alias("__all"), F.count("*").alias("__n"))
    names = ["key", "source", "size", "all", "n", "own_key", "own_size", "own_source", "text", "nth", "times", "copy"]
    k, src, size, total, n, own_key, own_size, own_source, texts, nth, times, copy = (unused(docs, f"mix_{x}") for x in names)
    plan = saved(got.select(F.col("key").alias(k), F.col("source").alias(src), F.col("size").alias(size), F.col("__all").alias(total), F.col("__n").alias(n)), "copies")
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))
    own = docs.withColumns({own_key: key, own_size: word_count()})
    joined = own.join(plan.hint("shuffle_merge"), (F.col(own_key) == F.col(k)) & F.col("source").eqNullSafe(F.col(src)) & (F.col(own_size) == F.col(size)))
    # rows that share key, source and size share their copies: the first ones of them get one more where they don't divide
    kept = [F.col(f"`{c}`") for c in docs.columns]
    parts = joined.where(F.col(n) == 1).select(*kept, F.col(total).cast("int").alias(times))
    if not plan.where(F.col(n) > 1).isEmpty():
        many = joined.where(F.col(n) > 1).select(*kept, own_key, own_size, total, n, F.col("source").alias(own_source), F.xxhash64("text").alias(texts))
        each = F.floor(F.col(total) / F.col(n)) + F.when(F.col(nth) <= F.col(total) % F.col(n), 1).otherwise(0)
        parts = parts.unionByName(numbered(many, [own_key, own_source, own_size], nth, [texts]).select(*kept, each.cast("int").alias(times)))
    copies = parts.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.select(*kept)
