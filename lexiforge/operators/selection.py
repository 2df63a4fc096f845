"""Order statistics of a column without sorting it: histograms that are refined around the places asked for.

Values are counted first, each task for itself, and the counts are written, so that what they come from runs once. Then
each pass deals the values between two bounds into BINS bins and keeps the bin that holds a place, with its least and its
greatest value as the new bounds; a bin of one value is the answer. Least and greatest lie in different bins, so every
pass is a step, and an evenly filled range shrinks by BINS. What comes to the driver is BINS rows a place and pass; no
task holds an order of values, and no window is without a partition.

Nulls come before all values. NaN counts as null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.sources.shared import written

BINS = 4096


def value_counts(rows: DataFrame, x: str) -> DataFrame:
    """x, c: how many rows have each value, written to the shared folder."""
    real = isinstance(rows.schema[x].dataType, (T.DoubleType, T.FloatType))
    own = F.when(F.isnan(x), F.lit(None)).otherwise(F.col(x)) if real else F.col(x)
    return written(rows.select(own.alias("x")).groupBy("x").agg(F.count("*").alias("c")), "values")


@dataclass
class Found:
    """The value at a place (None: a null), how many rows lie before its first one, and how many have it."""

    value: Any
    below: int
    count: int


@dataclass
class _Open:
    low: Any
    high: Any
    below: int


def _bin(x: Column, low: Any, high: Any, kind: T.DataType) -> Column:
    """The bin of values between low and high, rising with them; low is in the first and high in the last."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):  # halves, as a difference may be too large for a double
        share = (x.cast("double") / 2 - F.lit(float(low)) / 2) / (float(high) / 2 - float(low) / 2)
    else:
        span = int(high) - int(low) if not isinstance(kind, T.DecimalType) else high - low
        share = (x.cast("decimal(38,6)") - F.lit(low).cast("decimal(38,6)")).cast("double") / float(span)
    return F.greatest(F.lit(0), F.when(x == F.lit(high), BINS - 1).otherwise(F.least(F.floor(share * (BINS - 1)), F.lit(BINS - 2)))).cast("int")


def at_places(counts: DataFrame, places: Callable[[int], list[int]]) -> tuple[int, dict[int, Found]]:
    """The number of rows, and what is at each place (from 0) in their order. counts: of value_counts()."""
    kind = counts.schema["x"].dataType
    first = counts.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x").isNull(), F.col("c"))).alias("nulls"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    n, nulls = first["n"] or 0, first["nulls"] or 0
    wanted = sorted({p for p in places(n) if 0 <= p < n})
    found = {p: Found(None, 0, nulls) for p in wanted if p < nulls}
    pending = {p: _Open(first["low"], first["high"], nulls) for p in wanted if p >= nulls}
    while pending:
        ranges = {(o.low, o.high): o.below for o in pending.values()}  # places of one bin share it
        place = F.lit(None)
        for i, (low, high) in enumerate(ranges):  # they share no value
            at = F.lit(0) if low == high else _bin(F.col("x"), low, high, kind)
            place = F.when((F.col("x") >= F.lit(low)) & (F.col("x") <= F.lit(high)), F.struct(F.lit(i).alias("range"), at.alias("bin"))).otherwise(place)
        own = counts.select(place.alias("at"), "x", "c").where("at IS NOT NULL")
        bins = own.groupBy("at.range", "at.bin").agg(F.sum("c").alias("c"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for i, (bounds, below) in enumerate(ranges.items()):
            mine = [p for p, o in pending.items() if (o.low, o.high) == bounds]
            for b in sorted((b for b in bins if b["range"] == i), key=lambda b: b["bin"]):
                for p in [p for p in mine if below <= p < below + b["c"]]:
                    if b["low"] == b["high"]:
                        found[p] = Found(b["low"], below, b["c"])
                        del pending[p]
                    else:
                        pending[p] = _Open(b["low"], b["high"], below)
                below += b["c"]
    return n, found


def median(counts: DataFrame) -> float | None:
    """The mean of the two values in the middle, nulls apart."""
    own = counts.where("x IS NOT NULL")
    n, found = at_places(own, lambda n: [(n - 1) // 2, n // 2])
    return None if not n else (float(found[(n - 1) // 2].value) + float(found[n // 2].value)) / 2


def _by_key(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """rows whose place by key is from first to last (from 1). They are dealt by ranges of the key and numbered in
    their task; the tasks' counts say what comes before each."""
    columns = rows.columns
    held = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id())
    held = written(held, "ranged").withColumn("__part", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    kept, before = F.lit(False), 0
    for r in held.groupBy("__part").agg(F.count("*").alias("c")).orderBy("__part").collect():  # a row a task
        low, high = first - 1 - before, last - 1 - before
        if low < r.c and high >= 0:
            kept = kept | ((F.col("__part") == r["__part"]) & (F.col("__place") >= low) & (F.col("__place") <= high))
        before += r.c
    return held.where(kept).select(*columns)


def between_places(rows: DataFrame, size: str, key: str, first: Callable[[int], int], last: Callable[[int], int]) -> DataFrame:
    """The rows whose place by (size, key), from 1, is from first(n) to last(n). Only rows of the two sizes at
    the ends are put in order, by key; the others are kept or left by their size alone."""
    counts = value_counts(rows, size)
    n, found = at_places(counts, lambda n: [first(n) - 1, last(n) - 1])
    low, high = (found.get(f(n) - 1) for f in (first, last)) if n else (None, None)
    if low is None or high is None:
        return rows.limit(0)
    own = F.when(F.isnan(size), F.lit(None)).otherwise(F.col(size)) if isinstance(rows.schema[size].dataType, (T.DoubleType, T.FloatType)) else F.col(size)

    def ends(f: Found) -> DataFrame:
        mine = rows.where(own.eqNullSafe(F.lit(f.value)))
        one, other = max(1, first(n) - f.below), min(f.count, last(n) - f.below)
        return mine if (one, other) == (1, f.count) else _by_key(mine, key, one, other)

    if low.below == high.below:
        return ends(low)
    above = own.isNotNull() if low.value is None else own > F.lit(low.value)
    return rows.where(above & (own < F.lit(high.value))).unionByName(ends(low)).unionByName(ends(high))
