"""Many glob patterns against many paths: a table of patterns, joined by their literal parts.

A path that a pattern matches holds the pattern's literal text: at its start, at its end, or inside. So each pattern gets one
anchor: the whole of it if it has no wildcard, else its literal prefix or suffix, whichever is longer (MOST characters
at most), else the first GRAM characters of a literal inside. A path has as keys its prefixes and suffixes of the
lengths that occur, and its grams if any pattern needs them; equal keys are candidates, and the pattern's expression
decides. Patterns without literals ("*", "??*") are candidates for every path, as they must be.

Both sides carry a salt, SALTS copies of the patterns against one of each path, so that a prefix that a third of all paths
share is many tasks' work. The plan doesn't grow with the number of patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import glob_regex
from lexiforge.sources.shared import written

MOST, GRAM, SALTS = 32, 4, 16
#: A wildcard of fnmatch, a set in brackets included.
WILD = re.compile(r"\*|\?|\[!?\]?[^\]]*\]")


def anchor(pattern: str) -> tuple[str, str]:
    """The kind and the text of a pattern's anchor."""
    literals = WILD.split(pattern)
    if len(literals) == 1:
        return "exact", pattern
    prefix, suffix = literals[0][:MOST], literals[-1][-MOST:]
    if prefix or suffix:
        return ("prefix", prefix) if len(prefix) >= len(suffix) else ("suffix", suffix)
    inside = max(literals, key=len)
    return ("gram", inside[:GRAM]) if len(inside) >= GRAM else ("any", "")


def table(patterns: DataFrame) -> DataFrame:
    """pattern, kind, anchor, regex of the different patterns (column pattern), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            kinds = [anchor(p) for p in own]
            columns = [own, [k for k, _ in kinds], [a for _, a in kinds], [glob_regex(p) for p in own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["pattern", "kind", "anchor", "regex"])

    own = patterns.select("pattern").where("pattern IS NOT NULL").distinct()
    return written(own.mapInArrow(run, "pattern string, kind string, anchor string, regex string"), "patterns")


def as_table(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return table(spark.createDataFrame([(p,) for p in patterns], "pattern string"))


def matches(rows: DataFrame, patterns: DataFrame, path: str = "path") -> DataFrame:
    """path, pattern: each pair that matches, once. patterns: of table(). Null paths match nothing."""
    lengths = patterns.select("kind", F.length("anchor").alias("n")).distinct().collect()  # MOST of two kinds, and two more
    own = F.col("path")
    keys = F.array().cast("array<struct<kind:string,anchor:string>>")

    def key(kind: str, text) -> object:
        return F.struct(F.lit(kind).alias("kind"), text.alias("anchor"))

    for kind in sorted({r.kind for r in lengths}):
        sizes = F.filter(F.array(*(F.lit(r.n) for r in lengths if r.kind == kind)), lambda n: n <= F.length(own))
        if kind == "exact":
            more = F.array(key(kind, own))
        elif kind == "any":
            more = F.array(key(kind, F.lit("")))
        elif kind == "prefix":
            more = F.transform(sizes, lambda n: key("prefix", F.substr(own, F.lit(1), n)))
        elif kind == "suffix":
            more = F.transform(sizes, lambda n: key("suffix", F.right(own, n)))
        else:
            starts = F.when(F.length(own) >= GRAM, F.sequence(F.lit(1), F.length(own) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
            more = F.transform(F.array_distinct(F.transform(starts, lambda i: F.substr(own, i, F.lit(GRAM)))), lambda g: key("gram", g))
        keys = F.concat(keys, more)
    held = rows.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct()
    dealt = held.select("path", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(keys).alias("k")).select("path", "salt", "k.kind", "k.anchor")
    salted = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = dealt.join(salted, ["kind", "anchor", "salt"])
    return met.where((F.col("kind") == "exact") | F.regexp_like("path", F.col("regex"))).select("path", "pattern")
