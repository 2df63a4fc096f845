"""How far the sources of a language are apart, and by which terms.

Each language keeps the terms that at least MIN_DOCS of its documents use. In a group (language, source) a kept term
with `count` occurrences gets the smoothed share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the group's
occurrences of all V kept terms, and two groups differ by f = floor((p - q)^2 / (p + q)) in that term.

Count columns are deduplicated: kept terms of a language with an identical sparse vector of counts by source are one
vector with a multiplicity. Each pair of sources is evaluated once for each distinct vector, in numpy, and
multiplied; pairs of terms and sources are never written. Vectors are dealt to slices by their hash, sources of a
language into blocks of BLOCK, and a slice meets a pair of blocks at a time, so that no table of sources is sent to all
tasks or to the driver. Terms of a group are then ranked against the language as a whole.

Counting is done by the task that reads the texts, before anything moves: bytes.translate and split find the terms. A
task holds HELD counts at most and then passes them on. What grows with the corpus is a group's vocabulary, not its rows:
a hot source or term is merged where it is read.

All arithmetic is on integers: 64 bits, or Python's own where counts are too large for it.

Rows: null text, lang and source are ''. Each row is a document, whatever its doc_id. A group whose texts have no term has
N = 0, and a language without kept terms has pairs of value 0 and no terms. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm._shared import saved

MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Counts that a task holds, bytes of one text that are cut at a time, sources of a block, and counts of a slice.
HELD, CUT, BLOCK, SLICE = 400_000, 1 << 22, 256, 1 << 19
#: Numbers of one step of numpy.
STEP = 1 << 20
#: ASCII letters in lower case, other ASCII characters as blanks, all other bytes as they are.
TERMS = bytes(b if b > 127 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of CUT bytes or so."""
    raw = text.encode().translate(TERMS)
    at = 0
    while len(raw) - at > CUT:
        to = raw.find(b" ", at + CUT)
        if to < 0:
            break
        yield raw[at:to].split()
        at = to
    yield raw[at:].split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, summed up in part."""

    def flushed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_) in held.items():
            term = pa.array(list(n), pa.binary()).cast(pa.string())
            same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(term), np.int32))) for x in (lang, source)]
            counts = [pa.array(np.fromiter(x, np.int64, len(term))) for x in (n.values(), (docs_[t] for t in n))]
            yield pa.RecordBatch.from_arrays([*same, term, *counts], schema=COUNTS)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in _terms(text.as_py()):
                    n.update(terms)
                    seen.update(terms)
                docs_.update(seen)
                size += len(n) - before
                if size >= HELD:
                    yield from flushed(held)
                    size = 0
        yield from flushed(held)

    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total, entries (source, n, in order of source): the kept terms with their counts."""
    counts = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entries = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("entries")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), entries)
    return saved(terms.where(F.col("docs") >= min_docs).select("lang", "term", "total", "entries"), "kept_terms")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), n_lang, v (kept terms of the language): each group that occurs."""
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    met = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return saved(met.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "n_lang", "v"))), "groups")


def shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """p of counts (a column a source) under the sources' totals n."""
    below = n + 2 * v
    if counts.size and int(counts.max()) + 2 > (1 << 63) // SCALE - 1:
        return 1 + (SCALE * (counts.astype(object) + 2)) // below.astype(object)
    return 1 + (SCALE * (counts + 2)) // below


def _summed(p: np.ndarray, q: np.ndarray, times: np.ndarray) -> np.ndarray:
    """f of equal columns of p and q, summed over the rows, each as often as `times` says."""
    return ((p - q) ** 2 // (p + q) * times[:, None]).sum(axis=0)


def _dense(entries: pa.Array, sources: pa.Array) -> np.ndarray:
    """Counts of each vector (row) by source (column)."""
    flat, out = entries.flatten(), np.zeros((len(entries), len(sources)), np.int64)
    column = pc.index_in(flat.field(0), value_set=sources)
    there = np.asarray(column.is_valid())
    row = np.repeat(np.arange(len(entries)), np.asarray(pc.list_value_length(entries)))
    out[row[there], np.asarray(column.fill_null(0))[there]] = np.asarray(flat.field(1))[there]
    return out


def pair_values(kept: DataFrame, groups: DataFrame, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """lang, source, item, value: every ordered pair of a language's sources."""
    vectors = kept.groupBy("lang", "entries").agg(F.count("*").alias("times"))
    vectors = saved(vectors.select("lang", "entries", "times", F.xxhash64("entries").alias("h")), "vectors")
    at = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    rows = groups.withColumn("at", at).withColumn("block", F.expr(f"at div {block}"))
    members = F.array_sort(F.collect_list(F.struct("at", "source", "n")))
    blocks = saved(rows.groupBy("lang", "block", "v").agg(members.alias("m")), "blocks")
    most = blocks.agg(F.max("block")).first()[0] or 0
    slices = max(1, -(-(vectors.agg(F.sum(F.size("entries"))).first()[0] or 0) // slice_))
    left, right = (blocks.select("lang", "v", F.col("block").alias(x), F.col("m").alias(f"m_{x}")) for x in ("a", "b"))
    tiles = left.join(right.drop("v"), "lang").where("a <= b").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = vectors.withColumn("slice", F.pmod("h", F.lit(slices)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(most)).cast("long"))))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def evaluate(mine: pa.Table, tiles: pa.Table) -> pa.Table:
        out = []
        lists, times = mine.column("entries").combine_chunks(), np.asarray(mine.column("times"))
        for tile in tiles.to_pylist():
            names_a, names_b = ([x["source"] for x in tile[k]] for k in ("m_a", "m_b"))
            n_a, n_b = (np.array([x["n"] for x in tile[k]], np.int64) for k in ("m_a", "m_b"))
            same = tile["a"] == tile["b"]
            i, j = np.triu_indices(len(names_a), 1) if same else (x.ravel() for x in np.indices((len(names_a), len(names_b))))
            value = np.zeros(len(i), object)
            step = max(1, STEP // max(1, len(i), len(names_a) + len(names_b)))
            for k in range(0, len(lists), step):
                own = lists.slice(k, step)
                p = shares(_dense(own, pa.array(names_a, pa.string())), n_a, tile["v"])
                q = p if same else shares(_dense(own, pa.array(names_b, pa.string())), n_b, tile["v"])
                value += _summed(p[:, i], q[:, j], times[k : k + step])
            one, other = pa.array(names_a, pa.string()).take(pa.array(i)), pa.array(names_b, pa.string()).take(pa.array(j))
            lang, value = pa.array([tile["lang"]] * len(i), pa.string()), pa.array(value.tolist(), pa.int64())
            out += [pa.table([lang, one, other, value], schema=schema), pa.table([lang, other, one, value], schema=schema)]
        return pa.concat_tables([schema.empty_table(), *out])

    key = ["lang", "slice", "a"]
    parts = dealt.groupBy(*key).cogroup(tiles.groupBy(*key)).applyInArrow(evaluate, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(count: str, n: str) -> str:
    return f"(1 + (cast({count} + 2 AS decimal(20,0)) * {SCALE}BD) div cast({n} + 2 * v AS decimal(20,0)))"


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: terms that a group has more of, by share, than its language."""
    rows = kept.select("lang", F.col("term").alias("item"), "total", F.explode("entries").alias("e"))
    rows = rows.select("lang", "item", "total", F.col("e.source").alias("source"), F.col("e.n").alias("count"))
    met = rows.join(groups, ["lang", "source"]).selectExpr("lang", "source", "item", f"{_share('count', 'n')} AS p", f"{_share('total', 'n_lang')} AS q")
    return met.where("p > q").selectExpr("lang", "source", "item", "((p - q) * (p - q)) div (p + q) AS value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows of all other sources, `term` rows up to rank `top`."""
    kept = kept_terms(docs, min_docs)
    groups = group_totals(docs, kept)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int").alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    pairs = pair_values(kept, groups).withColumn("part", F.lit("pair")).select(*columns, rank)
    terms = term_values(kept, groups).withColumn("part", F.lit("term")).select(*columns, rank).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
