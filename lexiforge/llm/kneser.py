"""Quality classifier: an interpolated modified Kneser-Ney model of characters, by per-document perplexity.

The alphabet is open: a symbol is a code point as it stands, and the n-grams of `ORDER` symbols grow with all
trusted text. Tasks count the n-grams of trusted texts, and counts add up by n-gram. Count tables are sharded by
n-gram or context and joined as DataFrames: a lower order counts the different n-grams that end alike
(continuation counts); discounts for counts of one, two and three or more come from counts of counts; each order's
probabilities join its contexts' totals and the next lower order's probabilities. Below order one, all symbols
seen and an unseen one are alike.

Documents meet the tables in one of two ways, which give the same scores. Tables of `SENT_ROWS` rows or fewer in all
are sent to the documents' tasks, each of which looks up the different n-grams of many texts at once. Larger ones
stay sharded: each text's n-grams are counted, the corpus' different ones join the tables, order by order, and
these probabilities join the texts' counts.

Trusted texts are all those of quality 1 that aren't toxic: four fifths train, the others calibrate. A
document's entropy is drawn toward its language's mean by `PRIOR` symbols, so that a short text needs evidence
too. A document stays if its perplexity is at most its language's `QUANTILE` among the calibrating texts
(languages without any: among all of them; if there are none, every text with a symbol stays). Quantiles come
from counts of entropies in steps of 1 / `STEPS`, rounded up, so that no language's texts meet in one task.
The ids of trusted texts are sent to the documents up to `SENT_IDS` of them, and beyond that both are shuffled.

A null or empty text has no perplexity and goes. Null and repeated ids are scored as any; a doc_id with
several labels is trusted if all of them agree. Extra columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm._shared import saved

ORDER = 5
QUANTILE = 0.995
PRIOR = 100.0
#: Characters that are looked at together.
PIECE = 1 << 20
STEPS = 10_000
#: Ids of 8 bytes that are sent to every task at most.
SENT_IDS = 1_000_000
#: Rows of the model's tables that are sent to every task at most; 12 bytes each.
SENT_ROWS = 5_000_000
START = "\n" * (ORDER - 1)
#: A random odd number for each order and place: the key of an n-gram is the sum of its symbols times these.
MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 63, (ORDER + 1, ORDER), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of texts laid end to end, where in them n-grams end, and whose they are; about PIECE at a time.

    Each text begins after START; a long one goes on in the next piece after its own last symbols.
    """
    held, size = [], 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for _, x in held])
        points = np.frombuffer("".join(x for _, x in held).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        first = np.cumsum(lengths) - lengths
        ends = np.ones(len(points), bool)
        for k in range(ORDER - 1):
            ends[first + k] = False
        ends = np.flatnonzero(ends)
        whose = np.repeat(np.array([i for i, _ in held]), lengths - (ORDER - 1))
        return points, ends, whose

    for i, text in enumerate(texts):
        text = START + (text or "")
        for at in range(ORDER - 1, len(text), PIECE):
            part = text[at - ORDER + 1 : at + PIECE]
            held.append((i, part))
            size += len(part)
            if size >= PIECE:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def keys_at(points: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Keys of the n-grams of an order that end at ends."""
    out = np.zeros(len(ends), np.uint64)
    for k in range(order):
        out += points[ends - (order - 1) + k] * MULTIPLIERS[order, k]
    return out


def text_grams(points: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different n-grams that end at ends, their counts, and which one ends at each."""
    _, first, which, count = np.unique(keys_at(points, ends, ORDER), return_index=True, return_inverse=True, return_counts=True)
    at = ends[first]
    flat = np.stack([points[at - (ORDER - 1) + k] for k in range(ORDER)], axis=1).astype("<u4").tobytes().decode("utf-32-le", "replace")
    return [flat[k : k + ORDER] for k in range(0, len(flat), ORDER)], count, which


def gram_counts(texts: DataFrame) -> DataFrame:
    """g, c: the count of each n-gram in the one column of texts, added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for points, ends, _ in pieces(batch.column(0).to_pylist()):
                grams, count, _ = text_grams(points, ends)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(count, pa.int64())], names=["g", "c"])

    return texts.mapInArrow(run, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> list[float]:
    """For counts of one, two, three or more, from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(x, 0.1), k + 0.9) for k, x in enumerate(raw)]


def probabilities(counts: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], float]:
    """For orders 1 to ORDER, (g, p) of the n-grams seen and (ctx, gamma) of their contexts; the least probability."""
    tables = {ORDER: saved(counts, "counts")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = saved(tables[k + 1].groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c")), "counts")
    floor = 1 / (tables[1].count() + 1)
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, ORDER + 1):
        own = tables[k].withColumn("ctx", F.expr(f"substring(g, 1, {k - 1})"))
        n = own.agg(*(F.coalesce(F.sum(F.expr(f"if(c = {i}, 1, 0)")), F.lit(0)) for i in (1, 2, 3, 4))).first()
        d = discounts(list(n))
        cut = f"CASE c WHEN 1 THEN {d[0]!r}D WHEN 2 THEN {d[1]!r}D ELSE {d[2]!r}D END"
        contexts = own.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(F.expr(f"least(c, {cut})")).alias("freed"))
        contexts = contexts.selectExpr("ctx", "total", "freed / total AS gamma")
        joined = own.join(contexts, "ctx")
        if k == 1:
            lower = joined.withColumn("low", F.lit(floor))
        else:
            low = out[-1][0].select(F.col("g").alias("s"), F.col("p").alias("low"))
            lower = joined.join(low, F.expr("substring(g, 2)") == F.col("s"))
        out.append((saved(lower.selectExpr("g", f"greatest(c - {cut}, 0D) / total + gamma * low AS p"), "grams"), saved(contexts.select("ctx", "gamma"), "contexts")))
    return out, floor


# --- scores, from tables that are sent ----------------------------------------------------------------------


def _keyed(rows: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of n-grams (first column) and the logarithms of their numbers (second)."""
    flat = np.frombuffer("".join(rows.column(0).to_pylist()).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    keys = keys_at(flat, np.arange(order - 1, len(flat), order), order) if order else np.zeros(rows.num_rows, np.uint64)
    place = np.argsort(keys)
    return keys[place], np.log(rows.column(1).to_numpy()[place]).astype(np.float32)


class Model:
    """The tables as sorted keys; SENT_ROWS rows at most come to the driver."""

    def __init__(self, parts: list[tuple[DataFrame, DataFrame]], floor: float):
        self.seen = [_keyed(seen.toArrow(), k) for k, (seen, _) in enumerate(parts, 1)]
        self.contexts = [_keyed(contexts.toArrow(), k) for k, (_, contexts) in enumerate(parts)]
        self.floor = float(np.log(floor))

    def logs(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The logarithm of the probability of the symbol at each place, after those before it."""
        out, left = np.zeros(len(at)), np.arange(len(at))
        for order in range(ORDER, 0, -1):
            keys, logs = self.seen[order - 1]
            hit, value = _found(keys, logs, keys_at(points, at[left], order))
            out[left[hit]] += value[hit]
            left = left[~hit]
            if not len(left):
                break
            keys, logs = self.contexts[order - 1]
            _, value = _found(keys, logs, keys_at(points, at[left] - 1, order - 1))
            out[left] += value  # a context that wasn't seen passes all on
        out[left] += self.floor
        return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], 0.0)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n (symbols), nll (their negative log probability)."""
    source = docs.select("doc_id", "lang", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = source.drop("text").schema.add("n", "long").add("nll", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nll = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for points, ends, whose in pieces(batch.column(2).to_pylist()):
                _, first, which = np.unique(keys_at(points, ends, ORDER), return_index=True, return_inverse=True)
                n += np.bincount(whose, minlength=len(n))
                nll -= np.bincount(whose, sent.value.logs(points, ends[first])[which], minlength=len(n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n), pa.array(nll)], names=schema.names)

    return source.mapInArrow(run, schema)


# --- scores, from tables that stay sharded -----------------------------------------------------------------


def joined_scores(docs: DataFrame, parts: list[tuple[DataFrame, DataFrame]], floor: float) -> DataFrame:
    """The same columns. A text's n-grams are kept by the text's MD5, so that equal texts are scored once."""
    source = docs.select("doc_id", "lang", F.md5("text").alias("t"), F.char_length("text").cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, text in zip(batch.column(0), batch.column(1), strict=True):
                for points, ends, _ in pieces([text.as_py()]):
                    grams, count, _ = text_grams(points, ends)
                    yield pa.RecordBatch.from_arrays([pa.array([t.as_py()] * len(grams)), pa.array(grams), pa.array(count)], names=["t", "g", "c"])

    texts = docs.select(F.md5("text").alias("t"), "text").where("text <> ''").dropDuplicates(["t"])
    own = saved(texts.mapInArrow(run, "t string, g string, c long").groupBy("t", "g").agg(F.sum("c").alias("c")), "text_grams")
    left, known = own.select("g").distinct().select("g", F.col("g").alias("s"), F.lit(0.0).alias("log")), None
    for k in range(ORDER, 0, -1):
        seen, contexts = parts[k - 1]
        met = saved(left.join(seen.select(F.col("g").alias("s"), "p"), "s", "left"), "met")
        done = met.where("p IS NOT NULL").select("g", F.expr("log + ln(p)").alias("log"))
        known = done if known is None else known.union(done)
        passed = met.where("p IS NULL").withColumn("ctx", F.expr(f"substring(s, 1, {k - 1})")).join(contexts, "ctx", "left")
        left = saved(passed.select("g", F.expr("substring(s, 2)").alias("s"), F.expr("log + coalesce(ln(gamma), 0D)").alias("log")), "left")
    known = saved(known.union(left.select("g", F.col("log") + float(np.log(floor)))), "logs")
    sums = saved(own.join(known, "g").groupBy("t").agg(F.sum(F.expr("-c * log")).alias("nll")), "sums")
    rows = source.join(sums, "t", "left")
    return rows.select("doc_id", "lang", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("nll", F.lit(0.0)).alias("nll"))


def _of(docs: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """The rows of docs whose doc_id is one of ids (__id)."""
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("__id"), "left_semi")


def _quantile(steps: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """by, bound: the least step up to which a share of `quantile` of the rows counted lies. steps: by, step, c."""
    counts = steps.groupBy(*by, "step").agg(F.sum("c").alias("c"))
    ordered, whole = W.partitionBy(*by).orderBy("step"), W.partitionBy(*by)  # some 10 * STEPS rows of a language at most
    ranked = counts.select(*by, "step", F.sum("c").over(ordered).alias("upto"), F.sum("c").over(whole).alias("all"))
    least = ranked.where(f"upto >= {quantile!r}D * all").groupBy(*by).agg(F.min("step").alias("step")).where("step IS NOT NULL")
    return least.select(*by, F.expr(f"exp(step / {STEPS}D)").alias("bound"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept."""
    trusted = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0")
    trusted = saved(trusted.selectExpr("doc_id AS __id", "crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 AS __cal"), "trusted")
    few = trusted.count() <= SENT_IDS
    train = _of(docs, trusted.where("NOT __cal"), few)
    parts, floor = probabilities(gram_counts(train.select("text")))
    small = sum(t.count() for pair in parts for t in pair) <= SENT_ROWS
    got = saved(scores(docs, Model(parts, floor)) if small else joined_scores(docs, parts, floor), "scores")
    cal = _of(got, trusted.where("__cal"), few).where("n > 0")
    means = saved(cal.groupBy("lang").agg(F.sum("nll").alias("s"), F.sum("n").alias("m")), "means")
    whole = means.agg(F.sum("s"), F.sum("m")).first()
    mean = whole[0] / whole[1] if whole[1] else 0.0
    drawn = f"(nll + {PRIOR!r}D * coalesce(s / m, {mean!r}D)) / (n + {PRIOR!r}D)"
    near = means.withColumnRenamed("lang", "__lang")
    step = F.expr(f"cast(ceil({drawn} * {STEPS}) AS bigint)").alias("step")
    steps = cal.join(near, F.col("lang").eqNullSafe(F.col("__lang"))).select("lang", step).groupBy("lang", "step").agg(F.count("*").alias("c"))
    steps = saved(steps, "calibration")
    bound = _quantile(steps, [], quantile).first()
    limits = near.join(_quantile(steps, ["lang"], quantile), F.col("__lang").eqNullSafe(F.col("lang"))).select("__lang", "s", "m", "bound")
    rows = got.join(saved(limits, "limits"), F.col("lang").eqNullSafe(F.col("__lang")), "left")
    bound = F.coalesce("bound", F.lit(float("inf") if bound is None else bound[0]))
    rows = rows.select("doc_id", "lang", F.col("n").alias("n_chars"), F.expr(f"if(n > 0, exp({drawn}), NULL)").alias("perplexity"), bound.alias("threshold"))
    return rows.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
