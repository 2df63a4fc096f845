"""Corpus profiling: lengths, index percentiles, trimmed middles, recommended settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions import text as t
from lexiforge.operators import selection
from lexiforge.operators.catalog import extension_sizes


def line_lengths(c: Column) -> Column:
    return F.transform(F.filter(t.lines(c), lambda x: ~t.is_blank(x)), F.length)


def paragraph_lengths(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, "\n\n"), lambda x: ~t.is_blank(x)), F.length)


def profiled(docs: DataFrame, key: str, text: str, size: str) -> DataFrame:
    own = docs.select(key, F.col(size).alias("size"), line_lengths(F.col(text)).alias("line_lens"), paragraph_lengths(F.col(text)).alias("para_lens"))
    return own.select("*", F.size("line_lens").alias("line_count"), F.size("para_lens").alias("para_count"))


def pooled(rows: DataFrame, lengths: str) -> DataFrame:
    return rows.select(F.explode(lengths).alias("x"))


def spread(rows: DataFrame, x: str = "x") -> DataFrame:
    """Least, greatest, mean and median, the last two cut to whole numbers."""
    counts = selection.value_counts(rows, x).where("x IS NOT NULL")
    middle_ = F.lit(selection.median(counts)).cast("double")
    total = F.sum(F.col("x").cast("decimal(38,6)") * F.col("c")).cast("double")
    return counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.floor(total / F.sum("c")).cast("long").alias("mean_x"), F.floor(middle_).cast("long").alias("median_x"),
    )


def index_percentiles(rows: DataFrame, percents: list[int], x: str = "x") -> DataFrame:
    """pct, value: the value at place least(n * pct / 100, n - 1) of all in order."""
    counts = selection.value_counts(rows, x).where("x IS NOT NULL")

    def place(n: int, p: int) -> int:
        return min(n * p // 100, n - 1)

    n, found = selection.at_places(counts, lambda n: [place(n, p) for p in percents])
    schema = T.StructType([T.StructField("pct", T.IntegerType()), T.StructField("value", rows.schema[x].dataType)])
    return rows.sparkSession.createDataFrame([(p, found[place(n, p)].value) for p in percents] if n else [], schema)


def typical(rows: DataFrame, size: str, key: str) -> DataFrame:
    """The row in the middle by size."""
    return selection.between_places(rows, size, key, lambda n: n // 2 + 1, lambda n: n // 2 + 1)


def middle(rows: DataFrame, size: str, key: str) -> DataFrame:
    """Without the smallest and the largest tenth; all rows if there are fewer than ten."""
    return selection.between_places(rows, size, key, lambda n: 1 if n < 10 else n // 10 + 1, lambda n: n if n < 10 else n - n // 10)


@dataclass
class Limits:
    max_chunk_size: int = 2048
    max_length: int = 2048
    batch_size: int = 100
    top_k: int = 75


def recommended(rows: DataFrame, para_lens: str = "para_lens", limits: Limits | None = None) -> DataFrame:
    """One row of settings from the corpus: rows is a profile, one row a file."""
    own = limits or Limits()
    median = selection.median(selection.value_counts(pooled(rows, para_lens), "x"))
    base = rows.agg(F.count("*").alias("n")).withColumn("m", F.lit(median).cast("double"))
    chunk = F.expr(f"cast(if(m IS NULL, {own.max_chunk_size}, least(greatest(floor(m * 2), 512), {own.max_chunk_size})) AS int)")
    one = base.select("n", chunk.alias("chunk_size"))
    return one.select(
        "chunk_size",
        F.expr("cast(greatest(floor(chunk_size / 2), 256) AS int)").alias("min_chunk_size"),
        F.expr("cast(greatest(floor(chunk_size * 0.2D), 128) AS int)").alias("chunk_overlap"),
        F.expr("cast(if(n = 0, 50, least(100, greatest(10, floor(n / 2)))) AS int)").alias("batch_size"),
        F.expr(f"greatest(chunk_size, {own.max_length})").alias("max_length"),
        F.expr(f"cast(least({own.batch_size}, if(n = 0, 50, least(100, greatest(10, floor(n / 2))))) AS int)").alias("embedding_batch_size"),
        F.expr(f"CASE WHEN n = 0 THEN {own.top_k} WHEN n < 1000 THEN if(chunk_size > 1500, 10, 20) WHEN n < 10000 THEN if(chunk_size > 1500, 30, 50) ELSE 75 END").alias("top_k"),
        F.expr(f"greatest(chunk_size, {own.max_length}) * 4").alias("context_window"),
    )


def _stats(title: str, rows: DataFrame) -> str:
    """One line about lengths (column x): least, mean, median, places at 80, 90 and 95 percent, greatest."""
    r = spread(rows).first()
    if not r.n:
        return f"- **{title}:** none"
    places = {p.pct: p.value for p in index_percentiles(rows, [80, 90, 95]).collect()}
    return f"- **{title}:** min={r.min_x}, mean={r.mean_x}, median={r.median_x}, " + ", ".join(f"p{k}={v}" for k, v in sorted(places.items())) + f", max={r.max_x}"


def report(rows: DataFrame, key: str | None = None, path: str | None = None, limits: Limits | None = None) -> str:
    """The recommendation as Markdown. With a path column (and a key), also what the corpus is like: files by extension,
    sizes, line and paragraph lengths, of all files, of the typical one and of the middle four fifths by size."""
    settings = recommended(rows, limits=limits).first().asDict()
    said = "# Recommended settings\n\n" + "".join(f"- `{k}`: {v}\n" for k, v in settings.items())
    if path is None:
        return said
    lines = ["# Corpus\n"]
    kinds = extension_sizes(rows, path).orderBy("extension").collect()
    sizes = spread(rows, "size").first()
    lines.append(f"- **Files:** {sum(k.n for k in kinds)}")
    lines += [f"- .{k.extension}: {k.n} file{'s' if k.n != 1 else ''}, {k.bytes} bytes, {k.smallest} to {k.largest}" for k in kinds]
    if sizes.n:
        lines.append(f"- **Size (bytes):** min={sizes.min_x}, max={sizes.max_x}, mean={sizes.mean_x}, median={sizes.median_x}")
        lines += [_stats("Line length", pooled(rows, "line_lens")), _stats("Paragraph length", pooled(rows, "para_lens"))]
        one = typical(rows, "size", key or path)
        for r in one.select(path, "size", "line_count", "para_count").collect():
            lines += ["\n## Typical file\n", f"- **Name:** {r[path]}", f"- **Size (bytes):** {r['size']}", f"- **Lines:** {r.line_count}", f"- **Paragraphs:** {r.para_count}"]
        lines += [_stats("Line length", pooled(one, "line_lens")), _stats("Paragraph length", pooled(one, "para_lens"))]
        if sizes.n >= 10:
            inner = middle(rows, "size", key or path)
            lines += ["\n## Middle four fifths by size\n", f"- **Files:** {inner.count()}", _stats("Line length", pooled(inner, "line_lens")), _stats("Paragraph length", pooled(inner, "para_lens"))]
    return "\n".join(lines) + "\n\n" + said
