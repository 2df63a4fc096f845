"""Chunkers: folds over split text, as expressions. Nothing is shuffled and no Python runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions import text as t

NONE = "array<string>"
MARKDOWN_SIZE = 3072


def _state(out: Column, cur: Column, n: Column) -> Column:
    return F.struct(out.cast(NONE).alias("out"), cur.cast(NONE).alias("cur"), n.cast("int").alias("n"))


def _start() -> Column:
    return _state(F.array(), F.array(), F.lit(0))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tail(cur: Column, least: int) -> Column:
    """The shortest end of cur with `least` characters, or all of it."""
    start = F.struct(F.array().cast(NONE).alias("kept"), F.lit(0).alias("n"))

    def step(a, s):
        more = F.struct(F.concat(F.array(s), a["kept"]).alias("kept"), (a["n"] + F.length(s)).alias("n"))
        return F.when(a["n"] >= least, a).otherwise(more)

    return F.aggregate(F.reverse(cur), start, step, lambda a: a["kept"])


def _size(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda n, s: n + F.length(s))


def sentence_chunks(text: Column, max_size: int = 2048, min_size: int = 512, overlap: int = 128) -> Column:
    """Sentences gathered up to max_size characters (blanks between them not counted); a chunk begins with the
    end of the one before, of `overlap` characters or more. A short text is one chunk; in a longer one, chunks
    below min_size are dropped unless there is one only."""
    whole = t.strip(text)
    sentences = F.filter(F.split(whole, r"(?U)(?<=[.!?])\s+"), lambda s: s != "")

    def step(a, s):
        full = (a["n"] + F.length(s) > max_size) & (F.size(a["cur"]) > 0)
        kept = F.when(F.size(a["cur"]) > 1, _tail(a["cur"], overlap)).otherwise(F.array().cast(NONE)) if overlap > 0 else F.array().cast(NONE)
        closed = _let(kept, lambda k: _state(F.concat(a["out"], F.array(F.array_join(a["cur"], " "))), F.concat(k, F.array(s)), _size(k) + F.length(s)))
        return F.when(full, closed).otherwise(_state(a["out"], F.concat(a["cur"], F.array(s)), a["n"] + F.length(s)))

    made = F.aggregate(sentences, _start(), step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["out"]))
    kept = _let(made, lambda m: F.filter(m, lambda c: (F.length(c) >= min_size) | (F.size(m) == 1)))
    return F.when(F.length(whole) <= min_size, F.array(whole)).otherwise(kept)


def _listed(line: Column) -> Column:
    return t.strip(line).rlike(r"^([-*+]|\d+\.|\|)")


def sub_chunks(section: Column, max_size: int = MARKDOWN_SIZE) -> Column:
    """A long section in parts: no overlap, and a cut that touches a list or table moves one sentence back."""
    sentences = F.transform(F.split(section, r"(?U)(?<=[.!?])\s+(?=[A-Z0-9#*-])"), lambda s: F.regexp_replace(s, r"\n+\z", ""))
    sentences = F.filter(sentences, lambda s: ~t.is_blank(s))

    def step(a, s):
        full = (a["n"] + F.length(s) > max_size) & (F.size(a["cur"]) > 0)
        last = F.coalesce(F.try_element_at(a["cur"], F.lit(-1)), F.lit(""))
        touches = _listed(F.substring_index(last, "\n", -1)) | _listed(F.substring_index(s, "\n", 1))
        back = touches & (F.size(a["cur"]) > 1)
        head = F.when(back, F.slice(a["cur"], 1, F.greatest(F.size(a["cur"]) - 1, F.lit(0)))).otherwise(a["cur"])
        first = F.when(back, F.concat(last, F.lit(" "), s)).otherwise(s)
        closed = _state(F.concat(a["out"], F.array(F.array_join(head, " "))), F.array(first), F.length(first))
        return F.when(full, closed).otherwise(_state(a["out"], F.concat(a["cur"], F.array(s)), a["n"] + F.length(s)))

    made = F.aggregate(sentences, _start(), step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["out"]))
    return F.filter(F.transform(made, t.strip), lambda c: c != "")


def paragraph_chunks(body: Column, max_size: int = MARKDOWN_SIZE) -> Column:
    """Paragraphs (between blank lines) gathered up to max_size, their lines joined without the blank ones."""
    edges = F.regexp_replace(F.regexp_replace(body, r"\A([^\S\n]*\n)+", ""), r"(\n[^\S\n]*)+\z", "")
    paragraphs = F.filter(F.split(edges, r"\n([^\S\n]*\n)+"), lambda p: ~t.is_blank(p))

    def step(a, p):
        full = (a["n"] + F.length(p) > max_size) & (F.size(a["cur"]) > 0)
        closed = _state(F.concat(a["out"], F.array(F.array_join(a["cur"], "\n"))), F.array(p), F.length(p))
        return F.when(full, closed).otherwise(_state(a["out"], F.concat(a["cur"], F.array(p)), a["n"] + F.length(p)))

    made = F.aggregate(paragraphs, _start(), step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], "\n")))).otherwise(a["out"]))
    return F.filter(F.transform(made, t.strip), lambda c: c != "")


def text_chunks(docs: DataFrame, key: str, text: str = "text", kind: str = "paragraph", **sizes: int) -> DataFrame:
    """A row for each chunk of a text: key, chunk_index, text, offsets (running lengths), urls, summary, topics."""
    made = docs.select(key, sentence_chunks(F.col(text), **sizes).alias("chunks"))
    return positions(made, key).select(
        key, "chunk_index", F.col("chunk").alias("text"), "start_offset", "end_offset",
        t.url_contexts(F.col("chunk"), kind).alias("url_contexts"), t.url_cell(t.url_contexts(F.col("chunk"), kind)).alias("urls"),
        F.array(F.lit("Unknown")).alias("topics"), t.summary(F.col("chunk")).alias("summary"),
    )


def positions(made: DataFrame, key: str) -> DataFrame:
    """key, chunk_index, chunk, start_offset (the lengths of the chunks before), end_offset (the last character's) of each
    of a row's `chunks`. Offsets are summed inside the row: nothing moves, and rows may repeat a key."""
    none = F.array().cast("array<struct<chunk:string,start:bigint>>")

    def step(a: Column, c: Column) -> Column:
        own = F.struct(c.alias("chunk"), a["at"].alias("start"))
        return F.struct(F.array_append(a["out"], own).alias("out"), (a["at"] + F.length(c)).alias("at"))

    placed = F.aggregate("chunks", F.struct(none.alias("out"), F.lit(0).cast("long").alias("at")), step, lambda a: a["out"])
    # the outer form, as the other one is preceded by a filter that computes the chunks once more
    rows = made.select(key, F.posexplode_outer(placed).alias("chunk_index", "c")).where("c IS NOT NULL")
    return rows.select(key, "chunk_index", "c.chunk", F.col("c.start").alias("start_offset"), (F.col("c.start") + F.length("c.chunk") - 1).alias("end_offset"))


def totals(chunks: DataFrame, key: str, text: str = "chunk") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunk_count"), F.sum(F.length(text)).alias("total_tokens"))
