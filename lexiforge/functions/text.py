"""Text expressions, all of them inside the JVM."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING_ARRAY = "array<string>"

# The patterns that define URLs, hashtags and section numbers.
URL_TEXT = r"""(https?://[^\s)'"<>]+|ftp://[^\s)'"<>]+)"""
URL_CSV = r"""(https?://[^\s)\]'"<>]+|ftp://[^\s)\]'"<>]+)"""
URL_LINK = r"\[[^\]]+\]\(([^)\s]+)\)"
URL_CAPTION = r"https?://[\w\.-]+(?:/[\w\.-]*)*"
HASHTAG = r"(?U)(?<!#)(?<!\w)#([A-Za-z0-9_-]+)\b"


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def lines(c: Column) -> Column:
    """All line ends count, and the end of the last line starts no other one."""
    parts = F.split(c, r"\R")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def summary(c: Column) -> Column:
    """What precedes the first ". "; if that has fewer than five words, the first twenty words."""
    head = F.substring_index(c, ". ", 1)
    return strip(F.when(word_count(head) < 5, F.array_join(F.slice(words(c), 1, 20), " ")).otherwise(head))


def urls(c: Column, pattern: str = URL_TEXT) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0 if pattern == URL_CAPTION else 1))


def url_contexts(c: Column, kind: str) -> Column:
    """URLs in order with where they stand: paragraph, cell, or (markdown) markdown_link and raw_url."""

    def tagged(found: Column, context: str) -> Column:
        return F.transform(found, lambda u: F.struct(u.alias("url"), F.lit(context).alias("context")))

    if kind == "markdown":
        return F.concat(tagged(urls(c, URL_LINK), "markdown_link"), tagged(urls(c, URL_CSV), "raw_url"))
    return tagged(urls(c, URL_CSV if kind == "cell" else URL_TEXT), kind)


def url_cell(contexts: Column) -> Column:
    return csv_cell(F.array_sort(F.array_distinct(F.transform(contexts, lambda x: x["url"]))))


def hashtags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(HASHTAG), F.lit(1)))


def csv_cell(items: Column) -> Column:
    """The items as one CSV record with minimal quoting; none give an empty string."""
    quoted = F.transform(items, lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x))
    return F.when((F.size(items) == 1) & (items[0] == ""), F.lit('""')).otherwise(strip(F.array_join(quoted, ",")))


def split_csv(c: Column) -> Column:
    """Comma-separated items, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def extension(path: Column) -> Column:
    """The lower-case suffix of a path's last part; a leading or a trailing dot makes none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_regex(pattern: str) -> str:
    return "^" + re.sub(r"\\[zZ]$", r"\\z", fnmatch.translate(pattern))


def glob(c: Column, pattern: str) -> Column:
    """fnmatch: * crosses slashes and case counts. Plain prefixes and suffixes become predicates a scan can use."""
    if not re.search(r"[*?\[]", pattern):
        return c == pattern
    body = pattern[:-1] if pattern.endswith("*") else pattern[1:] if pattern.startswith("*") else None
    if body is not None and not re.search(r"[*?\[]", body):
        return c.startswith(body) if pattern.endswith("*") else c.endswith(body)
    return c.rlike(glob_regex(pattern))


def any_glob(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | glob(c, p)
    return out


def redacted(key: Column) -> Column:
    return F.concat(F.substring(key, 1, 4), F.lit("..."), F.substring(key, -4, 4))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 3).cast("int"))


def reply_items(reply: Column, allowed: Column | None = None) -> Column:
    """The items of a model's comma-separated reply; none if it looks like a dump of the reply object."""
    # Marks of such a dump.
    marks = ["=", "None", "candidates=", "usage_metadata=", "prompt_token_count", "response_id", "model_version"]
    bad = reply.isNull()
    for m in marks:
        bad = bad | reply.contains(m)
    body = F.regexp_replace(strip(reply), r"^[\[\]]+|[\[\]]+$", "")
    items = F.transform(F.split(body, ","), lambda x: F.regexp_replace(strip(x), r"""^["']+|["']+$""", ""))
    items = F.array_distinct(F.filter(items, lambda x: x != ""))
    if allowed is not None:
        items = F.array_intersect(items, allowed)
    return F.when(bad, F.array().cast(STRING_ARRAY)).otherwise(items)


def pdf_cleanup(c: Column) -> Column:
    """Hyphenated line ends joined, single line ends made blanks, runs of blanks made one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(\w)-\n(\w)", "$1$2"), r"(?<!\n)\n(?!\n)", " "), " +", " ")
