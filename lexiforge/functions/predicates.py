"""Metadata filters: {field: value} and {field: {$gt: ...}} compiled to one column, which scans can push down."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.functions.text import split_csv, strip

COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def where(spec: dict[str, Any] | None) -> Column:
    if not spec:
        return F.lit(True)
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            own = [where(x) for x in value]
            parts.append(reduce(lambda a, b: a & b if key == "$and" else a | b, own))  # noqa: B023
        elif isinstance(value, dict):
            for op, v in value.items():
                if op not in COMPARE:
                    raise ValueError(f"unknown operator {op!r}")
                parts.append(COMPARE[op](F.col(key), v))
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts)


def metadata_contains(metadata: Column, needle: str) -> Column:
    """A map of strings: some value holds the needle, whatever the case; `tags` also match item by item."""
    n = F.lower(strip(F.lit(needle)))
    others = F.map_filter(metadata, lambda k, v: (k != "tags") & v.isNotNull())
    tags = F.coalesce(F.array_contains(F.transform(split_csv(metadata["tags"]), lambda t: F.lower(t)), n), F.lit(False))
    return tags | F.exists(F.map_values(others), lambda v: F.contains(F.lower(v), n))


def tags_match(tags_lower: Column, keywords: list[str]) -> Column:
    if not keywords:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(tags_lower, F.array(*(F.lit(k.lower()) for k in sorted(keywords)))), F.lit(False))
