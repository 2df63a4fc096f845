"""Distances between array columns, in double precision, and between matrices with the same sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs whose exact distances are computed at once.
PAIRS = 1 << 16


def dot(a: Column, b: Column) -> Column:
    if_same = F.when(F.size(a) == F.size(b), F.lit(0.0)).otherwise(F.raise_error(F.lit("vectors differ in width")).cast("double"))
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, if_same, lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Smaller is nearer: 1 - cosine, squared l2, or 1 - inner product."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "ip":
        return 1 - dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def _sum(terms) -> np.ndarray:
    """Terms added one by one, as `aggregate` adds them."""
    total = 0.0
    for x in terms:
        total = total + x
    return total


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """`distance` of rows of a and b (vectors of equal width, finite), to the last bit."""
    if metric == "l2":
        return _sum((x - y) ** 2 for x, y in zip(a.T, b.T, strict=True))
    dots = _sum(x * y for x, y in zip(a.T, b.T, strict=True))
    if metric == "ip":
        return 1 - dots
    size = np.sqrt(_sum(x * x for x in a.T)) * np.sqrt(_sum(y * y for y in b.T))
    return 1 - np.divide(dots, size, out=np.zeros_like(dots), where=size != 0)


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k nearest rows, ties by place: places of queries, places of rows, distances.

    Equal vectors count once, with k places at most. Of these, a product of matrices chooses those that can be among the k,
    with room for its rounding, and their exact distances decide.
    """
    if metric not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown metric {metric!r}")
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(rows) or not len(queries):
        return empty
    raw = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, first, own = np.unique(raw, return_index=True, return_inverse=True)
    places = np.argsort(own, kind="stable")  # of equal vectors together, in order
    start = np.searchsorted(own[places], np.arange(len(first)))
    count = np.minimum(np.diff(np.append(start, len(rows))), k)
    x = rows[first]
    squares, sizes = (x * x).sum(axis=1), np.linalg.norm(x, axis=1)
    unit = x / np.where(sizes > 0, sizes, 1.0)[:, None]
    out = []
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        lengths = np.linalg.norm(q, axis=1)
        if metric == "cosine":
            far = -((q / np.where(lengths > 0, lengths, 1.0)[:, None]) @ unit.T)
            room = np.full(len(q), 1e-9)
        elif metric == "ip":
            far, room = -(q @ x.T), 1e-12 * (1 + lengths * sizes.max())
        else:
            far = squares - 2 * (q @ x.T)
            room = 1e-12 * (1 + (lengths + sizes.max()) ** 2)
        last = np.partition(far, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        i, j = np.nonzero(far <= (last + room)[:, None])
        distance = np.concatenate([exact(x[j[c : c + PAIRS]], q[i[c : c + PAIRS]], metric) for c in range(0, len(i), PAIRS)])
        n = count[j]
        each = np.repeat(np.arange(len(j)), n)
        place = places[np.repeat(start[j], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
        asked, distance = i[each], distance[each]
        order = np.lexsort((place, distance, asked))
        asked, place, distance = asked[order], place[order], distance[order]
        kept = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
        out.append((asked[kept] + at, place[kept], distance[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))
