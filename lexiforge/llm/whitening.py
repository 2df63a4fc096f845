"""Whitening of embeddings by the leading components of their covariance.

Entries are put on a grid of whole numbers, x = floor(SCALE c) + SHIFT, so that equal vectors are equal exactly and
sums are exact. The fit takes each different x-vector once. A randomised range finder starts from a random
subspace, wider than the components asked for by OVERSAMPLE; each pass over all centred rows of the fit
list takes the basis Q to VQ, without a covariance on the way, and Rayleigh-Ritz in the span of Q gives components and
their residuals |Vu - eu|. A basis whose residuals fail is replaced by the orthonormalised VQ (a power pass), and
after PASSES of those the subspace is doubled, up to the full dimension, where Rayleigh-Ritz is exact. Flat spectra end there.

Centring is (n x - S) / n with a whole numerator: the shift cancels before anything is rounded. A task multiplies
batch by batch and returns one row for each row of its partial product; those are summed up, in the order of tasks, by
row. The driver gets sums of dimension x width numbers, whose size depends on no number of rows.

Rows: those whose vector is null, empty, or holds a null, a non-finite entry, or one too large for exact sums
(|SCALE c| over 2^52) are left out, as are vectors whose width isn't the one that most rows have (of equals the
smallest). Repeated rows and null or repeated ids stay as they are. A component without variance has null
whitened values, and where there is no variance at all, explained is null. A deviation of more than 38 digits is null. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm._shared import saved

COMPONENTS, OVERSAMPLE, PASSES, SEED = 16, 10, 3, 20
#: Fixed values of the grid.
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 52)
#: The first deviation that is too large for a decimal.
MOST = 10**38
#: Numbers of a batch that are worked on at once.
STEP = 1 << 21


def gridded(rows: DataFrame, vector: str, width: int | None = None) -> DataFrame:
    """rows that have a vector of finite entries (of the width), with `x`, its whole numbers."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * SCALE) > LARGEST))
    kept = rows.where(F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.coalesce(odd, F.lit(True)))
    if width is not None:
        kept = kept.where(F.size(vector) == width)
    return kept.withColumn("x", F.transform(entries, lambda c: F.floor(c * SCALE) + F.lit(SHIFT)))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches, cut to STEP numbers at most, with their vectors (column x) as a matrix of whole numbers."""
    for batch in batches:
        step = max(1, STEP // width)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, np.asarray(part.column("x").flatten()).reshape(-1, width)


@dataclass
class Centre:
    n: int
    sums: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, whole: 64 bits, or Python's integers where they could be too large."""
        if self.n * (2 * LARGEST) < 2.0**62 or self.n * float(np.abs(x).max(initial=0)) + float(np.abs(self.sums).max(initial=0)) < 2.0**62:
            return self.n * x - self.sums
        return self.n * x.astype(object) - self.sums.astype(object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once."""
        return (self.scaled(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2, exact."""
        own = self.scaled(x)
        if own.dtype == object or x.shape[1] * float(np.abs(own).max(initial=0)) ** 2 >= 2.0**62:
            own = own.astype(object)
        return [int(v) for v in (own * own).sum(axis=1)]


def centre(fit: DataFrame) -> Centre:
    """The number of vectors, and the sum of each dimension."""
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    rows = sums.orderBy("i").collect()
    whole = [int(r.s) for r in rows]
    large = any(abs(s) >= 1 << 62 for s in whole)
    return Centre(rows[0].n, np.array(whole, object if large else np.int64))


def summed(fit: DataFrame, width: int, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of product(block) over all blocks of the fit list's vectors; products have one shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, width):
            own = product(x)
            total = own if total is None else total + own
        if total is not None:
            part = np.full(len(total), TaskContext.get().partitionId(), np.int32)
            columns = [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(part), pa.array(list(total), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "part", "sums"])

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "sums": [np.stack(rows.sort_values("part")["sums"].to_list()).sum(axis=0)]})

    parts = fit.select("x").mapInArrow(run, "i int, part int, sums array<double>")
    rows = parts.groupBy("i").applyInPandas(total, "i int, sums array<double>").collect()
    return np.array([r.sums for r in sorted(rows, key=lambda r: r.i)])


@dataclass
class Components:
    centre: Centre
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    trace: float
    width: int
    passes: int

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the square root of the variance; nan where there is none."""
        floor = np.finfo(float).eps * len(self.vectors) * max(self.values[0], 0.0)
        scale = np.array([1 / np.sqrt(e) if e > floor else np.nan for e in self.values])
        return self.centre.rows(x) @ self.vectors * scale


def components(fit: DataFrame, width: int, most: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = SEED) -> Components:
    """The leading components of the covariance of the fit list (x: vectors of whole numbers, not empty)."""
    at, rng = centre(fit), np.random.default_rng(seed)
    most = min(most, width)
    trace = float(summed(fit, width, lambda x: np.array([[(at.rows(x) ** 2).sum()]]))[0, 0]) / at.n

    def applied(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = at.rows(x)
            return c.T @ (c @ q)

        return summed(fit, width, product) / at.n

    held, done, count = min(width, most + oversample), 0, 0
    basis = np.linalg.qr(rng.standard_normal((width, held)))[0]
    while True:
        full = held == width
        if full:
            basis = np.eye(width)
        image = applied(basis)
        count += 1
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:most]
        values, turn = values[order], turn[:, order]
        vectors = basis @ turn
        residual = np.linalg.norm(image @ turn - vectors * values, axis=0).max()
        if full or residual <= 16 * np.finfo(float).eps * max(values[0], 0.0):
            return Components(at, values, vectors, trace, width, count)
        done += 1
        if done > passes:
            held, done = min(width, 2 * held), 0
            image = np.hstack([image, rng.standard_normal((width, held - image.shape[1]))])
        basis = np.linalg.qr(image)[0]


def identity_error(fit: DataFrame, found: Components) -> float:
    """The largest entry by which the covariance of the whitened fit list is off the identity, over the
    components that have variance. Rows are centred before they are projected, so their mean is 0 already."""
    there = ~np.isnan(found.whitened(np.zeros((1, found.width), np.int64))[0])

    def product(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x)[:, there]
        return w.T @ w

    if not there.any():
        return 0.0
    return float(np.abs(summed(fit, found.width, product) / found.centre.n - np.eye(there.sum())).max())


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation (decimal), whitened, explained, identity_error: each row by each component."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    own = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    widths = gridded(own, "vector").groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    usual = widths.orderBy(F.desc("n"), "width").first()
    if usual is None:
        return rows.sparkSession.createDataFrame([], schema)
    width = usual.width
    kept = gridded(own, "vector", width)
    fit = saved(kept.select("x").distinct(), "fit")
    found = components(fit, width, most)
    error = identity_error(fit, found)
    n = len(found.values)
    explained = pa.array(found.values / found.trace if found.trace > 0 else [None] * n, pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, width):
            w = found.whitened(x).ravel()
            row, component = np.repeat(np.arange(len(x)), n), np.tile(np.arange(n), len(x))
            exact = [Decimal(d) if d < MOST else None for d in found.centre.deviations(x)]
            deviation = pa.array(exact, pa.decimal128(38, 0))
            columns = [
                part.column("key").take(pa.array(row)), pa.array(component + 1, pa.int32()), pa.array(np.full(len(row), found.centre.n, np.int64)),
                deviation.take(pa.array(row)), pa.array(w, mask=np.isnan(w)), explained.take(pa.array(component)), pa.array(np.full(len(row), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.select("key", "x").mapInArrow(run, schema)
