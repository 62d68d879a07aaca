"""Correlations of all pairs of many columns in one scan, by masked Gram blocks.

For columns i and j only the rows count in which both have a value. With the values x (0 where missing) and the mask m
of a batch of rows, four matrix products give these rows' numbers (m'm), sums (x'm), squares ((x*x)'m) and
products (x'x) for all pairs at once. They are kept as counts, means and squared deviations, which merge without
loss when a batch, task or partition is added; a task passes on one such state, whose size depends on the number of
columns alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netsluice.operators.quantiles import _value

#: Tasks that merge the states of all scanning tasks, before one merges theirs.
MERGING = 64

#: Deviations of less than this share of the squares they were taken from are rounding: the column is constant.
_ROUNDING = 1e-13


class Moments:
    """For each pair (i, j) over the rows where both are present: their number, mean of i, squared deviations of i
    (``v``), and products of deviations (``c``)."""

    def __init__(self, size: int, data: bytes | None = None) -> None:
        state = np.zeros((4, size, size)) if data is None else np.frombuffer(data, np.float64).reshape(4, size, size)
        self.n, self.mean, self.v, self.c = state

    def data(self) -> bytes:
        return np.stack([self.n, self.mean, self.v, self.c]).tobytes()

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of rows of values, NaN where one is missing."""
        out = cls(x.shape[1])
        present = ~np.isnan(x)
        m = present.astype(np.float64)
        rows = m.sum(axis=0)
        centre = np.where(present, x, 0.0).sum(axis=0) / np.maximum(rows, 1)
        d = np.where(present, x - centre, 0.0)
        n, total, squares = m.T @ m, d.T @ m, (d * d).T @ m
        share = total / np.maximum(n, 1)
        v = squares - share * total
        v[v <= _ROUNDING * squares] = 0.0
        out.n, out.mean, out.v, out.c = n, np.where(n > 0, centre[:, None] + share, 0.0), v, d.T @ d - share * total.T
        return out

    def add(self, other: Moments) -> None:
        n = self.n + other.n
        step = other.mean - self.mean
        step[(self.n == 0) | (other.n == 0)] = 0.0
        weight = self.n * other.n / np.maximum(n, 1)
        self.mean = np.where(self.n == 0, other.mean, self.mean + step * other.n / np.maximum(n, 1))
        self.v = self.v + other.v + step * step * weight
        self.c = self.c + other.c + step * step.T * weight
        self.n = n

    def coefficients(self) -> np.ndarray:
        """Pearson's r; NaN where a value is infinite."""
        with np.errstate(invalid="ignore", divide="ignore"):
            r = self.c / np.sqrt(self.v * self.v.T)
        return np.clip(r, -1.0, 1.0)

    def constant(self) -> np.ndarray:
        """The pairs without a coefficient: at most one row, or a column is constant over the pair's rows."""
        return (self.n < 2) | (self.v == 0) | (self.v.T == 0)


def _scanned(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(size)
        for batch in batches:
            if batch.num_rows:
                state.add(Moments.of(np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)))
        yield pa.RecordBatch.from_pydict({"state": [state.data()]}, schema=_STATE)

    return run


def _merged(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(size)
        for batch in batches:
            for data in batch.column(0):
                state.add(Moments(size, data.as_py()))
        yield pa.RecordBatch.from_pydict({"state": [state.data()]}, schema=_STATE)

    return run


def _read_off(features: Sequence[str]):
    size = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                state = Moments(size, data.as_py())
                r, n, none = state.coefficients(), state.n.astype(np.int64), state.constant()
                for i, name in enumerate(features):
                    columns = [pa.array([name] * size), pa.array(features), pa.array(n[i]), pa.array(r[i], mask=none[i])]
                    yield pa.RecordBatch.from_arrays(columns, names=["feature", "other", "n", "r"])

    return run


_STATE = pa.schema([("state", pa.binary())])


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, other, n, r) for every ordered pair: rows with both values, and Pearson's coefficient over them.

    Null and NaN are missing; an infinite value makes the coefficients of its column NaN. A pair of which a
    column is constant over the pair's rows, or with fewer than two rows, has no coefficient. One scan; each task holds a state of 32 bytes per pair, and the states are merged in two steps,
    one at a time, so no task holds more than two of them.
    """
    size = len(features)
    values = df.select(*[_value(f).alias(f"x{i}") for i, f in enumerate(features)])
    states = values.mapInArrow(_scanned(size), "state binary")
    some = states.repartition(MERGING).mapInArrow(_merged(size), "state binary")
    one = some.repartition(1).mapInArrow(_merged(size), "state binary")  # MERGING rows
    return one.mapInArrow(_read_off(list(features)), "feature string, other string, n long, r double")
