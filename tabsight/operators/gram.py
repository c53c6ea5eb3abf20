"""Pairwise-complete second moments of many columns from one scan.

For columns i and j, over the rows where both have a number: how many, the means, the
sums of squared deviations and the co-deviation. An Arrow batch gives all of them as
products of masked matrices (``X'X`` and relatives), so no row is emitted per pair.
Batches are centred on their own first values and combined by the parallel update of
means and co-deviations, so a mean far from the spread costs no more than its own resolution. A task
returns one row of k x k matrices; these are combined in two steps, first into as many as
there are cores and then into one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the squared spread below which a pair's deviation is recomputed exactly.
NOISE = 1e-9
STATE = "part int, state binary"


class Moments:
    """``n`` and ``co`` are symmetric; ``mean[i, j]`` and ``dev[i, j]`` belong to column i over the rows of the pair."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, dev: np.ndarray, co: np.ndarray):
        self.n, self.mean, self.dev, self.co = n, mean, dev, co

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Moments of a matrix of rows; NaN is missing."""
        rows, k = x.shape
        there = ~np.isnan(x)
        first = x[there.argmax(axis=0), np.arange(k)] if rows else np.zeros(k)
        first = np.where(there.any(axis=0), first, 0.0) if rows else first
        d = np.where(there, x - first, 0.0)
        if there.all():
            n = np.full((k, k), float(rows))
            total, squares = np.repeat(d.sum(axis=0)[:, None], k, 1), np.repeat((d * d).sum(axis=0)[:, None], k, 1)
        else:
            m = there.astype(np.float64)
            n, total, squares = m.T @ m, d.T @ m, (d * d).T @ m
        off = total / np.maximum(n, 1)
        dev = squares - n * off * off
        co = d.T @ d - n * off * off.T
        # what is left of a large common offset is noise
        for i, j in zip(*np.nonzero((dev < NOISE * squares) & (squares > 0))):
            both = there[:, i] & there[:, j]
            a, b = x[both, i], x[both, j]
            a, b = a - a[0], b - b[0]
            a, b = a - a.mean(), b - b.mean()
            dev[i, j] = 0.0 if x[both, i].min() == x[both, i].max() else (a * a).sum()
            co[i, j] = co[j, i] = (a * b).sum()
        return cls(n, first[:, None] + off, np.maximum(dev, 0.0), co)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        step = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        weight = self.n * other.n / np.maximum(n, 1)
        mean = np.where(self.n > 0, self.mean + step * other.n / np.maximum(n, 1), other.mean)
        return Moments(n, mean, self.dev + other.dev + weight * step * step, self.co + other.co + weight * step * step.T)

    def correlation(self) -> np.ndarray:
        """r of every pair; NaN where a column is constant over the rows of the pair."""
        scale = np.sqrt(self.dev) * np.sqrt(self.dev.T)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(scale > 0, np.clip(self.co / scale, -1.0, 1.0), np.nan)

    def packed(self) -> bytes:
        return np.stack([self.n, self.mean, self.dev, self.co]).tobytes()

    @classmethod
    def unpacked(cls, state: bytes) -> Moments:
        flat = np.frombuffer(state)
        k = int(np.sqrt(len(flat) // 4))
        return cls(*flat.reshape(4, k, k))


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    total = None
    for s in rows["state"]:
        total = Moments.unpacked(s) if total is None else total + Moments.unpacked(s)
    return pd.DataFrame({"part": [0], "state": [total.packed()]})


def pair_moments(df: DataFrame, columns: list) -> DataFrame:
    """One row (part, state) with the packed ``Moments`` of ``columns`` (Column expressions); none for no partitions."""
    data = df.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    tasks = max(1, data.sparkSession.sparkContext.defaultParallelism)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = Moments.of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
                total = own if total is None else total + own
        if total is not None:
            group = TaskContext.get().partitionId() % tasks
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total.packed()], pa.binary())], ["part", "state"])

    some = data.mapInArrow(partial, STATE).groupBy("part").applyInPandas(_merged, STATE)
    return some.groupBy().applyInPandas(_merged, STATE)


def correlations(df: DataFrame, columns: list, pairs: list[tuple[int, int]]) -> DataFrame:
    """(pair, correlation) for positions ``pairs`` of ``columns``; NULL where undefined."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for state in rows["state"]:
                r = Moments.unpacked(state).correlation()
                yield pd.DataFrame({"pair": np.arange(len(pairs), dtype=np.int32), "correlation": [r[p] for p in pairs]})

    return pair_moments(df, columns).mapInPandas(read, "pair int, correlation double").withColumn(
        "correlation", F.nanvl("correlation", F.lit(None).cast("double")))
