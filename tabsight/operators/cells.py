"""Rows of numbers as packed arrays, and cells of values that tell their order.

A column is cut at bounds: a value equal to bound i has the closed cell 2 i + 1, the values between two
bounds share the open cell 2 i.  Cells order like the values.  The bounds come from a bounded sample
and decide only how even the cells are; results do not depend on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.session import ensure_checkpoint_dir

#: Rows of a cell that is not worth cutting; sqrt(n) / SPREAD cells a column beyond ``FEWEST`` cells.
SMALL, SPREAD, FEWEST = 2048, 128, 16
#: Numbers of a sample, and of a chunk that is worked on at a time.
SAMPLE, CHUNK = 1 << 20, 1 << 22


def packed_rows(df: DataFrame, columns: list[Column]) -> tuple[DataFrame, int]:
    """(block long, n int, x binary), saved, and the number of rows: a block of rows as one array of doubles, NaN where missing."""
    spark, k = df.sparkSession, len(columns)
    ensure_checkpoint_dir(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["n", "x"])

    # dealt out evenly: a file with one row group would otherwise be one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = df.select(*[(F.nanvl(c.cast("double"), F.lit(None).cast("double")) + F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    base = (data.repartition(parts).mapInArrow(pack, "n int, x binary")
            .select(F.monotonically_increasing_id().alias("block"), "n", "x").checkpoint(eager=True))
    return base, base.agg(F.sum("n")).first()[0] or 0


def unpacked(x: bytes, k: int) -> np.ndarray:
    return np.frombuffer(x, np.float64).reshape(-1, k)


def chunks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[np.ndarray]:
    """The rows of packed blocks, about CHUNK numbers at a time."""
    held, size = [], 0
    for b in batches:
        for x in b.column("x"):
            held.append(unpacked(x.as_py(), k))
            size += held[-1].size
            if size >= CHUNK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def column_bounds(base: DataFrame, n: int, k: int, small: int = SMALL) -> tuple[list[np.ndarray], list[bool]]:
    """The bounds of each column, and whether they are all its values in the sample."""
    share = min(1.0, max(1024, SAMPLE // k) / max(1, n))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("x"):
                x = unpacked(raw.as_py(), k)
                some = x[np.random.default_rng(crc32(raw.as_py())).random(len(x)) < share]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([some.tobytes()], pa.binary())], ["x"])

    rows = [unpacked(r["x"], k) for r in base.select("x").mapInArrow(draw, "x binary").collect()]  # about SAMPLE numbers
    sample = np.concatenate(rows) if rows else np.zeros((0, k))
    cells = max(1, ceil(min(n / small, max(FEWEST, n ** 0.5 / SPREAD))))
    bounds, few = [], []
    for c in range(k):
        v = np.sort(sample[~np.isnan(sample[:, c]), c])
        values = np.unique(v)
        few.append(len(values) <= 2 * cells + 32)
        bounds.append(values if few[-1] else np.unique(v[np.linspace(0, len(v) - 1, cells + 1).astype(np.int64)[1:-1]]))
    return bounds, few


def cell_codes(x: np.ndarray, bounds: list[np.ndarray]) -> list[np.ndarray]:
    """The cell of each value of each column, -1 where it is missing."""
    out = []
    for c, b in enumerate(bounds):
        v = x[:, c]
        at = np.searchsorted(b, v, side="left")
        closed = (b[np.minimum(at, len(b) - 1)] == v) if len(b) else np.zeros(len(v), bool)
        out.append(np.where(np.isnan(v), -1, 2 * at + closed).astype(np.int32))
    return out


def sent_array(code: np.ndarray, width: int) -> np.ndarray:
    return code.astype(np.int16 if width < 1 << 15 else np.int32)


def per_cell(base: DataFrame, k: int, bounds: list[np.ndarray], columns: list[int],
             others: Callable[[int, np.ndarray, list[np.ndarray], np.ndarray], list[np.ndarray]],
             work: Callable[[tuple, list[np.ndarray]], pd.DataFrame], schema: str) -> DataFrame:
    """``work((column, cell), [values, *others])`` over each open cell of ``columns``; ``others(column, rows, cells, places)``
    gives what is sent along with the values."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches, k):
            code = cell_codes(x, bounds)
            for a in columns:
                rows = np.flatnonzero((code[a] >= 0) & (code[a] % 2 == 0))
                rows = rows[np.argsort(code[a][rows], kind="stable")]
                own = code[a][rows]
                arrays = [x[rows, a], *others(a, x, code, rows)]
                edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
                for s, e in zip(edge, np.append(edge[1:], len(own))):
                    yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([own[s]], pa.int32()),
                                                      pa.array([[v[s:e].tobytes() for v in arrays]], pa.list_(pa.binary())),
                                                      pa.array([[v.dtype.str for v in arrays]], pa.list_(pa.string()))], ["a", "cell", "x", "kind"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = pdf["kind"].iloc[0]
        return work(key, [np.concatenate([np.frombuffer(x[i], kinds[i]) for x in pdf["x"]]) for i in range(len(kinds))])

    sent = base.select("x").mapInArrow(send, "a int, cell int, x array<binary>, kind array<string>")
    return sent.groupBy("a", "cell").applyInPandas(run, schema)
