"""Exact Kendall tau-b from value cells, without contingency cells and without pairing rows.

Tau-b needs the concordant count  C = sum over rows of the rows strictly below-left (x' < x and
y' < y), and the pairs tied in x (n1), in y (n2) and in both (n3) among a column pair's n complete rows:
D = n0 - n1 - n2 + n3 - C,  tau_b = (C - D) / sqrt((n0 - n1)(n0 - n2)).

Only the order of values matters, so no ranks are found.  ``operators.cells`` cuts each column at bounds
from a sample, which decide how even the cells are and nothing else: a value that is a bound has a closed
cell of its own, the values between two bounds share an open one.  C is split in three:

    rows in a lower x cell and a lower y cell          running sums over the grid of cells
  + rows in the same open x cell, x' < x and y' < y    one task per (x, cell), a sum each
  + rows in a lower x cell, the same open y cell, y' < y    one task per (y, cell), a sum each

The grid is counted before any shuffle.  A column's open cells serve all its pairs: its rows are sent once,
as packed arrays with what the other sides need - their values, or their cells where the column is
y.  A hot value, and a column of few values, is all closed cells, and none of its rows are sent for it.
With about sqrt(n) / ``SPREAD`` cells a column, an open cell and the grid stay small beside the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators.cells import SMALL, cell_codes, chunks, column_bounds, packed_rows, per_cell, sent_array

#: A grid with more cells than this is counted by sorting.
DENSE = 1 << 22
COUNTS = "pair int, n long, c long, n1 long, n2 long, n3 long"


def _below_left(u: np.ndarray, v: np.ndarray) -> int:
    """``below_left`` of codes from 0; bit by bit over v, so v should be the one with fewer values."""
    top = int(v.max()) + 1
    # equal u in falling order of v: an earlier, smaller v then always has a smaller u
    v = top - 1 - np.sort(u.astype(np.int64) * top + (top - 1 - v)) % top
    bits = max(1, (top - 1).bit_length())
    before = np.zeros((1 << bits) + 1, np.int64)
    before[1:] = np.cumsum(np.bincount(v, minlength=1 << bits))
    total, place = 0, np.arange(len(v))
    for bit in range(bits - 1, -1, -1):
        # rows with equal higher bits are together, in their first order: a set bit counts the clear ones before it
        one = (v >> bit & 1).astype(bool)
        ones = np.cumsum(one)
        head = v >> (bit + 1) << (bit + 1)
        start = before[head]
        earlier = ones - one - np.where(start > 0, ones[start - 1], 0)
        ahead = place - start - earlier  # clear bits before the row
        total += int(ahead[one].sum())
        if bit:
            to = np.where(one, before[head + (1 << bit)] + earlier, start + ahead)
            moved = np.empty_like(v)
            moved[to] = v
            v = moved
    return total


def _codes(x: np.ndarray) -> tuple[np.ndarray, int]:
    found, code = np.unique(x, return_inverse=True)
    return code, len(found)


def below_left(x: np.ndarray, y: np.ndarray) -> int:
    """Number of (i, j) with x[j] < x[i] and y[j] < y[i]."""
    if len(x) < 2:
        return 0
    (u, m), (v, k) = _codes(x), _codes(y)
    return _below_left(u, v) if k <= m else _below_left(v, u)


def _tied(key: np.ndarray) -> int:
    """Pairs of equal entries."""
    _, n = np.unique(key, return_counts=True)
    return int((n * (n - 1) // 2).sum())


def _near(own: np.ndarray, other: np.ndarray, as_x: bool) -> tuple[int, int, int, int]:
    """(c, n1, n2, n3) of an open cell; ``other``: values of y if the cell is one of x, else cells of x."""
    there = ~np.isnan(other) if as_x else other >= 0
    (u, m), (v, k) = _codes(own[there]), _codes(other[there])
    if not len(u):
        return 0, 0, 0, 0
    c = _below_left(u, v) if k <= m else _below_left(v, u)
    equal = u.astype(np.int64) * k + v
    if as_x:
        return c, _tied(u), 0, _tied(equal)
    return c, 0, _tied(u), _tied(equal[other[there] % 2 == 1])  # an equal x is sure in a closed cell only


def _far(cells: pd.DataFrame) -> pd.DataFrame:
    """The grid's part of a pair: lower cells, and ties of closed ones."""
    cx, cy = cells["x"].to_numpy(), cells["y"].to_numpy()
    grid = np.zeros((int(cx.max()) + 1, int(cy.max()) + 1), np.int64)
    grid[cx, cy] = cells["t"].to_numpy()
    lower = np.zeros_like(grid)
    lower[1:, 1:] = grid.cumsum(axis=0).cumsum(axis=1)[:-1, :-1]
    ties = [int((t * (t - 1) // 2).sum()) for t in (grid.sum(axis=1)[1::2], grid.sum(axis=0)[1::2], grid[1::2, 1::2])]
    return pd.DataFrame([(int(cells["pair"].iloc[0]), int(grid.sum()), int((grid * lower).sum()), *ties)], columns=["pair", "n", "c", "n1", "n2", "n3"])


def kendall_tau_b(df: DataFrame, columns: list, pairs: list[tuple[int, int]], small: int = SMALL) -> DataFrame:
    """(pair, correlation) with Kendall tau-b of the pairs of positions in ``columns`` over their complete rows; none for a pair without rows."""
    base, n = packed_rows(df, columns)
    bounds, few = column_bounds(base, n, len(columns), small)
    # the side with fewer rows in open cells is x, so that its values need not be sent
    pairs = [(b, a) if few[b] and not few[a] else (a, b) for a, b in pairs]
    width = [2 * len(b) + 1 for b in bounds]
    sides = {a: [(p, pairs[p][1] if pairs[p][0] == a else pairs[p][0], pairs[p][0] == a) for p in range(len(pairs)) if a in pairs[p]]
             for a in sorted({c for p in pairs for c in p})}
    k = len(columns)

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches, k):
            code = cell_codes(x, bounds)
            for p, (a, b) in enumerate(pairs):
                there = (code[a] >= 0) & (code[b] >= 0)
                key = code[a][there].astype(np.int64) * width[b] + code[b][there]
                if width[a] * width[b] <= DENSE:
                    t = np.bincount(key, minlength=1)
                    key = np.flatnonzero(t)
                    t = t[key]
                else:
                    key, t = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p, np.int32)), pa.array((key // width[b]).astype(np.int32)),
                                                  pa.array((key % width[b]).astype(np.int32)), pa.array(t.astype(np.int64))], ["pair", "x", "y", "t"])

    def others(a: int, x: np.ndarray, code: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
        return [x[rows, o] if as_x else sent_array(code[o][rows], width[o]) for _, o, as_x in sides[a]]

    def near(key: tuple, arrays: list[np.ndarray]) -> pd.DataFrame:
        found = [(p, 0, *_near(arrays[0], other, as_x)) for (p, _, as_x), other in zip(sides[key[0]], arrays[1:])]
        return pd.DataFrame(found, columns=["pair", "n", "c", "n1", "n2", "n3"])

    far = base.mapInArrow(grid, "pair int, x int, y int, t long").groupBy("pair", "x", "y").agg(F.sum("t").alias("t"))
    parts = far.groupBy("pair").applyInPandas(_far, COUNTS).unionByName(per_cell(base, k, bounds, list(sides), others, near, COUNTS))
    t = parts.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "c", "n1", "n2", "n3")])
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    s = 2 * F.col("c").cast("double") - (n0 - F.col("n1") - F.col("n2") + F.col("n3"))
    den = F.sqrt(n0 - F.col("n1")) * F.sqrt(n0 - F.col("n2"))
    return t.where("n > 0").select("pair", (s / F.nullif(den, F.lit(0.0))).alias("correlation"))
