"""Exact quantiles (linear interpolation) without a value map or a sort of all values.

Spark's exact ``percentile`` merges a value -> count map per group in one task.  Two
algorithms take its place, one per question:

* ``quantiles`` - of whole columns, by radix selection.  A double's bits, read as an
  unsigned number, order like the doubles.  The order statistics needed (the ranks below
  and above (n - 1) p) lie between the column's least and largest value; that bracket is
  cut into ``2 ** BITS`` cells by a subtraction and a shift, each Arrow batch is sorted and
  its cells counted, and what lies between the ends of the cell that holds the rank is the
  next bracket.  A bracket with at most ``limit`` values is read and sorted.  A round is one scan; six of
  them reach a single double whatever the values.  Only cell counts are shuffled, and
  only the cells that hold a rank reach the driver.
* ``grouped_quantile_arrays`` - of many groups, from running counts of each group's
  distinct values (``operators.ranks``), so a hot group is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A bracket is cut into 2 ** BITS cells per round; one with up to LIMIT values is read.
BITS, LIMIT = 12, 1 << 16
#: Numbers that are sorted together, so that a bracket costs its few calls once for many small batches.
TOGETHER = 1 << 22
SIGN = np.uint64(1 << 63)


def _number(col: str):
    """The column as a double without NaN and negative zero."""
    x = F.col(f"`{col}`").cast("double")
    return F.nanvl(x, F.lit(None).cast("double")) + F.lit(0.0)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    b = np.ascontiguousarray(x, dtype=np.float64).view(np.uint64)
    return np.where(b & SIGN, ~b, b | SIGN)


def from_bits(u: int) -> float:
    b = u & ~int(SIGN) if u & int(SIGN) else ~u & (1 << 64) - 1
    return float(np.array([b], dtype=np.uint64).view(np.float64)[0])


class _Bracket:
    """Values of a column with bits from ``lo`` to ``hi``; ``ranks``: (position inside, position in the column)."""

    def __init__(self, col: int, lo: int, hi: int, ranks: list[tuple[int, int]]):
        self.col, self.lo, self.hi, self.ranks = col, lo, hi, ranks
        self.shift = max(0, (hi - lo).bit_length() - BITS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to about TOGETHER numbers."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows * max(1, b.num_columns)
        if size >= TOGETHER:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _inside(batch: pa.RecordBatch, brackets: list[_Bracket]) -> Iterator[tuple[int, np.ndarray]]:
    """(bracket, sorted bits of the values inside) of a batch."""
    bits = {}
    for k, b in enumerate(brackets):
        if b.col not in bits:
            x = batch.column(f"c{b.col}").to_numpy(zero_copy_only=False)
            bits[b.col] = np.sort(ordered_bits(x[~np.isnan(x)]))
        u = bits[b.col]
        yield k, u[np.searchsorted(u, np.uint64(b.lo)):np.searchsorted(u, np.uint64(b.hi), side="right")]


class _Bins:
    """Equal-width bins of a column over [low, high], the last one closed."""

    def __init__(self, col: int, low: float, high: float, bins: int):
        self.col, self.low, self.high, self.bins = col, low, high, bins

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.low == self.high:
            return np.zeros(len(x), dtype=np.int64)
        return np.minimum(np.floor((x - self.low) / ((self.high - self.low) / self.bins)).astype(np.int64), self.bins - 1)


def _cells(data: DataFrame, brackets: list[_Bracket], binned: list[_Bins] = (), every: bool = False) -> tuple[list, dict[int, dict[int, int]]]:
    """(b, cell, n, before, lo, hi) of the cells that hold a rank (or of every one), and column -> bin -> count, from one scan."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << BITS, dtype=np.int64) for _ in brackets] + [np.zeros(b.bins, dtype=np.int64) for b in binned]
        low = [np.full(len(t), ~np.uint64(0)) for t in total]
        high = [np.zeros(len(t), dtype=np.uint64) for t in total]
        for batch in _joined(batches):
            for k, u in _inside(batch, brackets):
                cell = ((u - np.uint64(brackets[k].lo)) >> np.uint64(brackets[k].shift)).astype(np.int64)
                start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, dtype=np.int64)
                end, own = np.append(start[1:], len(cell))[:len(start)], cell[start]
                total[k][own] += end - start
                low[k][own] = np.minimum(low[k][own], u[start])
                high[k][own] = np.maximum(high[k][own], u[end - 1])
            for k, b in enumerate(binned, len(brackets)):
                x = batch.column(f"c{b.col}").to_numpy(zero_copy_only=False)
                total[k] += np.bincount(b.of(x[~np.isnan(x)]), minlength=b.bins)
        for k, t in enumerate(total):
            cell = np.flatnonzero(t)
            if len(cell):
                # Spark has signed numbers only: the sign bit is flipped on the way
                ends = [pa.array((e[k][cell] ^ SIGN).view(np.int64)) for e in (low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, dtype=np.int32)), pa.array(cell.astype(np.int32)), pa.array(t[cell]), *ends],
                                                 ["b", "cell", "n", "lo", "hi"])

    counts = (data.mapInArrow(count, "b int, cell int, n long, lo long, hi long").groupBy("b", "cell")
              .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    earlier = Window.partitionBy("b").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ranks = data.sparkSession.createDataFrame([(k, [r for r, _ in b.ranks]) for k, b in enumerate(brackets)], "b int, ranks array<long>")
    found = (placed.join(F.broadcast(ranks), "b", "left")
             .where(F.lit(every) | F.expr("ranks IS NULL OR exists(ranks, r -> r >= before AND r < before + n)")).select("b", "cell", "n", "before", "lo", "hi").collect())
    bins: dict[int, dict[int, int]] = {b.col: {} for b in binned}
    for r in found:
        if r["b"] >= len(brackets):
            bins[binned[r["b"] - len(brackets)].col][r["cell"]] = r["n"]
    return [r for r in found if r["b"] < len(brackets)], bins


def _read(data: DataFrame, brackets: list[_Bracket]) -> dict[int, list[float | None]]:
    """Bracket -> the value at each of its ranks, from one scan."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            for k, u in _inside(batch, brackets):
                if len(u):
                    x = np.where(u & SIGN, u & ~SIGN, ~u).view(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, dtype=np.int32)), pa.array(x)], ["b", "x"])

    ranks = data.sparkSession.createDataFrame([(k, [r for r, _ in b.ranks]) for k, b in enumerate(brackets)], "b int, ranks array<int>")
    values = data.mapInArrow(read, "b int, x double").groupBy("b").agg(F.sort_array(F.collect_list("x")).alias("x"))
    at = F.transform("ranks", lambda r: F.get("x", r))
    return {r["b"]: r["at"] for r in values.join(F.broadcast(ranks), "b").select("b", at.alias("at")).collect()}


def _order_statistics(data: DataFrame, start: list[tuple[int, int, int, int, list[tuple[int, int]]]], limit: int,
                      binned: list[_Bins] = ()) -> tuple[dict[tuple[int, int], float], dict[int, dict[int, int]]]:
    """(column, rank) -> value, and column -> bin -> count; ``start``: brackets as (column, lo, hi, rows, ranks)."""
    found: dict[tuple[int, int], float] = {}
    few: list[_Bracket] = []
    todo: list[_Bracket] = []
    seen: list[_Bracket] = []

    def add(col: int, lo: int, hi: int, n: int, ranks: list[tuple[int, int]]) -> None:
        if lo == hi:
            found.update({(col, original): from_bits(lo) for _, original in ranks})
        else:
            (few if n <= limit else todo).append(_Bracket(col, lo, hi, ranks))
            seen.insert(0, (few if n <= limit else todo)[-1])  # the narrowest first

    for col, lo, hi, n, ranks in start:
        add(col, lo, hi, n, ranks)
    counts: dict[int, dict[int, int]] = {}
    while todo or binned:
        brackets, todo[:] = list(todo), []
        cells, more = _cells(data, brackets, binned)
        counts.update(more)
        binned = []
        for cell in cells:
            b = brackets[cell["b"]]
            inside = [(r - cell["before"], original) for r, original in b.ranks if cell["before"] <= r < cell["before"] + cell["n"]]
            add(b.col, cell["lo"] + (1 << 63), cell["hi"] + (1 << 63), cell["n"], inside)
    if few:
        read = _read(data, few)
        for k, b in enumerate(few):
            found.update({(b.col, original): v for (_, original), v in zip(b.ranks, read.get(k, ())) if v is not None})
    # sums of doubles can differ in the last bit from scan to scan: a value that slipped out of its bracket is taken as its end
    for b in seen:
        for _, original in b.ranks:
            found.setdefault((b.col, original), from_bits(b.hi))
    return found, counts


def summaries(df: DataFrame, cols: list[str], probs: list[float], limit: int = LIMIT, bins: int = 0) -> dict[str, dict]:
    """Column -> n, mean, std, min, max, its exact quantiles ``q`` and the counts of ``bins`` equal-width ``bins``.

    An aggregate gives count, moments and ends; the first counting scan serves quantiles and bins.
    Columns without numbers have None for everything but n.
    """
    aggs = [f(_number(c)) for c in cols for f in (F.count, F.avg, F.stddev_samp, F.min, F.max)]
    row = df.agg(*aggs).first() if cols else []
    ends = {k: (row[5 * k], row[5 * k + 3], row[5 * k + 4]) for k in range(len(cols)) if row[5 * k]}
    places = {k: [(n - 1) * float(p) for p in probs] for k, (n, _, _) in ends.items()}
    start = [(k, *(int(u) for u in ordered_bits(np.array(ends[k][1:]))), ends[k][0], [(r, r) for r in _ranks(hs)]) for k, hs in places.items()]
    at, counts = _order_statistics(_numbers(df, cols), start, limit, [_Bins(k, *ends[k][1:], bins) for k in places] if bins else [])
    out = {}
    for k, c in enumerate(cols):
        n, mean, std, low, high = row[5 * k:5 * k + 5]
        q = [_between(at, k, h) for h in places[k]] if n else [None] * len(probs)
        out[c] = {"n": n, "mean": mean, "std": std, "min": low, "max": high, "q": q,
                  "bins": [counts[k].get(b, 0) for b in range(bins)] if n and bins else None}
    return out


def quantiles(df: DataFrame, cols: list[str], probs: list[float], limit: int = LIMIT) -> dict[str, list[float | None]]:
    """Column -> its exact quantiles (None for a column without numbers); the first scan counts over all doubles."""
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    data, top = _numbers(df, cols), (1 << 64) - 1
    cells: dict[int, list] = {}
    for r in _cells(data, [_Bracket(k, 0, top, []) for k in range(len(cols))], every=True)[0]:
        cells.setdefault(r["b"], []).append(r)
    places, start = {}, []
    for k, own in cells.items():
        places[k] = [(sum(c["n"] for c in own) - 1) * float(p) for p in probs]
        for c in own:
            inside = [(r - c["before"], r) for r in _ranks(places[k]) if c["before"] <= r < c["before"] + c["n"]]
            if inside:
                start.append((k, c["lo"] + (1 << 63), c["hi"] + (1 << 63), c["n"], inside))
    at, _ = _order_statistics(data, start, limit)
    for k, hs in places.items():
        out[cols[k]] = [_between(at, k, h) for h in hs]
    return out


def _numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[_number(c).alias(f"c{k}") for k, c in enumerate(cols)])


def _ranks(places: list[float]) -> list[int]:
    return sorted({f(h) for h in places for f in (floor, ceil)})


def _between(at: dict, k: int, h: float) -> float:
    return at[k, floor(h)] + (h - floor(h)) * (at[k, ceil(h)] - at[k, floor(h)])


def quantile_arrays(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact") -> DataFrame:
    """(column_name, q array<double>) with q[i] the ``probs[i]`` quantile of each column.

    ``method="approx"`` asks for ``percentile_approx`` instead.
    """
    probs = [float(p) for p in probs]
    if method == "approx":
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), _number(c).alias("x")) for c in cols])))
        return long.groupBy("column_name").agg(F.percentile_approx("x", probs, 10000).alias("q"))
    if method != "exact":
        raise ValueError(f"quantiles: unknown method '{method}'")
    rows = [(c, None if q[0] is None else q) for c, q in quantiles(df, cols, probs).items()] if probs else []
    return df.sparkSession.createDataFrame(rows, "column_name string, q array<double>")


def grouped_quantile_arrays(long: DataFrame, keys: list[str], x: str, probs: list[float], method: str = "exact") -> DataFrame:
    """(keys..., q array<double>) per group of ``keys`` (NULL x ignored)."""
    probs = [float(p) for p in probs]
    if method == "approx":
        return long.groupBy(*keys).agg(F.percentile_approx(F.col(x).cast("double"), probs, 10000).alias("q"))
    counts = (long.select(*keys, _number(x).alias("__x")).where(F.col("__x").isNotNull())
              .groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n")))
    return counted_quantile_arrays(counts, keys, "__x", "__n", probs)


def counted_quantile_arrays(counts: DataFrame, keys: list[str], x: str, n: str, probs: list[float], tiebreak: list[str] | None = None) -> DataFrame:
    """``grouped_quantile_arrays`` from the counts ``n`` of each group's values (unique with ``tiebreak``)."""
    from tabsight.operators.ranks import ordered_prefix
    pre = ordered_prefix(counts, keys, x, n, out_col="__before", tiebreak=tiebreak, total_col="__total")
    aggs, value = [], []
    for k, p in enumerate(probs):
        h = (F.col("__total") - 1) * F.lit(p)
        for side, r in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            at = (F.col("__before") <= r) & (r < F.col("__before") + F.col(n))
            aggs.append(F.max(F.when(at, F.col(x))).alias(f"__{side}{k}"))
        value.append(F.col(f"__lo{k}") + (h - F.floor(h)) * (F.col(f"__hi{k}") - F.col(f"__lo{k}")))
    return (pre.groupBy(*keys).agg(F.max("__total").alias("__total"), *aggs)
            .select(*keys, F.array(*value).alias("q")))
