"""Kendall over cells of values: results by brute force, and what is sent between tasks."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import cells, kendall


def _rows(n: int, seed: int = 3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.3, 7.0, np.round(rng.normal(size=n), 3))
    y = x + rng.normal(size=n)
    z = rng.integers(0, 4, n).astype(float)
    return [(float(a), None if k % 7 == 0 else float(b), float("nan") if k % 11 == 0 else float(c)) for k, (a, b, c) in enumerate(zip(x, y, z))]


def _tau(p: list[tuple[float, float]]) -> float:
    s = t = u = 0
    for (a, b), (c, d) in itertools.combinations(p, 2):
        i, j = (a > c) - (a < c), (b > d) - (b < d)
        s, t, u = s + i * j, t + abs(i), u + abs(j)
    return s / (t * u) ** 0.5


@pytest.mark.parametrize(("sample", "dense"), [(1 << 20, 1 << 22), (1, 1)])
def test_kendall_over_cells_by_brute_force(spark, monkeypatch, sample, dense):
    monkeypatch.setattr(cells, "SAMPLE", sample)
    monkeypatch.setattr(kendall, "DENSE", dense)
    rows = _rows(1500)
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(3)
    pairs = [(0, 1), (1, 2), (2, 0)]
    got = {r["pair"]: r["correlation"] for r in kendall.kendall_tau_b(df, [F.col(c) for c in "xyz"], pairs, small=8).collect()}
    for k, (a, b) in enumerate(pairs):
        assert got[k] == pytest.approx(_tau([(r[a], r[b]) for r in rows if None not in (r[a], r[b]) and r[a] == r[a] and r[b] == r[b]]), abs=1e-12)


def test_a_column_is_sent_once_and_values_of_closed_cells_not_at_all(spark):
    # before, every pair's rows were sent twice; bounds take 16 cells of 2,000 rows, z has 4 values, 7.0 is three rows in ten
    rows = _rows(2000)
    base, n = cells.packed_rows(spark.createDataFrame(rows, "x double, y double, z double"), [F.col(c) for c in "xyz"])
    bounds, few = cells.column_bounds(base, n, 3, small=8)
    assert n == 2000 and few == [False, False, True] and 7.0 in bounds[0]

    def seen(key, arrays):
        import pandas as pd
        return pd.DataFrame({"a": [key[0]], "n": [len(arrays[0])], "widest": [int((arrays[0] == 7.0).sum())]})
    sent = cells.per_cell(base, 3, bounds, [0, 1, 2], lambda a, x, code, rows: [], seen, "a int, n long, widest long").collect()
    assert {r["a"] for r in sent} == {0, 1} and sum(r["widest"] for r in sent if r["a"] == 0) == 0
    assert sum(r["n"] for r in sent if r["a"] == 0) <= sum(r[0] != 7.0 for r in rows)
