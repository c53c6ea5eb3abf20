"""What a task holds while a query's vector is repeated for the blocks it asks."""

import numpy as np
import pyarrow as pa

from tabsight.operators import knn


class _Query:
    """Takes the function that would run in a task."""

    def select(self, *cols):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_repeated_vectors_leave_in_bounded_batches(monkeypatch):
    # before, one batch held a vector for every pair of query and block: 200 x 40 x 8 numbers
    monkeypatch.setattr(knn, "CELLS", 8000)
    cells = knn.PivotCells.__new__(knn.PivotCells)
    cells.dim, cells.p, cells.pivots = 8, 2, np.random.default_rng(1).normal(size=(40, 8))
    cells.cell, cells.lo, cells.hi = np.arange(40), np.zeros(40), np.ones(40)
    vectors = np.random.default_rng(2).normal(size=(200, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(vectors.tolist())], ["qid", "qv"])
    run = cells._ask(_Query(), lambda least, b: np.ones(least.shape, bool))
    out = list(run(iter([batch])))
    assert max(b.num_rows for b in out) * 8 <= 8000
    pairs = [(q, k) for b in out for q, k in zip(b.column("qid").to_pylist(), b.column("block").to_pylist())]
    assert sorted(pairs) == [(q, k) for q in range(200) for k in range(40)]
    assert all(v == vectors[q].tolist() for b in out for q, v in zip(b.column("qid").to_pylist(), b.column("qv").to_pylist()))
