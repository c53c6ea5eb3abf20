"""What is sent when queries ask many blocks, and what a task returns."""

import numpy as np
import pandas as pd
import pyarrow as pa

from tabsight.operators import knn


class _Query:
    """Takes the function that would run in a task."""

    def select(self, *cols):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_vector_is_sent_once_to_a_bundle_of_blocks():
    # before, 50 queries that ask all of 600 blocks were sent 30,000 times, and with the square of the rows
    rng = np.random.default_rng(3)
    cells = knn.PivotCells.__new__(knn.PivotCells)
    cells.dim, cells.p, cells.pivots = 4, 2, rng.normal(size=(60, 4))
    cells.cell, cells.lo, cells.hi = np.repeat(np.arange(60), 10), np.zeros(600), np.ones(600)
    cells.bundle = knn._bundles(cells.cell, np.full(600, 20), cells.pivots, 2, 600 * 20 // knn.BUNDLES)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(rng.normal(size=(50, 4)).tolist())], ["qid", "qv"])
    out = [r for b in cells._ask(_Query(), lambda least, b: np.ones(least.shape, bool))(iter([batch])) for r in b.to_pylist()]
    assert len(out) <= 50 * (knn.BUNDLES + 1)
    assert sorted((r["qid"], k) for r in out for k in r["blocks"]) == [(q, k) for q in range(50) for k in range(600)]


def test_rows_beyond_the_bound_leave_no_task():
    # before, each block sent its best k rows for each query, however far
    q = pd.DataFrame({"qid": [1, 2], "qv": [[0.0], [10.0]], "bound": [1.0, np.nan], "blocks": [[0, 1], [1]]})
    t = pd.DataFrame({"tid": range(6), "tv": [[float(x)] for x in (0, 1, 2, 8, 9, 11)], "tlabel": 0.0, "block": [0, 0, 0, 1, 1, 1]})
    got = knn._nearest(2, 2)(None, q, t)
    assert got[["qid", "tid", "dist"]].values.tolist() == [[1, 0, 0.0], [1, 1, 1.0], [2, 4, 1.0], [2, 5, 1.0]]
