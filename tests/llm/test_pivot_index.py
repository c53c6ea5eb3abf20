import numpy as np
import pytest

from tabsight.llm import pivot_index
from tabsight.llm.pivot_index import embedding_components

SCHEMA = "vec_id long, embedding array<float>, label int, root long, links long, w int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, 1, 1, 1, "x") for i, v, c in rows], SCHEMA)


def brute(rows, least=0.98):
    """vec_id -> (n_links, component_id)."""
    def fine(v, c):
        return c is not None and v is not None and len(v) and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(x != 0 for x in v)
    u = {i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if fine(v, c) else None for i, v, c in rows}
    label = {i: c for i, _, c in rows}
    near = {i: {j for j in u if j != i and u[i] is not None and u[j] is not None and label[i] == label[j] and len(u[i]) == len(u[j])
                and u[i] @ u[j] >= least} for i in u}
    out = {}
    for i in u:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen))
    return out


def vectors(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    while k < n:
        base, label = rng.normal(size=dim), int(rng.integers(0, 4))
        for _ in range(int(rng.integers(1, 6))):
            v = base + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.14, 0.3])
            rows.append((k, v * rng.choice([1.0, 3.0]), label))
            k += 1
    return rows


@pytest.mark.parametrize("unit", [2048, 8])
def test_matches_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(pivot_index, "UNIT", unit)  # small: lists are dealt out in chunk pairs
    rows = vectors(400)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(frame(spark, rows)).collect()}
    want = brute(rows)
    pairs = sum(n for n, _ in want.values())
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing below the threshold
    assert sum(n for n, _ in got.values()) >= 0.9 * pairs > 100


def test_dense_group_and_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(k, base + rng.normal(size=16) * 0.02, 1) for k in range(150)] + [(200 + k, base, 1) for k in range(60)] + [(300, base, 2)]
    got = {r.vec_id: r for r in embedding_components(frame(spark, rows)).collect()}
    assert {(r.n_links, r.component_id) for i, r in got.items() if i < 300} == {(209, 0)}
    assert (got[300].n_links, got[300].component_id, got[300].kept) == (0, 300, True)
    assert [i for i, r in got.items() if r.kept] == [0, 300] or sorted(i for i, r in got.items() if r.kept) == [0, 300]


def test_edge_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 2.0], 1), (5, [1.0, float("nan"), 2.0], 1), (6, [1.0, float("inf"), 2.0], 1),
            (7, one, None), (8, one, 1), (9, one, 1), (9, one, 1), (None, one, 1), (11, [1.0, 2.0], 1), (12, [-0.0, 1.0], 3), (13, [0.0, 1.0], 3)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_components(frame(spark, rows)).collect()), key=str)
    alone = [(k, 0, k, True) for k in (1, 2, 3, 4, 5, 6, 7, 11)]
    assert got == sorted(alone + [(8, 3, 8, True), (9, 3, 8, False), (9, 3, 8, False), (None, 3, 8, False), (12, 1, 12, True), (13, 1, 12, False)], key=str)
    assert embedding_components(frame(spark, [])).collect() == []
    assert len(embedding_components(frame(spark, [(1, one, 1)])).collect()) == 1
