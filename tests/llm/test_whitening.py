import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import whitening
from tabsight.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, most=16):
    """(n, deviation, whitened, explained) by plain numpy."""
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    live = e > e[0] * 1e-10
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u[:, live] / np.sqrt(e[live]), (e / np.trace(cov))[live]


def frame(spark, vectors, first=0):
    df = spark.createDataFrame([(first + k, None if v is None else [None if c is None else float(c) for c in v], k % 3) for k, v in enumerate(vectors)], SCHEMA)
    return df.withColumns({c: F.lit("y") for c in ("x", "z", "idx", "key", "n", "v", "deviation")})


def check(rows, vectors, most=16):
    n, deviation, z, explained = brute(vectors, most)
    got = {r.key: r for r in rows}
    assert len(rows) == len(got) == len(vectors)
    mine = np.array([got[k].z for k in range(len(vectors))])
    sign = np.sign((mine * z).sum(axis=0))
    np.testing.assert_allclose(mine * sign, z, atol=1e-6)
    assert [got[k].deviation for k in range(len(vectors))] == deviation.tolist()
    for r in rows:
        assert r.n == n and r.identity_error < 1e-8
        assert r.explained == pytest.approx(explained.tolist(), rel=1e-6)


def sample(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) + rng.normal(size=dim)).astype(np.float32)


@pytest.mark.parametrize("dim,most", [(5, 16), (24, 16), (24, 3)])
def test_equals_numpy(spark, dim, most):
    v = sample(700, dim)
    check(whiten(frame(spark, v).repartition(5), most=most).collect(), v, most)


def test_many_blocks_and_column_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 4 * 16)
    monkeypatch.setattr(whitening, "MOST_COLUMNS", 4)
    monkeypatch.setattr(whitening, "SPLIT", 2)
    v = sample(300, 10)
    check(whiten(frame(spark, v).repartition(3)).collect(), v)


def test_copies_count_once(spark):
    v = np.concatenate([sample(200, 6), np.repeat(sample(1, 6, seed=9), 150, axis=0)])
    check(whiten(frame(spark, v).repartition(4)).collect(), v)


def test_rows_that_do_not_count(spark):
    v = sample(60, 4)
    bad = [None, [], [1, None, 2, 3], [1, float("nan"), 2, 3], [1, 2, float("inf"), 3], [1, 2, 3]]
    rows = whiten(frame(spark, v).unionByName(frame(spark, bad, 1000))).collect()
    check(rows, v)


def test_null_and_repeated_ids(spark):
    v = sample(50, 4).tolist()
    df = spark.createDataFrame([(None if k < 10 else 7, x, 0) for k, x in enumerate(v)], SCHEMA)
    rows = whiten(df).collect()
    assert sorted(r.deviation for r in rows) == sorted(brute(v)[1].tolist()) and sum(r.key is None for r in rows) == 10


def test_missing_rank(spark):
    v = np.concatenate([sample(80, 3), np.ones((80, 1), dtype=np.float32)], axis=1)
    rows = whiten(frame(spark, v)).collect()
    assert {len(r.z) for r in rows} == {3}
    check(rows, v)


@pytest.mark.parametrize("vectors", [[], [None], [[1, 2]], [[1, 2]] * 5])
def test_nothing_to_scale(spark, vectors):
    assert whiten(frame(spark, vectors)).collect() == []
