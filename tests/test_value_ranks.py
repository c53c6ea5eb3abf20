"""Columns of few values are ranked from their counts, the others by a range partitioned sort; both meet in one row per id."""

import random

import pytest

from tabsight.operators import assoc as A
from tabsight.operators import ranks
from tests.test_assoc import _avg_ranks


def columns(n=600):
    rnd = random.Random(4)
    return [[None if rnd.random() < gap else float(draw(rnd)) for _ in range(n)] for gap, draw in (
        (0.2, lambda r: r.randint(0, 3)), (0, lambda r: r.random()), (0, lambda r: -0.0 if r.random() < 0.5 else 0.0), (0, lambda r: r.randint(-40, 40)))]


def test_value_ranks_leaves_out_many_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 100)
    cols = columns()
    wide = spark.createDataFrame([(i, *v) for i, v in enumerate(zip(*cols))], "id long, x0 double, x1 double, x2 double, x3 double")
    few = ranks.value_ranks(wide, 4)
    assert sorted(few) == [0, 2, 3]
    for g, (values, rank, n) in few.items():
        own = [x for x in cols[g] if x is not None]
        want = {x: (r, own.count(x)) for x, r in zip(own, _avg_ranks(own))}
        assert {x: (r, k) for x, r, k in zip(values.tolist(), rank.tolist(), n.tolist())} == want
    assert ranks.value_ranks(wide.where("false"), 4).keys() <= set(range(4))


@pytest.mark.parametrize("few, width", [(0, 8), (100, 1), (100, 2), (100000, 8)])
def test_spearman_is_the_same_by_either_way(spark, monkeypatch, few, width):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "WIDTH", width)
    cols = columns()
    df = spark.createDataFrame(list(zip(*cols)), "a double, b double, c double, d double").repartition(3)
    got = {(r.feature_1, r.feature_2): r.correlation for r in A.correlation_matrix(df, method="spearman").collect()}
    for i, a in enumerate("abcd"):
        for j, b in enumerate("abcd"):
            both = [(x, y) for x, y in zip(cols[i], cols[j]) if x is not None and y is not None]
            x, y = (_avg_ranks([p[k] for p in both]) for k in (0, 1))
            mx, my = sum(x) / len(x), sum(y) / len(y)
            sxy, sxx, syy = (sum((p - m) * (q - o) for p, q in zip(u, v)) for u, v, m, o in ((x, y, mx, my), (x, x, mx, mx), (y, y, my, my)))
            if sxx * syy == 0:
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(sxy / (sxx * syy) ** 0.5, abs=1e-9)


def test_rank_columns_with_empty_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        rows = ranks.rank_columns(spark.createDataFrame([(1, 0, 2.0), (2, 0, 2.0)], "id long, g int, x double"), 1, ties=True).collect()
        none = ranks.rank_columns(spark.createDataFrame([], "id long, g int, x double"), 1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, rows)) == [(1, 1.5, 2), (2, 1.5, 2)] and none == []
