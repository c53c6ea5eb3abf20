"""Association operators against brute force on small fixtures."""
import itertools
import math
import random

import pytest

from tabsight.operators import assoc as A


def _tau_b(xs, ys):
    n0 = n1 = n2 = s = 0
    for (x1, y1), (x2, y2) in itertools.combinations(zip(xs, ys), 2):
        n0 += 1
        dx, dy = (x1 > x2) - (x1 < x2), (y1 > y2) - (y1 < y2)
        s += dx * dy
        n1 += dx == 0
        n2 += dy == 0
    return s / math.sqrt((n0 - n1) * (n0 - n2))


def _avg_ranks(v):
    order = sorted(range(len(v)), key=lambda i: v[i])
    r = [0.0] * len(v)
    i = 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and v[order[j + 1]] == v[order[i]]:
            j += 1
        for t in range(i, j + 1):
            r[order[t]] = (i + j) / 2 + 1
        i = j + 1
    return r


def _pearson(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    return cov / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


@pytest.fixture(scope="module")
def ties(spark):
    rnd = random.Random(7)
    rows = [(float(rnd.randint(0, 6)), float(rnd.randint(0, 4)), rnd.random()) for _ in range(300)]
    return rows, spark.createDataFrame(rows, "x double, y double, z double")


def test_kendall_matches_brute_force(ties):
    rows, df = ties
    got = {(r.feature_1, r.feature_2): r.correlation
           for r in A.correlation_matrix(df, method="kendall").collect()}
    xs, ys, zs = zip(*rows)
    assert got[("x", "y")] == pytest.approx(_tau_b(xs, ys), abs=1e-12)
    assert got[("x", "z")] == pytest.approx(_tau_b(xs, zs), abs=1e-12)
    assert got[("y", "x")] == got[("x", "y")]


@pytest.mark.parametrize("step", [1, 7, 400])
def test_kendall_over_many_buckets(spark, step):
    # buckets are small beside the data: the grid and the in-bucket sums must add up, hot values included
    rnd = random.Random(step)
    rows = []
    for k in range(2500):
        x = float(rnd.randint(0, 5000) // step)
        rows.append((x if rnd.random() < 0.7 else 3.0, x + rnd.gauss(0, 300) if rnd.random() < 0.6 else 1.0, None if k % 9 == 0 else float(rnd.randint(0, 3))))
    df = spark.createDataFrame(rows, "x double, y double, z double")
    got = {(r.feature_1, r.feature_2): r.correlation for r in A.kendall_pairs(df, [("x", "y"), ("y", "z"), ("z", "x")], small=8).collect()}
    for a, b in (("x", "y"), ("y", "z"), ("z", "x")):
        i, j = "xyz".index(a), "xyz".index(b)
        both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        assert got[a, b] == pytest.approx(_tau_b(*zip(*both)), abs=1e-12)


def test_below_left_counts_by_brute_force():
    import numpy as np
    from tabsight.operators.kendall import below_left
    rng = np.random.default_rng(5)
    for n, top in ((0, 3), (1, 3), (700, 9), (700, 10 ** 6)):
        x, y = rng.integers(0, top, n).astype(float), rng.integers(0, top, n).astype(float)
        assert below_left(x, y) == int(((x[None, :] < x[:, None]) & (y[None, :] < y[:, None])).sum())


@pytest.mark.parametrize("parts", [1, 8, 50])
def test_rank_columns_over_boundaries(spark, parts):
    from tabsight.operators.ranks import rank_columns
    rnd = random.Random(parts)
    cols = [[float(rnd.randint(0, 3)) for _ in range(400)], [rnd.random() for _ in range(400)], [7.0] * 400]
    rows = [(i, g, x) for g, c in enumerate(cols) for i, x in enumerate(c) if (i + g) % 11]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.id: r for r in rank_columns(spark.createDataFrame(rows, "id long, g int, x double"), 3, ties=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g, c in enumerate(cols):
        ids = [i for i in range(400) if (i + g) % 11]
        for i, r in zip(ids, _avg_ranks([c[i] for i in ids])):
            assert got[i][f"r{g}"] == r and got[i][f"t{g}"] == sum(c[i] == c[j] for j in ids)


def test_spearman_reranks_complete_rows(spark):
    rnd = random.Random(21)
    rows = [tuple(None if rnd.random() < share else float(rnd.randint(0, 9)) for share in (0, 0.3, 0.3, 0)) for _ in range(400)]
    rows = [(*r, r[1]) for r in rows]  # the last column is missing where the second is
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = {(r.feature_1, r.feature_2): r.correlation for r in A.correlation_matrix(df, method="spearman").collect()}
    for i, a in enumerate("abcde"):
        for j, b in enumerate("abcde"):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            x, y = zip(*both)
            assert got[a, b] == pytest.approx(_pearson(_avg_ranks(x), _avg_ranks(y)), abs=1e-12)


def test_pair_moments_far_from_zero(spark):
    rnd = random.Random(2)
    rows = [(1e9 + rnd.random(), 1e9 + (rnd.random() if k % 2 else 0.5), 0.1, (0.3 if k % 3 else None), float("nan") if k % 5 == 0 else rnd.random()) for k in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(7)
    got = {(r.feature_1, r.feature_2): r.correlation for r in A.correlation_matrix(df).collect()}
    def want(i, j):
        both = [(r[i], r[j]) for r in rows if all(v is not None and v == v for v in (r[i], r[j]))]
        x, y = zip(*both)
        return _pearson([v - x[0] for v in x], [v - y[0] for v in y])
    assert got["a", "b"] == pytest.approx(want(0, 1), abs=1e-7) and got["a", "e"] == pytest.approx(want(0, 4), abs=1e-7)
    # constant columns have no correlation, also where only the pair's rows are constant
    assert all(got[k] is None for k in got if "c" in k or "d" in k)


def test_spearman_matches_ranks(ties):
    rows, df = ties
    got = {(r.feature_1, r.feature_2): r.correlation
           for r in A.correlation_matrix(df, method="spearman").collect()}
    xs, ys, _ = zip(*rows)
    assert got[("x", "y")] == pytest.approx(_pearson(_avg_ranks(xs), _avg_ranks(ys)), abs=1e-12)


def test_pearson_pairwise_complete_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 5.0, 5.0), (None, 1.0, 5.0),
                                (4.0, 6.5, 5.0)], "a double, b double, c double")
    got = {(r.feature_1, r.feature_2): r.correlation for r in A.correlation_matrix(df).collect()}
    assert got[("a", "b")] == pytest.approx(_pearson([1, 3, 4], [2, 5, 6.5]))
    assert got[("a", "c")] is None and got[("c", "c")] is None and got[("a", "a")] == 1.0


def test_crosstab_normalize_and_nulls(spark):
    rows = [("u", "k1", 0), ("u", "k1", 1), (None, "k1", 1), ("v", "k2", 1), ("v", "k2", 1)]
    df = spark.createDataFrame(rows, "a string, k string, b int")
    idx = A.crosstab(df, ["a", "k"], "b", normalize="index").collect()
    for r in idx:
        assert r["0"] + r["1"] == pytest.approx(1.0)
    counts = {(r.a, r.k): (r["0"], r["1"]) for r in A.crosstab(df, ["a", "k"], "b").collect()}
    assert counts == {("u", "k1"): (1, 1), ("v", "k2"): (0, 2)}


def test_mutual_info_identity_is_entropy(spark):
    ys = [0, 0, 1, 1, 1, 2]
    df = spark.createDataFrame([(str(y), y) for y in ys], "x string, y int")
    mi = A.mutual_info(df, ["x"], "y").first().mi
    h = -sum((ys.count(v) / 6) * math.log(ys.count(v) / 6) for v in set(ys))
    assert mi == pytest.approx(h, abs=1e-12)


@pytest.mark.parametrize("parts", [1, 7])
def test_ordered_prefix_over_partitions(spark, parts):
    from pyspark.sql import functions as F
    from tabsight.operators.ranks import ordered_prefix
    rnd = random.Random(parts)
    rows = [(rnd.choice(["a", "b", None]), float(rnd.randint(0, 40)) if rnd.random() < 0.7 else rnd.random(), i)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double, k long").withColumn("w", F.lit(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.k: (r.before, r.all) for r in ordered_prefix(df, ["g"], "v", "w", tiebreak=["k"], total_col="all").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g, v, k in rows:
        same = [(v2, k2) for g2, v2, k2 in rows if g2 == g]
        assert got[k] == (sum(x < (v, k) for x in same), len(same))
