"""Edge-case fixtures for the profiling operators (inline literals)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabsight.operators import profile as P
from tabsight.operators.freq import column_stats


def test_logical_types(spark):
    rows = [(True, dt.date(2020, 1, 1), dt.datetime(2020, 1, 1), 1, 1.5, "a", [1], None),
            (False, dt.date(2020, 1, 2), dt.datetime(2020, 1, 2), 0, 2.5, "b", [2], None),
            (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "b boolean, d date, ts timestamp, i int, n double, s string, "
                                     "arr array<int>, allnull double")
    types = {r.column_name: r.logical_type for r in column_stats(df).collect()}
    assert types == {"b": "boolean", "d": "datetime", "ts": "datetime", "i": "categorical",
                     "n": "numeric", "s": "categorical", "arr": "unknown", "allnull": "categorical"}


def test_high_cardinality_threshold(spark):
    df = spark.createDataFrame([(str(i),) for i in range(21)] + [("0",)] * 10, "s string")
    # 21 distinct > max(20, int(31*0.05)=1) -> high cardinality
    assert column_stats(df).first().logical_type == "high_cardinality"
    df2 = spark.createDataFrame([(str(i),) for i in range(20)], "s string")
    assert column_stats(df2).first().logical_type == "categorical"


def test_top_value_ties_lowest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "s string")
    r = P.cardinality_summary(df).first()
    assert (r.top_value, r.top_freq, r.nunique) == ("a", 2, 3)
    d = P.describe_categorical(df).first()
    assert (d.top, d.top_freq, d.top_pct) == ("a", 2, 40.0)


def test_duplicates_keep(spark):
    rows = [(1, "x", 1), (2, "x", 1), (3, None, None), (4, None, None), (5, "y", 2)]
    df = spark.createDataFrame(rows, "k int, a string, b int")
    first = sorted(r.k for r in P.check_duplicates(df, ["a", "b"], "first", "k").collect())
    last = sorted(r.k for r in P.check_duplicates(df, ["a", "b"], "last", "k").collect())
    every = sorted(r.k for r in P.check_duplicates(df, ["a", "b"], False).collect())
    assert first == [2, 4] and last == [1, 3] and every == [1, 2, 3, 4]
    assert P.duplicates_summary(df, ["a", "b"]).first().n_duplicates == 2


def test_missing_and_moments_small_tables(spark):
    for n in range(0, 5):
        df = spark.createDataFrame([(float(i * i),) for i in range(n)], "x double")
        r = P.numeric_moments(df, ["x"]).first()
        assert r["count"] == n
        assert (r.skew is None) == (n < 3)
        assert (r.kurtosis is None) == (n < 4)


def test_adjusted_moments_match_formula(spark):
    import numpy as np
    xs = [1.0, 2.0, 2.0, 3.0, 7.0, 11.0]
    r = P.numeric_moments(spark.createDataFrame([(x,) for x in xs], "x double"), ["x"]).first()
    a = np.array(xs)
    n = len(a)
    m2 = ((a - a.mean()) ** 2).mean()
    m3 = ((a - a.mean()) ** 3).mean()
    m4 = ((a - a.mean()) ** 4).mean()
    g1 = m3 / m2 ** 1.5
    g2 = m4 / m2 ** 2 - 3
    assert r.skew == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2), rel=1e-9)
    assert r.kurtosis == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), rel=1e-9)


def test_constant_and_quasi_constant(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(100)] + [(None, 1.0)], "c double, x double")
    assert [r.column_name for r in P.constant_columns(df).collect()] == ["c"]
    q = {r.column_name for r in P.quasi_constant_columns(df, threshold=0.99).collect()}
    assert q == {"c"}
    assert P.low_variance_columns(df).count() == 1  # c: variance 0


def test_outliers_iqr(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    mask = [r.is_outlier for r in P.detect_outliers_iqr(df, "x", col_type="numeric").collect()]
    assert sorted(mask) == [False] * 5 + [True]
    s = P.outliers_summary_iqr(df, "x", col_type="numeric").first()
    assert s.n_outliers == 1 and s.lower_bound == -1.0 and s.upper_bound == 7.0
    with pytest.raises(ValueError):
        P.detect_outliers_iqr(spark.createDataFrame([("a",)], "s string"), "s")


def test_empty_table_shares_are_null(spark):
    df = spark.createDataFrame([], "a double, s string")
    ov = {r.column_name: r for r in P.overview(df).collect()}
    assert ov["a"].pct_missing is None and ov["a"].n_unique == 0


def test_value_counts_null_is_a_value(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "s string")
    rows = P.value_counts(df, "s", top_n=2).collect()
    assert rows[0].value is None and rows[0]["count"] == 2


@pytest.mark.parametrize("limit", [1, 40, 4096])
def test_quantiles_by_narrowing_are_exact(spark, limit):
    import random
    import numpy as np
    from tabsight.operators.quantiles import quantiles
    rnd = random.Random(11)
    x = [float(rnd.randint(0, 30)) if rnd.random() < 0.8 else rnd.random() * 100 for _ in range(3000)] + [5.0] * 2000
    y = [rnd.gauss(0, 1) if k % 3 else None for k in range(5000)]
    z = [7.0 if k else -3.0 for k in range(5000)]
    df = spark.createDataFrame(list(zip(x, y, z, [None] * 5000)), "x double, y double, z double, e double")
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles(df, ["x", "y", "z", "e"], probs, limit)
    assert got["e"] == [None] * len(probs)
    for c, v in (("x", x), ("y", [k for k in y if k is not None]), ("z", z)):
        assert got[c] == pytest.approx(list(np.quantile(v, probs))), c


def test_grouped_quantiles_are_exact(spark):
    import random
    import numpy as np
    from tabsight.operators.quantiles import grouped_quantile_arrays
    rnd = random.Random(12)
    rows = [(rnd.choice("aaabc"), float(rnd.randint(0, 30)) if rnd.random() < 0.8 else rnd.random())
            for _ in range(3000)] + [("a", None), ("d", 5.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: list(r.q) for r in grouped_quantile_arrays(df, ["g"], "x", probs).collect()}
    assert got.keys() == {"a", "b", "c", "d", None}
    for g, q in got.items():
        assert q == pytest.approx(list(np.quantile([x for h, x in rows if h == g and x is not None], probs)))


def test_top_values_of_long_texts_and_ties(spark):
    from tabsight.operators.freq import frequency_table, top_values
    long = ["same beginning of thirty bytes " + t * 20 for t in "dbca"]
    rows = [(x, x[:40], k % 2 == 0, None) for k, x in enumerate(long * 3 + [long[0]] + ["short", "short", "brief", "brief", "brief", "brief"])] + [(None,) * 4] * 9
    df = spark.createDataFrame(rows, "s string, h string, b boolean, e int")
    counts = {}
    for c, name in enumerate(["s", "h", "b"]):
        n = {}
        for r in rows:
            if r[c] is not None:
                v = str(r[c]).lower() if name == "b" else r[c]
                n[v] = n.get(v, 0) + 1
        counts[name] = sorted(n.items(), key=lambda x: (-x[1], x[0]))
    freq = frequency_table(df)
    assert not any("digest" in f.name or len(f.name) > 12 for f in freq.schema.fields)
    assert max(len(bytes(r.key)) for r in freq.where("key IS NOT NULL").collect()) <= 32
    for k in (1, 2, 3, 10):
        got = {}
        for r in top_values(df, freq, k).orderBy("column_name", "rank").collect():
            got.setdefault(r.column_name, []).append((r.value, r.n))
        assert got == {c: v[:k] for c, v in counts.items()}


def test_many_keys_are_joined(spark, monkeypatch):
    from tabsight.operators import freq
    rows = [("x" * 50 + str(k % 7),) for k in range(70)]
    df = spark.createDataFrame(rows, "s string")
    monkeypatch.setattr(freq, "FEW_KEYS", 0)
    assert P.describe_categorical(df).first().top == "x" * 50 + "0"


def test_no_text_in_exchanges(spark):
    from tabsight.operators.freq import value_frequencies
    df = spark.createDataFrame([("t" * 1000, 1.5, 2)], "s string, x double, n int")
    plan = value_frequencies(df)._jdf.queryExecution().executedPlan().toString()
    assert "md5" in plan and all("s#" not in line.split("hashpartitioning")[1] for line in plan.splitlines() if "hashpartitioning" in line)


def test_column_summary_of_all_kinds(spark):
    from tabsight.operators.plotdata import column_summary
    rows = [(float(k), k % 3, "ab"[k % 2] if k % 4 else None, k % 2 == 0, None) for k in range(40)]
    df = spark.createDataFrame(rows, "x double, n int, s string, b boolean, e double")
    got = {r.column_name: r for r in column_summary(df, bins=4, top_categories=1).collect()}
    assert list(got) == ["x", "n", "s", "b", "e"]
    assert (got["x"].valid, got["x"]["min"], got["x"].q50, got["x"].bins) == (40, 0.0, 19.5, [10, 10, 10, 10])
    assert (got["s"].missing, got["s"].n_unique, [(t.value, t["count"]) for t in got["s"].top]) == (10, 2, [("b", 20)])
    assert (got["e"].valid, got["e"].mean, got["e"].bins) == (0, None, None) and got["b"].n_unique == 2
    assert [r.column_name for r in column_summary(df, feature_type="categorical").collect()] == ["s"]


def test_radix_selection_at_the_ends_of_the_range(spark):
    from tabsight.operators.quantiles import quantiles
    x = [float("-inf"), -1e300, -5e-324, 0.0, -0.0, 5e-324, 1.0, 1.0 + 2 ** -52, 1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "x double")
    for limit in (1, 4, 1000):
        assert quantiles(df, ["x"], [k / 9 for k in range(1, 8)], limit)["x"] == pytest.approx(sorted(x)[1:8])


def test_quasi_constant_shares(spark):
    rows = ([("x", 1.0, None, True)] * 995 + [("y", 2.0, None, False)] * 3 + [(None, None, 1, None)] * 2)
    df = spark.createDataFrame(rows, "s string, d double, n int, b boolean")
    got = {r.column_name: r.top_share for r in P.quasi_constant_columns(df, threshold=0.99).collect()}
    assert got == {"s": 0.995, "d": 0.995, "n": 0.998, "b": 0.995}


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0, 1), (-0.0, 2)], "x double, y int")
    assert [r.column_name for r in P.constant_columns(df).collect()] == ["x"]
    assert {r.column_name: r.n_unique for r in P.overview(df).collect()} == {"x": 1, "y": 2}


def test_null_and_constant_tests_move_no_values(spark):
    df = spark.createDataFrame([(str(k % 3), float(k), None) for k in range(9)], "s string, x double, e int")
    for out in (P.missing_summary(df), P.constant_columns(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
    assert [(r.column_name, r.n_missing) for r in P.missing_summary(df).collect()] == [("e", 9)]
    assert [r.column_name for r in P.constant_columns(df).collect()] == ["e"]


def test_value_counts_requires_categorical_like(spark):
    df = spark.createDataFrame([(float(i),) for i in range(30)], "x double")
    with pytest.raises(ValueError):
        P.value_counts(df, "x")
    assert P.value_counts(df, "x", col_type="any", top_n=3).count() == 3
