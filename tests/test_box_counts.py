"""Box plots from the counts of each group's values: the rows are read once, and roles are found once per table."""

import math

import pytest

from tabsight.operators import plotdata as G


def brute(rows):
    out = {}
    for g in {g for g, x in rows if g is not None and x is not None}:
        own = [x for h, x in rows if h == g and x is not None]
        real = sorted(x for x in own if not math.isnan(x))
        if not real:
            continue

        def q(p):
            h = (len(real) - 1) * p
            return real[math.floor(h)] + (h - math.floor(h)) * (real[math.ceil(h)] - real[math.floor(h)])
        q1, q2, q3 = q(0.25), q(0.5), q(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        out[g] = (q1, q2, q3, min(x for x in real if x >= lo), max(x for x in real if x <= hi),
                  sum(math.isnan(x) or x < lo or x > hi for x in own), len(own))
    return out


@pytest.mark.parametrize("few", [10_000, 0])
def test_boxplot_from_counts(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(G, "FEW_GROUPS", few, raising=False)
    rows = [("a", float(k % 7)) for k in range(50)] + [("a", 99.0), ("a", 99.0), ("a", -50.0), ("b", 1.0), ("b", None), ("b", math.nan), (None, 3.0),
                                                       ("c", math.nan), ("d", -0.0), ("d", 0.0), ("e", None)]
    spark.createDataFrame(rows, "g string, x double").write.parquet(str(tmp_path / "t"))
    box = G.boxplot(spark.read.parquet(str(tmp_path / "t")), "x", by="g")
    assert "FileScan" not in box._jdf.queryExecution().executedPlan().toString()  # the rows are not read again
    got = {r.group: (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.n_outliers, r.n) for r in box.collect()}
    assert got == brute(rows) and got["a"][5] == 3


def test_roles_are_found_once_per_table(spark, monkeypatch):
    from tabsight import catalog
    calls, found = [], G.column_roles
    monkeypatch.setattr(G, "column_roles", lambda df, cols: calls.append(tuple(cols)) or found(df, cols))
    docs = spark.createDataFrame([(k, k % 2, ["de", "en"][k % 3 % 2]) for k in range(40)], "n_chars long, quality int, lang string")
    lines = spark.createDataFrame([(k * 1.5, float(k % 9), "ANR"[k % 3], k % 7) for k in range(40)],
                                  "l_extendedprice double, l_quantity double, l_returnflag string, l_linenumber int")
    monkeypatch.setattr(catalog, "docs_labels", lambda *_: docs)
    monkeypatch.setattr(catalog, "read_table", lambda *_: lines)
    catalog.QUERIES["feature_views"](spark, "")
    assert calls == [("quality", "n_chars", "lang"), ("l_extendedprice", "l_quantity", "l_returnflag", "l_linenumber")]
