"""Feature steps on the edge-case fixtures."""
import pytest
from pyspark.sql import functions as F

from tabsight.operators import features as X


def test_regex_title(spark):
    df = spark.createDataFrame([("Braund, Mr. Owen",), ("Doe, Mlle. Ann",), ("Roe, Dr. Bob",),
                                ("NoTitle",), (None,)], "name string")
    out = X.regex_category(df, "name", r",\s*([^\.]+)\.", "title",
                           rename={"Mlle": "Miss", "Ms": "Miss", "Mme": "Mrs"},
                           rare=["Dr", "Rev", "Major", "Col", "Jonkheer", "Lady", "Capt", "Don", "Sir"])
    assert [r.title for r in out.collect()] == ["Mr", "Miss", "Rare", None, None]


def test_cut_right_closed(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 12.0, 12.5, 18.0, 100.0, 101.0, None]], "x double")
    out = [r.x_bin for r in X.cut(df, "x", [0, 12, 18, 40, 60, 100]).collect()]
    assert out == [None, 0, 1, 1, 4, None, None]


def test_qcut_bins_and_duplicate_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 9)], "x double")
    out = sorted(r.x_qbin for r in X.qcut(df, "x", 4).collect())
    assert out == [0, 0, 1, 1, 2, 2, 3, 3]
    dup = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 1, 1, 2, 3]], "x double")
    with pytest.raises(Exception):
        X.qcut(dup, "x", 4).collect()


def test_ticket_prefix(spark):
    df = spark.createDataFrame([("A/5 21171",), ("STON/O2. 3101282",), ("113803",), (None,)], "t string")
    assert [r.p for r in X.strip_digits_prefix(df, "t", "p").collect()] == ["A", "STON O", "NONE", "NONE"]


def test_group_size_null_key(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "t string")
    got = sorted((r.t or "", r.n) for r in X.group_size(df, "t", "n").collect())
    assert got == [("", None), ("x", 2), ("x", 2), ("y", 1)]


def test_map_encode_strict(spark):
    df = spark.createDataFrame([("male",), ("female",)], "sex string")
    assert [r.sex for r in X.map_encode(df, "sex", {"male": 0, "female": 1}).collect()] == [0, 1]
    bad = spark.createDataFrame([("male",), ("other",)], "sex string")
    with pytest.raises(Exception):
        X.map_encode(bad, "sex", {"male": 0, "female": 1}).collect()


def test_first_char_and_flags(spark):
    df = spark.createDataFrame([("C85", 1, 0, 10.0), (None, 0, 0, None)], "cabin string, a int, b int, age double")
    out = X.first_char(df, "cabin", "deck")
    out = X.is_single(X.count_sum(out, ["a", "b"], "fs"), "fs", "alone")
    out = X.flag_below(out, "age", 16, "child")
    rows = out.collect()
    assert [(r.deck, r.fs, r.alone, r.child) for r in rows] == [("C", 2, 0, 1), ("Unknown", 1, 1, 0)]


def test_log1p_in_place(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "f double")
    assert [round(r.f, 9) for r in X.log1p(df, "f").collect()] == [0.0, 0.693147181]


def test_pair_plot_data(spark):
    from tabsight.operators import plotdata as G
    df = spark.createDataFrame([(float(i), float(i % 5), "a" if i % 2 else "b", None if i == 3 else 1.0)
                                for i in range(40)], "x double, y double, h string, z double")
    out = G.pair_plot_data(df, ["x", "y", "nope"], hue="h", bins=4)
    assert set(out) == {"points", "hist_x", "hist_y"}
    assert out["points"].count() == 40
    assert sum(r["count"] for r in out["hist_x"].collect()) == 40
    with pytest.raises(ValueError):
        G.pair_plot_data(df, ["x"])


def test_group_then_candidates(spark):
    from tabsight.operators import candidates as CD
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 10.0), ("b", 2.0), (None, 5.0)], "g string, v double")
    rows = [("m", "groupby_then_median", ["g", "v"], None), ("mu", "groupby_then_mean", ["g", "v"], None),
            ("f", "freq", ["g"], None), ("r", "groupby_then_rank", ["g", "v"], None)]
    out = {(r.g, r.v): (r.m, r.mu, r.f, r.r) for r in CD.apply_candidates(df, rows).collect()}
    assert out[("a", 3.0)] == (3.0, 14.0 / 3, 3, 2 / 3)
    assert out[("b", 2.0)] == (2.0, 2.0, 1, 1.0)
    assert out[(None, 5.0)] == (None, None, None, None)


def test_group_sizes_and_bins_are_learned_on_the_training_folds(spark, tmpdir_path):
    from pyspark.ml import Pipeline, PipelineModel
    from tabsight.operators.evaluate import stratified_folds
    from tabsight.operators.features import GroupSizeEncoder, QuantileBinner
    rows = [(i, "abc"[i % 3] if i % 7 else None, float(i * i % 50), i % 2) for i in range(90)] + [(90, "only", 3.0, 0)]
    df = stratified_folds(spark.createDataFrame(rows, "id long, g string, x double, y int"), "y", "id", k=3)
    fold = {r.id: r.fold for r in df.collect()}
    stages = Pipeline(stages=[GroupSizeEncoder(inputCol="g", outputCol="size"), QuantileBinner(inputCol="x", outputCol="bin", numBins=2)])
    for k in range(3):
        model = stages.fit(df.where(df.fold != k))
        train = [r for r in rows if fold[r[0]] != k]
        xs = sorted(r[2] for r in train)
        middle = (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2
        for r in model.transform(df).collect():
            assert r.size == max(1, sum(t[1] == r.g for t in train))
            assert r.bin == int(r.x > middle)
    model.write().overwrite().save(f"{tmpdir_path}/stages")
    again = PipelineModel.load(f"{tmpdir_path}/stages")
    assert {r.id: (r.size, r.bin) for r in again.transform(df).collect()} == {r.id: (r.size, r.bin) for r in model.transform(df).collect()}
