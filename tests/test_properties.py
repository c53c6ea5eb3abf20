"""Property checks (histogram totals, stable CV, CSV quoting, prediction sink)."""
import os
import random

from hypothesis import given, settings, strategies as st

from tabsight.operators import evaluate as E
from tabsight.operators import models as MD
from tabsight.operators import plotdata as G
from tabsight.sources import io


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60),
       st.integers(1, 12))
def test_histogram_counts_sum_to_non_null(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = G.histogram(df, "x", bins).collect()
    non_null = sum(v is not None for v in values)
    assert sum(r["count"] for r in rows) == non_null
    if non_null:
        assert len(rows) == bins


def test_cv_is_stable_for_a_fixed_seed(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.random(), float(rnd.random() < 0.4)) for i in range(200)]
    df = E.stratified_folds(spark.createDataFrame(rows, "id long, x double, y double"), "y", "id")
    est = MD.make_classifier("tree", ["x"], [], label="y", max_depth=3)
    assert E.cv_scores(est, df, "y")[2] == E.cv_scores(est, df, "y")[2]


def test_csv_quotes_and_prediction_sink(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "train.csv")
    with open(path, "w") as f:
        f.write('PassengerId,Name,Age\n1,"Braund, Mr. Owen ""Jr""",22\n2,"Cumings, Mrs. John",\n')
    df = io.read_csv(spark, path, "PassengerId int, Name string, Age double")
    rows = df.orderBy("PassengerId").collect()
    assert rows[0].Name == 'Braund, Mr. Owen "Jr"' and rows[1].Age is None
    out = io.save_table(df, os.path.join(tmpdir_path, "out"), "csv")
    again = io.read_csv(spark, out, "PassengerId int, Name string, Age double")
    assert sorted(r.Name for r in again.collect()) == sorted(r.Name for r in rows)
