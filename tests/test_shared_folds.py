"""Column sets that share prepared folds, and candidates joined without moving the rows."""

import pytest

from tabsight.operators import candidates as CD
from tabsight.operators import evaluate as E
from tabsight.operators import models as MD
from tabsight.operators import prep
from tabsight.operators import select as SL


def _folded(spark):
    rows = [(k, float(k % 13), None if k % 9 == 0 else float(k % 5), ["a", "b", None][k % 3], float((k % 13) > 6)) for k in range(120)]
    return E.stratified_folds(spark.createDataFrame(rows, "id long, u double, v double, s string, y double"), "y", "id", k=3)


@pytest.mark.parametrize("name", ["logreg", "tree"])
def test_shared_folds_score_as_a_set_on_its_own(spark, name):
    data = _folded(spark)

    def build(num, cat):
        return MD.make_classifier(name, num, cat, label="y", id_col="id")
    with E.SharedFolds(lambda: build(["u", "v"], ["s"]), data, "fold", 3) as shared:
        for num, cat in ((["v"], ["s"]), (["u", "v"], [])):
            assert E.cv_scores(build(num, cat), data, "y", k=3, shared=shared)[2] == pytest.approx(E.cv_scores(build(num, cat), data, "y", k=3)[2])


def test_greedy_prepares_its_columns_once(spark, monkeypatch):
    # before, each score learned the preprocessing of all its columns anew
    calls = []
    own = prep.Preprocessor.fit_folds
    monkeypatch.setattr(prep.Preprocessor, "fit_folds", lambda self, *a: calls.append(self.num) or own(self, *a))

    def build(cols):
        return MD.make_classifier("logreg", [c for c in cols if c != "s"], [c for c in cols if c == "s"], label="y", id_col="id", max_iter=20)
    selected, history = SL.greedy_select(build, _folded(spark), ["v"], ["s", "u"], "y", k=3)
    assert selected == ["u"] and history.count() == 2
    assert calls == [["v", "u"]]


def test_small_tables_are_joined_without_a_shuffle_of_the_rows(spark, monkeypatch):
    df = spark.createDataFrame([(k, "ab"[k % 2] if k % 7 else None, float(k % 4)) for k in range(60)], "id long, g string, v double")
    registry = [("freq(g)", "freq", ["g"], None), ("mean", "groupby_then_mean", ["g", "v"], None), ("rank", "groupby_then_rank", ["g", "v"], None)]
    small = CD.apply_candidates(df, registry)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    monkeypatch.setattr(CD, "BROADCAST_CELLS", 0)
    assert sorted(map(str, CD.apply_candidates(df, registry).collect())) == sorted(map(str, small.collect()))
