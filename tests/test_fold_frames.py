"""What the fits of many column sets read, and which scores they share."""

from tabsight.operators import evaluate as E
from tabsight.operators import models as MD
from tabsight.operators import prep
from tabsight.operators import select as SL


def _folded(spark):
    rows = [(k, float(k % 13), None if k % 9 == 0 else float(k % 5), ["a", "b", None][k % 3], float((k % 13) > 6)) for k in range(120)]
    return E.stratified_folds(spark.createDataFrame(rows, "id long, u double, v double, s string, y double"), "y", "id", k=3).repartition(8)


def _build(cols):
    return MD.make_classifier("logreg", [c for c in cols if c != "s"], [c for c in cols if c == "s"], label="y", id_col="id", max_iter=20)


def test_fold_frames_have_parts_by_rows(spark, monkeypatch):
    # before, each of a fit's jobs had a task for every part of the input, however few its rows
    data = _folded(spark).cache()
    for at_once, parts in ((1 << 16, 1), (50, 3)):
        monkeypatch.setattr(E, "ROWS_AT_ONCE", at_once)
        with E.SharedFolds(lambda: _build(["u", "v", "s"]), data, "fold", 3) as shared:
            frames = shared.prepared(_build(["u", "s"]))[1]
            assert [f.rdd.getNumPartitions() for f in frames] == [parts] * 3
            assert {f.count() for f in frames} == {120}
    data.unpersist()


def test_runs_over_the_same_folds_score_a_set_once(spark, monkeypatch):
    # before, ablation and greedy search prepared the folds and scored the base columns each on their own
    sets, folds, scores, prepare = [], [], SL.cv_scores, prep.Preprocessor.fit_folds
    monkeypatch.setattr(SL, "cv_scores", lambda est, *a, **k: sets.append(tuple(est.getStages()[0].num + est.getStages()[0].cat)) or scores(est, *a, **k))
    monkeypatch.setattr(prep.Preprocessor, "fit_folds", lambda self, *a: folds.append(self.num) or prepare(self, *a))
    data = _folded(spark).cache()
    alone = SL.greedy_select(_build, data, ["v"], ["u"], "y", k=3)
    sets.clear(), folds.clear()
    with E.SharedFolds(lambda: _build(["v", "u"]), data, "fold", 3) as shared:
        SL.batch_ablation(_build, data, ["v"], ["u"], "y", step=1, k=3, shared=shared)
        selected, history = SL.greedy_select(_build, data, ["v"], ["u"], "y", k=3, shared=shared)
    assert sorted(sets) == [("v",), ("v", "u")] and folds == [["v", "u"]]
    assert selected == alone[0] and history.collect() == alone[1].collect()
    data.unpersist()


def test_logistic_regression_is_fitted_without_slot_names(spark, monkeypatch):
    # before, every task of a fit carried the names of all categories
    seen, own = [], MD.LogisticRegression.fit
    monkeypatch.setattr(MD.LogisticRegression, "fit", lambda self, df: seen.append(df.schema) or own(self, df))
    model = _build(["u", "s"]).fit(_folded(spark))
    assert seen[0].names == ["features", "y"] and not seen[0]["features"].metadata
    assert len(MD.feature_names(model, _folded(spark))) == model.stages[-1].coefficients.size
