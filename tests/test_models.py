"""Folds, KNN against brute force, preparation stages, CV runs."""
import math
import random

import pytest
from pyspark.sql import functions as F

from tabsight.operators import evaluate as E
from tabsight.operators import models as MD
from tabsight.operators import prep as M


def test_folds_balanced(spark):
    rows = [(i, int(i % 7 == 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y int")
    folds = E.stratified_folds(df, "y", "id", k=5)
    counts = {}
    for r in folds.groupBy("y", "fold").count().collect():
        counts.setdefault(r.y, []).append(r["count"])
    for y, c in counts.items():
        assert len(c) == 5 and max(c) - min(c) <= 1


def test_knn_brute_force(spark):
    rnd = random.Random(3)
    train = [(i, [rnd.random(), rnd.random(), rnd.random()], float(i % 3)) for i in range(120)]
    query = [(1000 + i, [rnd.random(), rnd.random(), rnd.random()]) for i in range(30)]
    t = spark.createDataFrame(train, "tid long, tv array<double>, tlabel double")
    q = spark.createDataFrame(query, "qid long, qv array<double>")
    nb = MD.knn_neighbours(q, t, k=4, p=2, block_rows=25)  # several blocks on both sides
    got = {}
    for r in nb.collect():
        got.setdefault(r.qid, []).append((r.rank, r.tid))
    for qid, qv in query:
        d = sorted((math.dist(qv, tv), tid) for tid, tv, _ in train)[:4]
        assert [tid for _, tid in sorted(got[qid])] == [tid for _, tid in d]


@pytest.mark.parametrize("p", [1, 2])
def test_knn_leaves_far_blocks_out(spark, p):
    import numpy as np
    from tabsight.operators.knn import PivotCells
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 4)) * 50
    train = np.concatenate([c + rng.normal(size=(150, 4)) for c in centres] + [np.repeat(centres[:1], 300, axis=0)])  # and many equal rows
    query = np.concatenate([train[::13], rng.normal(size=(20, 4)) * 50])
    t = spark.createDataFrame([(k, v.tolist(), float(k % 2)) for k, v in enumerate(train)], "tid long, tv array<double>, tlabel double")
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(query)] + [(9999, None)], "qid long, qv array<double>")
    cells = PivotCells(t, p, block_rows=40)
    got = {}
    for r in cells.neighbours(q, 7, block_rows=50).collect():
        got.setdefault(r.qid, []).append((r.rank, r.dist, r.tid))
    d = np.abs(query[:, None] - train[None]).sum(axis=2) if p == 1 else np.sqrt(((query[:, None] - train[None]) ** 2).sum(axis=2))
    for k in range(len(query)):
        order = np.lexsort((np.arange(len(train)), d[k]))[:7]
        assert [x[2] for x in sorted(got[k])] == order.tolist()
        assert [x[1] for x in sorted(got[k])] == pytest.approx(d[k, order].tolist(), abs=1e-12)
    assert 9999 not in got and cells.compared < 0.35 * d.size
    # fewer rows than neighbours
    few = MD.knn_neighbours(q.limit(3), t.limit(2), 5, p)
    assert few.count() == 6 and MD.knn_neighbours(q, t.limit(0), 5, p).count() == 0


def test_imputers_scaler_and_unknown_categories(spark):
    train = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "b"), (10.0, "c")], "x double, s string")
    test = spark.createDataFrame([(None, "a"), (2.0, "zz"), (4.0, None)], "x double, s string")
    med = M.ExactImputer(inputCols=["x"], strategy="median").fit(train)
    assert [r.x for r in med.transform(test).collect()] == [3.0, 2.0, 4.0]
    mode = M.ExactImputer(inputCols=["s"], strategy="most_frequent").fit(train)
    assert [r.s for r in mode.transform(test).collect()] == ["a", "zz", "b"]
    sc = M.PopulationScaler(inputCols=["x"]).fit(spark.createDataFrame([(float(i),) for i in range(4)], "x double"))
    vals = [r.x for r in sc.transform(spark.createDataFrame([(0.0,), (3.0,)], "x double")).collect()]
    assert vals[0] == pytest.approx(-1.5 / math.sqrt(1.25))
    idx = M.CategoryIndexer(inputCols=["s"], outputCols=["i"]).fit(train)
    assert [r.i for r in idx.transform(test).collect()] == [0, -1, -1]
    from pyspark.ml import Pipeline
    oh = Pipeline(stages=M.one_hot_stages(["s"])).fit(train)
    vecs = [r["s__oh"].toArray().tolist() for r in oh.transform(test).collect()]
    assert vecs == [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_cv_logreg_beats_majority(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        x = rnd.gauss(0, 1)
        rows.append((i, x, "u" if rnd.random() < 0.5 else "v", float(x + rnd.gauss(0, 0.3) > 0)))
    df = E.stratified_folds(spark.createDataFrame(rows, "id long, x double, c string, y double"), "y", "id")
    est = MD.make_classifier("logreg", ["x"], ["c"], label="y", max_iter=50)
    mean, std, scores = E.cv_scores(est, df, "y")
    majority = max(sum(r[3] for r in rows), 400 - sum(r[3] for r in rows)) / 400
    assert len(scores) == 5 and mean > majority and std >= 0


def test_most_frequent_ties_numeric_order(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, "a"), (9, "b"), (None, None)], "n int, s string")
    assert M.most_frequent_values(df, ["n", "s"]) == {"n": 9, "s": "a"}


def _labelled(spark, n=200):
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        y = int(i % 5 == 0)
        rows.append((i, rnd.gauss(y * 2.0, 1.0), rnd.choice("ab"), float(y)))
    return spark.createDataFrame(rows, "id long, x double, s string, label double")


def test_unknown_parameters_raise_and_aliases_work():
    with pytest.raises(ValueError):
        MD.classifier_stage("tree", nonsense=1)
    with pytest.raises(ValueError):
        MD.classifier_stage("gb", reg_lambda=1.0)
    with pytest.raises(ValueError):
        MD.classifier_stage("tree", class_weight={0: 1})
    for alias, name in MD.ALIASES.items():
        assert type(MD.classifier_stage(alias)) is type(MD.classifier_stage(name))
    tree = MD.classifier_stage("dt", max_features="sqrt", random_state=7)
    assert (tree.getNumTrees(), tree.getFeatureSubsetStrategy(), tree.getBootstrap(), tree.getSeed()) == (1, "sqrt", False, 7)
    assert MD.classifier_stage("rf", min_samples_split=20, min_samples_leaf=2).getMinInstancesPerNode() == 10
    assert MD.classifier_stage("lgbm", num_leaves=4, max_depth=9).getMaxDepth() == 2


def test_balanced_classes_raise_the_rare_ones_scores(spark):
    df = _labelled(spark)
    rate = {}
    for weight in (None, "balanced"):
        model = MD.make_classifier("lr", ["x"], ["s"], class_weight=weight).fit(df)
        rate[weight] = model.transform(df).agg(F.avg("prediction")).first()[0]
    assert rate["balanced"] > rate[None]


def test_knn_pipeline_is_saved_and_loaded(spark, tmpdir_path):
    from tabsight.sources import io
    df = _labelled(spark)
    model = MD.make_classifier("kneighbors", ["x"], ["s"], n_neighbors=5).fit(df)
    io.save_model(model, f"{tmpdir_path}/knn")
    again = io.load_model(f"{tmpdir_path}/knn")
    first = {r.id: r.prediction for r in model.transform(df).collect()}
    assert {r.id: r.prediction for r in again.transform(df).collect()} == first


def test_empty_fold_is_refused(spark):
    df = _labelled(spark, 20).withColumn("fold", F.lit(0))
    with pytest.raises(ValueError):
        E._fold_score(MD.make_classifier("tree", ["x"], []), df, "label", "fold", 3, "accuracy")


def test_permuted_column_is_a_permutation_by_the_documented_order(spark):
    import hashlib
    from tabsight.operators.select import permute_column
    df = _labelled(spark, 60)
    rows = {r.id: r.x for r in df.collect()}
    order = sorted(rows, key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())
    want = {i: rows[j] for i, j in zip(sorted(rows), order)}
    assert {r.id: r.x for r in permute_column(df, "x", "id", 3).collect()} == want


def test_scores_by_hand(spark):
    from pyspark.ml.linalg import Vectors
    rows = [(1.0, 1.0, 0.9), (1.0, 0.0, 0.4), (0.0, 1.0, 0.6), (0.0, 0.0, 0.2), (1.0, 1.0, 0.7)]
    pred = spark.createDataFrame([(y, p, Vectors.dense([1 - q, q])) for y, p, q in rows], ["label", "prediction", "probability"])
    r = E.binary_scores(pred, "label").first()
    assert (r.precision, r.recall, r.f1) == (pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3))
    want = -sum(math.log(q if y else 1 - q) for y, _, q in rows) / 5
    assert E.log_loss(pred, "label").first()[0] == pytest.approx(want)
    none = spark.createDataFrame([(0.0, 0.0)], "label double, prediction double")
    assert tuple(E.binary_scores(none, "label").first()) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("scoring", ["f1", "neg_log_loss", "roc_auc"])
def test_cross_validation_takes_other_scores(spark, scoring):
    df = E.stratified_folds(_labelled(spark, 100), "label", "id", k=2)
    mean, _, scores = E.cv_scores(MD.make_classifier("logreg", ["x"], ["s"]), df, "label", k=2, scoring=scoring)
    assert len(scores) == 2 and (mean <= 0) == (scoring == "neg_log_loss")


def test_removal_combinations_have_no_default_limit(spark, monkeypatch):
    from tabsight.operators import select
    monkeypatch.setattr(select, "_score", lambda builder, data, cols, label, fold_col, k: (float(len(cols)), 0.0, None))
    names = [f"c{k}" for k in range(11)]
    data = spark.createDataFrame([(1, 0)], "label int, fold int")
    assert select.removal_combinations(None, data, names, names, "label").count() == 2 ** 11
    with pytest.raises(ValueError):
        select.removal_combinations(None, data, names, names, "label", max_candidates=10)


def test_category_table_spans_partitions_and_is_saved(spark, tmpdir_path):
    from pyspark.ml import PipelineModel
    values = [f"k{k:05d}" for k in range(3000)] + ["ä", "Z", ""]
    df = spark.createDataFrame([(v, None if k % 5 == 0 else f"g{k % 4}") for k, v in enumerate(values)], "s string, t string")
    model = M.CategoryIndexer(inputCols=["s", "t"], outputCols=["i", "j"]).fit(df)
    order = {v: k for k, v in enumerate(sorted(values, key=str.encode))}
    rows = model.transform(df).collect()
    assert {r.s: r.i for r in rows} == order and {(r.t, r.j) for r in rows} == {(None, -1), ("g0", 0), ("g1", 1), ("g2", 2), ("g3", 3)}
    from pyspark.ml import Pipeline
    fitted = Pipeline(stages=M.one_hot_stages(["t"])).fit(df)
    fitted.write().overwrite().save(f"{tmpdir_path}/m")
    test = spark.createDataFrame([("g1",), ("new",), (None,)], "t string")
    again = PipelineModel.load(f"{tmpdir_path}/m")
    assert [r["t__oh"].toArray().tolist() for r in again.transform(test).collect()] == [[0, 1, 0, 0], [0] * 4, [0] * 4]


def test_long_dictionaries_are_joined(spark, monkeypatch):
    monkeypatch.setattr(M, "FEW_CATEGORIES", 1)
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    model = M.CategoryIndexer(inputCols=["s"], outputCols=["i"], handleUnknown="last").fit(df)
    assert {r.s: r.i for r in model.transform(df).collect()} == {"a": 0, "b": 1, None: 2}


def _stage_frame(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(240):
        x, g = rnd.random() + 0.1, rnd.choice("abc")
        rows.append((k, x, rnd.random() + 0.1, g, float(x * {"a": 1, "b": 2, "c": 3}[g] > 1.0)))
    return E.stratified_folds(spark.createDataFrame(rows, "id long, x double, z double, g string, y double"), "y", "id", k=3)


def test_candidate_stage_is_saved_and_transforms_alike(spark, tmpdir_path, monkeypatch):
    from tabsight.operators import candidates as CD
    from tabsight.operators import select
    # the score of a set is the number of its columns: everything offered is selected
    monkeypatch.setattr(select, "_score", lambda builder, data, cols, label, fold_col, k: (float(len(cols)), 0.5, None))
    df = _stage_frame(spark)
    stage = CD.CandidateFeatureStage(None, ["x", "z"], ["g"], "y", n_features=12, corr_threshold=0.999, unary=["log", "freq"], binary=["/"],
                                     group=["mean", "median"])
    model = stage.fit(df)
    assert model.selected_ and any(n.startswith("groupby") for n in model.selected_)
    reg = model.registry_.collect()
    assert [r.selected for r in reg] == sorted((r.selected for r in reg), reverse=True) and {r.greedy_std for r in reg if r.selected} == {0.5}
    model.write().save(f"{tmpdir_path}/stage")
    again = CD.CandidateFeatureModel.load(f"{tmpdir_path}/stage")
    new = df.where("id % 3 = 0")  # group statistics stay those of the fit
    first = sorted(map(str, model.transform(new).collect()))
    assert again.selected_ == model.selected_ and sorted(map(str, again.transform(new).collect())) == first
    means = {r.g: r.m for r in df.groupBy("g").agg(F.avg("x").alias("m")).collect()}
    name = "groupby_then_mean(g,x)"
    if name in model.selected_:
        assert all(abs(r[name] - means[r.g]) < 1e-12 for r in model.transform(new).collect())
    off = CD.CandidateFeatureStage(None, ["x"], ["g"], "y", enabled=False).fit(df)
    assert off.transform(df).columns == df.columns


def test_candidate_scores_equal_one_by_one(spark):
    from tabsight.operators import assoc as A
    from tabsight.operators import candidates as CD
    df = _stage_frame(spark)
    rows = CD.candidate_rows(["x", "z"], ["g"])
    got = {r.column: r.score for r in CD.score_candidates(df, rows, "y", at_once=7).collect()}
    wide = CD.apply_candidates(df, rows).checkpoint()  # group means must not differ between scans in their last bit
    names = [r[0] for r in rows]
    want = {r.feature: r.mi for r in A.mutual_info(wide, names, "y", discrete={n: False for n in names}).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_search_and_experiment(spark, tmpdir_path):
    from tabsight.operators import tune as TN
    from tabsight.plans.experiment import run_experiment
    from tabsight.sources import io
    import numpy as np
    for name, space in TN.SPACES.items():
        params = TN.draw(space, np.random.default_rng(1))
        MD.classifier_stage(name.removesuffix("_wide"), **params)
    df = E.stratified_folds(_labelled(spark, 120), "label", "id", k=3)
    build = lambda p: MD.make_classifier("logreg", ["x"], ["s"], max_iter=20, **p)
    trials, best, model = TN.search(build, "logreg", df, "label", n_iter=3, k=3)
    rows = trials.collect()
    assert len(rows) == 3 and [r.mean for r in rows] == sorted((r.mean for r in rows), reverse=True)
    assert 0.01 <= best["C"] <= 8.0 and model.transform(df).count() == 120
    with pytest.raises(ValueError):
        TN.search(build, "nothing", df, "label")
    scores, fitted = run_experiment(_labelled(spark, 120), "label", "id", ["x"], ["s"], params={"max_iter": 20}, k=3,
                                    log_path=f"{tmpdir_path}/log", model_path=f"{tmpdir_path}/model")
    assert len(scores.first().scores) == 3 and io.load_experiments(spark, f"{tmpdir_path}/log").count() == 1
    io.save_predictions(fitted, df, "id", "label_out", f"{tmpdir_path}/pred")
    assert io.load_model(f"{tmpdir_path}/model").transform(df).count() == 120


@pytest.mark.parametrize("encoding,scale", [("onehot", True), ("ordinal", False)])
def test_fold_statistics_equal_fits_on_the_other_folds(spark, encoding, scale):
    rnd = random.Random(8)
    rows = [(i, None if rnd.random() < 0.2 else round(rnd.gauss(5, 2), 1), rnd.randint(0, 3) if rnd.random() < 0.9 else None,
             None if rnd.random() < 0.1 else rnd.choice("aabcd"), f"only{i}" if i % 50 == 0 else "x", i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, n int, s string, t string, fold int")
    pre = M.build_preprocessor(["x", "n"], ["s", "t"], encoding, scale)
    for f, model in enumerate(pre.fit_folds(df, "fold", 4)):
        want = pre.fit(df.where(F.col("fold") != f))
        a, b = ({r.id: r.features.toArray().tolist() for r in m.transform(df).collect()} for m in (model, want))
        assert a.keys() == b.keys()
        for i in a:
            assert a[i] == pytest.approx(b[i], abs=1e-9)


def test_cross_validation_equals_a_fit_per_fold(spark):
    df = E.stratified_folds(_labelled(spark, 150), "label", "id", k=3)
    est = MD.make_classifier("tree", ["x"], ["s"])
    mean, _, scores = E.cv_scores(est, df, "label", k=3)
    assert scores == pytest.approx([E._fold_score(est, df, "label", "fold", f, "accuracy") for f in range(3)])
