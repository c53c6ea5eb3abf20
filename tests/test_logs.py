"""The mixed experiment-log formats (line shapes retyped as test strings)."""
import json

from tabsight.sources.logs import parse_log_lines

LINES = [
    "2026-04-24 16:27:16 | drop_features | score=0.8305 | std=0.0115 | drop=SibSp,Parch",
    '{"ts": "2026-04-25 13:54:09", "run_id": "compare_v1_2", "name": "RandomForest(n=300, depth=5)", '
    '"score": 0.832766, "std": 0.009757, "params": {"n_estimators": 300, "max_depth": 5}, '
    '"tags": {"model": "rf", "dataset": "passengers"}}',
    "2026-04-25 21:34:14 logreg score=0.830525 std=0.011483 params={}",
    "[2026-04-25 16:53:24] INFO    trainer — LogisticRegression(C=100, penalty=l2) | score=0.8305 ± 0.0115 "
    "| params={'max_iter': 2000, 'C': 100} | run_id=logreg_baseline",
    "garbage line",
    "",
]


def test_parse_all_formats(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    rows = parse_log_lines(df).collect()
    assert [r.fmt for r in rows] == ["pipe", "json", "plain", "trainer", "unparsed"]
    pipe, js, plain, tr, bad = rows
    assert (pipe.name, pipe.score, pipe.std, pipe.params) == ("drop_features", 0.8305, 0.0115, "drop=SibSp,Parch")
    assert (js.run_id, js.score, js.tags["model"]) == ("compare_v1_2", 0.832766, "rf")
    assert '"n_estimators": 300' in js.params
    assert (plain.name, plain.score, plain.params) == ("logreg", 0.830525, "{}")
    assert (tr.name, tr.score, tr.std, tr.run_id) == ("LogisticRegression(C=100, penalty=l2)", 0.8305,
                                                      0.0115, "logreg_baseline")
    assert all(r.ts is not None for r in rows[:4]) and bad.ts is None


def test_experiment_log_roundtrip(spark, tmpdir_path):
    from tabsight.sources import io
    path = tmpdir_path + "/exp"
    io.log_experiment(spark, path, "logreg", 0.8305251, 0.0114832, {"C": 100}, run_id="r1")
    io.log_experiment(spark, path, "rf", 0.83, 0.01, {"n_estimators": 300}, run_id="r2")
    rows = sorted(io.load_experiments(spark, path).collect(), key=lambda r: r.run_id)
    assert [(r.name, r.score) for r in rows] == [("logreg", 0.830525), ("rf", 0.83)]
    assert io.load_experiments(spark, tmpdir_path + "/missing").count() == 0


def test_truncated_and_nested_json(spark):
    lines = ['{"ts": "2026-04-25 13:54:09", "name": "cut off", "score": 0.8',
             '{"ts": "2026-04-25 13:54:09", "name": "deep", "score": 0.5, "std": 0.1, "params": {"a": {"b": 1}, "c": 2}}']
    cut, deep = parse_log_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (cut.fmt, cut.raw, cut.name) == ("unparsed", lines[0], None)
    assert (deep.fmt, json.loads(deep.params), deep.raw) == ("json", {"a": {"b": 1}, "c": 2}, None)
