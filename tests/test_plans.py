"""Report plan and the streaming log ingest."""
import os

from tabsight.plans.report import TableProfile


def test_full_report_runs(spark):
    rows = [(i, float(i % 7), "a" if i % 3 else "b", None if i % 5 == 0 else i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, s string, y int")
    prof = TableProfile(df, target="y")
    assert prof.get_col_type("y") == "categorical" and prof.get_col_type("x") == "numeric"
    assert prof.get_col_pair_type("x", "s") == ("numeric", "categorical")
    assert prof.plot_roles("x") == {"numeric", "categorical"}  # 7 distinct numbers
    rep = prof.full_report()
    for name, frame in rep.items():
        frame.collect()
    assert {"overview", "missing", "numeric_summary", "categorical_summary", "correlation_matrix",
            "multicollinearity", "target_summary", "target_correlation", "low_variance_columns"} <= set(rep)


def test_streaming_log_ingest(spark, tmpdir_path):
    from tabsight.streaming.logs import start_log_ingest
    src = os.path.join(tmpdir_path, "logs")
    os.makedirs(src)
    with open(os.path.join(src, "a.log"), "w") as f:
        f.write("2026-04-25 21:34:14 logreg score=0.830525 std=0.011483 params={}\n")
        f.write("2026-04-24 16:27:16 | drop_features | score=0.8305 | std=0.0115 | drop=SibSp,Parch\n")
    out = os.path.join(tmpdir_path, "table")
    q = start_log_ingest(spark, src, out, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    got = sorted((r.fmt, r.score) for r in spark.read.parquet(out).collect())
    assert got == [("pipe", 0.8305), ("plain", 0.830525)]
