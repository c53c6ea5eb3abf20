"""An experiment run: features -> folds -> cross-validation -> log -> refit -> save.

``feature_plan`` holds steps that look at one row at a time and is applied once.  What
a feature learns from other rows (bin edges, group sizes) goes into ``learned``, ML
stages that are fitted with the model inside each fold, so no fold sees its held-out
rows.  The folded frame is cached for the k fits and released afterwards.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame

from tabsight.operators.evaluate import cv_frame, cv_scores, stratified_folds
from tabsight.operators.models import make_classifier
from tabsight.sources import io


def prepare(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
            feature_plan=None) -> DataFrame:
    data = feature_plan.transform(df) if feature_plan is not None else df
    return stratified_folds(data.withColumn(label, data[label].cast("double")), label, key, k, seed)


def run_experiment(df: DataFrame, label: str, key: str, num_cols: list[str], cat_cols: list[str],
                   model: str = "logreg", params: dict | None = None, k: int = 5, seed: int = 42,
                   feature_plan=None, log_path: str | None = None, model_path: str | None = None,
                   run_id: str | None = None, learned: list | None = None):
    """Returns (one-row score DataFrame, fitted pipeline)."""
    spark = df.sparkSession
    data = prepare(df, label, key, k, seed, feature_plan).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        est = make_classifier(model, num_cols, cat_cols, label=label, id_col=key, **(params or {}))
        if learned:
            est = Pipeline(stages=[*learned, *est.getStages()])
        mean, std, scores = cv_scores(est, data, label, "fold", k)
        if log_path:
            io.log_experiment(spark, log_path, model, mean, std, params, run_id=run_id,
                              tags={"model": model})
        fitted = est.fit(data)
        if model_path:
            io.save_model(fitted, model_path)
        return cv_frame(spark, model, mean, std, scores), fitted
    finally:
        data.unpersist()
