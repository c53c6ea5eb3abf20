"""Stratified folds and cross-validated scoring of ``pyspark.ml`` pipelines.

Folds: within each class, rows are ordered by ``md5('<seed>:' || key)`` (key as
tie-break) and dealt round-robin: fold = position % k.  The position is a
running count computed with the bucketed prefix of ``operators.ranks`` - buckets
come from the numeric value of the first 15 hex digits of the hash, which sorts
like the hash itself - so a class holding most rows is still spread over many
tasks.  The same folds are reproducible in SQL with ``row_number()``.

``cv_scores`` fits one model per fold on the other folds (each fit is a
distributed job; folds run on a small driver thread pool) over a cached,
prepared frame, and returns mean, population std and the per-fold scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

from tabsight.operators.ranks import ordered_prefix
from tabsight.session import ensure_checkpoint_dir

SEED = 42
N_SPLITS = 5
#: Rows of a prepared fold that one task reads: a fit is many short jobs, and a task of few rows costs more than its work.
ROWS_AT_ONCE = 1 << 16


def stratified_folds(df: DataFrame, label: str, key: str, k: int = N_SPLITS, seed: int = SEED,
                     fold_col: str = "fold") -> DataFrame:
    """Adds ``fold_col`` in 0..k-1, balanced per class."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    base = (df.withColumn("__h", h)
              .withColumn("__one", F.lit(1)))
    pos = ordered_prefix(base, [label], "__h", "__one", out_col="__pos", tiebreak=[key])
    return (pos.withColumn(fold_col, (F.col("__pos") % k).cast("int"))
               .drop("__h", "__one", "__pos"))


class cached_frame:
    """Context manager: persist a frame for a block of CV runs unless already cached."""

    def __init__(self, data: DataFrame):
        self.data = data
        self.own = not data.storageLevel.useMemory and not data.storageLevel.useDisk

    def __enter__(self) -> DataFrame:
        if self.own:
            self.data = self.data.persist(StorageLevel.MEMORY_AND_DISK)
            self.data.count()  # fill the cache once, before parallel fits read it
        return self.data

    def __exit__(self, *exc):
        if self.own:
            self.data.unpersist()
        return False


def accuracy(pred: DataFrame, label: str, pred_col: str = "prediction") -> DataFrame:
    return pred.agg(F.avg((F.col(pred_col) == F.col(label).cast("double")).cast("double"))
                    .alias("accuracy"))


def binary_scores(pred: DataFrame, label: str, pred_col: str = "prediction") -> DataFrame:
    """One row: precision, recall and f1 of class 1 (0 where undefined)."""
    y, p = F.col(label).cast("double") == 1.0, F.col(pred_col) == 1.0
    counts = pred.agg(F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(~y & p, 1)).alias("fp"), F.count(F.when(y & ~p, 1)).alias("fn"))

    def share(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp = F.col("tp")
    return counts.select(share(tp, tp + F.col("fp")).alias("precision"), share(tp, tp + F.col("fn")).alias("recall"),
                         share(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def log_loss(pred: DataFrame, label: str, probability: str = "probability") -> DataFrame:
    """One row: mean negative log likelihood of the labels 0 and 1."""
    p = F.least(F.greatest(vector_to_array(F.col(probability))[1], F.lit(1e-15)), F.lit(1 - 1e-15))
    return pred.agg((-F.avg(F.when(F.col(label).cast("double") == 1.0, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def _prepared_folds(estimator, data: DataFrame, fold_col: str, k: int):
    """(what is left to fit, the frame prepared for each fold): preprocessing is learned for all folds at once where it can be."""
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else []
    if not stages or not hasattr(stages[0], "fit_folds"):
        return estimator, [data] * k
    return Pipeline(stages=stages[1:]), [m.transform(data) for m in stages[0].fit_folds(data, fold_col, k)]


def _unnamed(frame: DataFrame, col: str):
    """The column; of a vector's metadata only the size, as tasks would carry a name for each category."""
    size = frame.schema[col].metadata.get("ml_attr", {}).get("num_attrs") if isinstance(frame.schema[col].dataType, VectorUDT) else None
    return F.col(f"`{col}`") if size is None else F.col(f"`{col}`").alias(col, metadata={"ml_attr": {"num_attrs": size}})


class SharedFolds:
    """The frames of all folds with the union of many column sets imputed, scaled and encoded once.

    What preprocessing learns of a column and a fold does not depend on the other columns, so a set of columns only has
    to be assembled.  ``make`` gives the estimator of all columns, asked for at the first score; an estimator that prepares
    a column otherwise, or without preprocessing by ``prep.Preprocessor``, is scored on its own.

    The frames are saved, so that no job of a fit carries the plan that prepared them, with ROWS_AT_ONCE rows to a part.
    ``scores`` has what ``select`` found for a set of columns.
    """

    def __init__(self, make: Callable[[], object], data: DataFrame, fold_col: str, k: int):
        self.make, self.data, self.fold_col, self.k = make, data, fold_col, k
        self.frames, self.prep, self.lock, self.ready = [], None, Lock(), False
        self.scores: dict[tuple, tuple[float, float, list[float]]] = {}

    def _prepare(self) -> None:
        from tabsight.operators.prep import Preprocessor
        estimator = self.make()
        stages = estimator.getStages() if isinstance(estimator, Pipeline) else []
        if not stages or type(stages[0]) is not Preprocessor or not (stages[0].num or stages[0].cat):
            return
        self.prep = stages[0]
        ensure_checkpoint_dir(self.data.sparkSession)
        tasks = max(1, math.ceil(self.data.count() / ROWS_AT_ONCE))
        for m in self.prep.fit_folds(self.data, self.fold_col, self.k):
            frame = self.data
            for stage in m.stages[:-1]:
                frame = stage.transform(frame)
            # no column set sees more of the prepared columns than what it assembles
            parts = m.stages[-1].getInputCols()
            frame = frame.select(*[F.col(f"`{c}`") for c in self.data.columns], *[_unnamed(frame, c) for c in parts])
            self.frames.append(frame.coalesce(tasks).checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK))
        for frame in self.frames:
            frame.count()  # fill the cache once, before parallel fits read it

    def __enter__(self) -> "SharedFolds":
        return self

    def __exit__(self, *exc):
        for frame in self.frames:
            frame.unpersist()
        return False

    def prepared(self, estimator) -> tuple:
        """(what is left to fit, the frame of each fold)."""
        with self.lock:
            if not self.ready:
                self._prepare()
                self.ready = True
        stages = estimator.getStages() if isinstance(estimator, Pipeline) else []
        own = stages[0] if stages else None
        if not self.frames or type(own) is not type(self.prep) or (own.encoding, own.scale) != (self.prep.encoding, self.prep.scale) \
                or not (set(own.num) <= set(self.prep.num) and set(own.cat) <= set(self.prep.cat)):
            return _prepared_folds(estimator, self.data, self.fold_col, self.k)
        return Pipeline(stages=stages[1:]), [own.assembler().transform(frame) for frame in self.frames]


def _fold_score(estimator, data: DataFrame, label: str, fold_col: str, f: int,
                scoring: str) -> float:
    train = data.where(F.col(fold_col) != f)
    test = data.where(F.col(fold_col) == f)
    model = estimator.fit(train)
    pred = model.transform(test)
    if scoring == "accuracy":
        share = accuracy(pred, label).first()[0]
        if share is None:
            raise ValueError(f"fold {f} has no rows to score")
        return float(share)
    if scoring in ("precision", "recall", "f1"):
        return float(binary_scores(pred, label).first()[scoring])
    if scoring == "neg_log_loss":
        return -float(log_loss(pred, label).first()[0])
    if scoring == "roc_auc":
        from pyspark.ml.evaluation import BinaryClassificationEvaluator
        return float(BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
                     .evaluate(pred))
    raise ValueError(f"unknown scoring '{scoring}'")


def cv_scores(estimator, data: DataFrame, label: str, fold_col: str = "fold",
              k: int = N_SPLITS, scoring: str = "accuracy",
              parallelism: int = 5, shared: SharedFolds | None = None) -> tuple[float, float, list[float]]:
    """(mean, population std, per-fold scores) of ``estimator`` over the folds.

    The folded frame is cached for the k fits (each fit makes several passes)
    unless the caller already cached it; what preprocessing learns comes from one pass for all folds,
    or from ``shared``, made of the same frame and folds for many column sets.
    """
    with cached_frame(data) as rows, ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        rest, frames = shared.prepared(estimator) if shared is not None else _prepared_folds(estimator, rows, fold_col, k)
        scores = list(ex.map(lambda f: _fold_score(rest, frames[f], label, fold_col, f, scoring), range(k)))
    mean = sum(scores) / len(scores)
    std = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    return mean, std, scores


def cv_frame(spark, name: str, mean: float, std: float, scores: list[float]) -> DataFrame:
    return spark.createDataFrame([(name, float(mean), float(std), [float(s) for s in scores])],
                                 "model string, mean double, std double, scores array<double>")


def compare_models(builders: dict, data: DataFrame, label: str, fold_col: str = "fold",
                   k: int = N_SPLITS, scoring: str = "accuracy") -> DataFrame:
    """Table (model, mean, std, scores) ordered by mean desc."""
    spark = data.sparkSession
    rows = []
    with cached_frame(data) as cached:
        for name, build in builders.items():
            m, s, sc = cv_scores(build(), cached, label, fold_col, k, scoring)
            rows.append((name, m, s, sc))
    df = spark.createDataFrame(rows, "model string, mean double, std double, scores array<double>")
    return df.orderBy(F.desc("mean"), "model")
