"""Classifiers behind one factory, with scikit-style parameter names mapped to Spark.

``make_classifier(name, num_cols, cat_cols, label, **params)`` returns a
``Pipeline(preprocessor + classifier)``.  Names: logreg, knn, tree, rf, gb and the
boosted-tree aliases catboost / lgbm / xgb (all on ``GBTClassifier``).

* logistic regression: the inverse strength C weighs the summed loss, Spark
  averages it, so ``regParam = 1 / (C * n_train)`` is set at fit time;
* k nearest neighbours: exact, see ``KNNClassifier``.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.operators.knn import knn_neighbours
from tabsight.operators.prep import TableReader, TableWriter, build_preprocessor

SEED = 42

# Fixed defaults of the model stage.
DEFAULT_PARAMS = {
    "logreg": {"max_iter": 2000, "C": 1.0, "l1_ratio": 0.0},
    "knn": {"n_neighbors": 14, "weights": "distance", "p": 2},
    "tree": {"max_depth": 7, "min_samples_leaf": 5},
    "rf": {"n_estimators": 300, "criterion": "gini", "max_depth": 5, "min_samples_split": 10,
           "min_samples_leaf": 4},
    "gb": {"n_estimators": 300, "learning_rate": 0.03, "max_depth": 2, "min_samples_leaf": 3},
    "catboost": {"iterations": 300, "learning_rate": 0.05, "depth": 3},
    "lgbm": {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 3, "subsample": 0.9,
             "colsample_bytree": 0.9},
    "xgb": {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 3, "subsample": 0.9,
            "colsample_bytree": 0.9},
}


# ----------------------------------------------------------------------------- M8
class InverseStrengthLogisticRegression(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol):
    """Logistic regression with an inverse regularisation strength C on the summed loss."""

    C = Param(Params._dummy(), "C", "inverse regularisation strength", TypeConverters.toFloat)
    l1Ratio = Param(Params._dummy(), "l1Ratio", "elastic-net mixing", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "convergence tolerance", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", C=1.0, l1Ratio=0.0, maxIter=100,
                 tol=1e-4, weightCol=None):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", C=1.0, l1Ratio=0.0, maxIter=100,
                         tol=1e-4)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        n = df.count()
        c = self.getOrDefault(self.C)
        lr = LogisticRegression(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                                regParam=1.0 / (c * max(n, 1)),
                                elasticNetParam=self.getOrDefault(self.l1Ratio),
                                maxIter=self.getOrDefault(self.maxIter), standardization=False,
                                tol=self.getOrDefault(self.tol))
        cols = [self.getLabelCol()]
        if self.isDefined(self.weightCol):
            lr = lr.setWeightCol(self.getWeightCol())
            cols.append(self.getWeightCol())
        # every task of the fit would carry the names of all slots, one for each category
        features = F.col(self.getFeaturesCol()).alias(self.getFeaturesCol(), metadata={})
        return lr.fit(df.select(features, *dict.fromkeys(cols)))


# ----------------------------------------------------------------------------- M9
class KNNClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    p = Param(Params._dummy(), "p", "Minkowski power (1 or 2)", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform | distance", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique row key", TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction",
                 k=5, p=2, weights="uniform", idCol="id"):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction",
                         k=5, p=2, weights="uniform", idCol="id")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        train = df.select(F.col(self.getOrDefault(self.idCol)).cast("long").alias("tid"),
                          vector_to_array(F.col(self.getFeaturesCol())).alias("tv"),
                          F.col(self.getLabelCol()).cast("double").alias("tlabel"))
        m = KNNModel(train)
        m._copy_from(self)
        return m


class KNNModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, MLReadable, MLWritable):
    k = KNNClassifier.k
    p = KNNClassifier.p
    weights = KNNClassifier.weights
    idCol = KNNClassifier.idCol

    def __init__(self, train: DataFrame):
        super().__init__()
        self.train = train

    def write(self) -> MLWriter:
        return TableWriter(self, {"train": self.train})

    @classmethod
    def read(cls) -> MLReader:
        return TableReader(cls, ["train"])

    def _copy_from(self, est: KNNClassifier) -> None:
        for prm in ("featuresCol", "labelCol", "predictionCol", "k", "p", "weights", "idCol"):
            self._set(**{prm: est.getOrDefault(prm)})

    def _transform(self, df: DataFrame) -> DataFrame:
        idc = self.getOrDefault(self.idCol)
        query = df.select(F.col(idc).cast("long").alias("qid"),
                          vector_to_array(F.col(self.getFeaturesCol())).alias("qv"))
        nb = knn_neighbours(query, self.train, self.getOrDefault(self.k), self.getOrDefault(self.p))
        if self.getOrDefault(self.weights) == "distance":
            # zero distances dominate: if a query has any, only those vote
            w = Window.partitionBy("qid")
            nb = (nb.withColumn("__zero", F.max((F.col("dist") == 0).cast("int")).over(w))
                    .withColumn("__w", F.when(F.col("__zero") == 1, (F.col("dist") == 0).cast("double"))
                                .otherwise(1.0 / F.col("dist"))))
        else:
            nb = nb.withColumn("__w", F.lit(1.0))
        votes = nb.groupBy("qid", "tlabel").agg(F.sum("__w").alias("score"))
        best = votes.groupBy("qid").agg(
            F.min_by("tlabel", F.struct(-F.col("score"), F.col("tlabel"))).alias(self.getPredictionCol()))
        return df.join(best, F.col(idc).cast("long") == F.col("qid"), "left").drop("qid")


# ----------------------------------------------------------------------------- M10 - M13
# Fixed names under which a model or a parameter is also known.
ALIASES = {"lr": "logreg", "logistic": "logreg", "logistic_regression": "logreg", "kneighbors": "knn", "dt": "tree", "decision_tree": "tree",
           "random_forest": "rf", "gradient_boosting": "gb", "cat": "catboost", "lightgbm": "lgbm", "xgboost": "xgb"}
_TREE = ("criterion", "max_depth", "min_samples_split", "min_samples_leaf", "max_features", "class_weight", "random_state")
_BOOST = ("n_estimators", "iterations", "learning_rate", "max_depth", "depth", "min_samples_leaf", "min_child_samples", "min_samples_split",
          "subsample", "colsample_bytree", "num_leaves", "class_weight", "random_state")
KNOWN = {"logreg": ("C", "l1_ratio", "max_iter", "tol", "class_weight", "random_state"), "knn": ("n_neighbors", "weights", "p"),
         "tree": _TREE, "rf": (*_TREE, "n_estimators"), "gb": _BOOST, "catboost": _BOOST, "lgbm": _BOOST, "xgb": _BOOST}
WEIGHT = "__class_weight"


class BalancedWeights(Estimator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``__class_weight`` = rows / (classes * rows of the class), learned at fit."""

    @keyword_only
    def __init__(self, labelCol="label"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        n = {r[0]: r[1] for r in df.groupBy(F.col(self.getLabelCol()).cast("double")).count().collect()}  # a row per class
        total = sum(n.values())
        from pyspark.ml.feature import SQLTransformer
        whens = " ".join(f"WHEN CAST(`{self.getLabelCol()}` AS DOUBLE) = {float(v)!r}D THEN {total / (len(n) * k)!r}D" for v, k in n.items() if v is not None)
        return SQLTransformer(statement=f"SELECT *, CASE {whens} ELSE 1.0D END AS {WEIGHT} FROM __THIS__")


def _subset(value) -> str:
    """A share or number of features, or sqrt / log2, as Spark's feature subset strategy."""
    if value in (None, "sqrt", "log2", "auto", "all"):
        return "all" if value is None else value
    return str(value)


def _impurity(criterion: str | None) -> str:
    return "gini" if criterion in (None, "gini") else "entropy"  # entropy == log_loss


def classifier_stage(name: str, label: str = "label", features: str = "features",
                     id_col: str = "id", **params):
    """The bare Spark classifier for ``name`` with scikit-style ``params`` translated.

    A parameter without a counterpart raises. ``min_samples_split`` becomes a minimum
    of half as many rows per leaf (Spark has none per split); ``num_leaves`` bounds the
    depth; ``class_weight="balanced"`` reads the column that ``BalancedWeights`` adds.
    """
    name = ALIASES.get(name, name)
    if name not in DEFAULT_PARAMS:
        raise ValueError(f"unknown model '{name}'")
    if strange := sorted(set(params) - set(KNOWN[name])):
        raise ValueError(f"{name} has no counterpart for {', '.join(strange)}")
    p = {**DEFAULT_PARAMS[name], **params}
    common = {"labelCol": label, "featuresCol": features}
    if p.get("class_weight") not in (None, "balanced"):
        raise ValueError("class_weight is None or 'balanced'")
    if p.get("class_weight"):
        common["weightCol"] = WEIGHT
    seed = int(p.get("random_state") or SEED)
    leaf = max(int(p.get("min_samples_leaf", p.get("min_child_samples", 1)) or 1), -(-int(p.get("min_samples_split") or 2) // 2))
    if name == "logreg":
        return InverseStrengthLogisticRegression(C=float(p.get("C", 1.0)),
                                                 l1Ratio=float(p.get("l1_ratio") or 0.0),
                                                 maxIter=int(p.get("max_iter", 100)),
                                                 tol=float(p.get("tol", 1e-4)), **common)
    if name == "knn":
        return KNNClassifier(k=int(p["n_neighbors"]), p=int(p.get("p", 2)),
                             weights=p.get("weights", "uniform"), idCol=id_col, **common)
    if name == "tree":
        if p.get("max_features") is not None:  # a forest of one tree on all rows
            return RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy=_subset(p["max_features"]), seed=seed,
                                          maxDepth=int(p.get("max_depth") or 30), minInstancesPerNode=leaf,
                                          impurity=_impurity(p.get("criterion")), **common)
        return DecisionTreeClassifier(maxDepth=int(p.get("max_depth") or 30), minInstancesPerNode=leaf,
                                      impurity=_impurity(p.get("criterion")), seed=seed, **common)
    if name == "rf":
        return RandomForestClassifier(numTrees=int(p["n_estimators"]),
                                      maxDepth=int(p.get("max_depth") or 30), minInstancesPerNode=leaf,
                                      featureSubsetStrategy=_subset(p.get("max_features", "auto")),
                                      impurity=_impurity(p.get("criterion")), seed=seed, **common)
    # boosted trees: gb / catboost / lgbm / xgb
    rounds = int(p.get("n_estimators", p.get("iterations", 100)))
    depth = int(p.get("max_depth", p.get("depth", 3)))
    if p.get("num_leaves"):
        depth = min(depth, max(1, math.ceil(math.log2(int(p["num_leaves"])))))
    return GBTClassifier(maxIter=rounds, stepSize=float(p.get("learning_rate", 0.1)), maxDepth=depth, minInstancesPerNode=leaf,
                         subsamplingRate=float(p.get("subsample", 1.0)), featureSubsetStrategy=_subset(p.get("colsample_bytree")),
                         seed=seed, **common)


def make_classifier(name: str, num_cols: list[str], cat_cols: list[str], label: str = "label",
                    id_col: str = "id", **params) -> Pipeline:
    """Preprocessing + classifier.  Linear/KNN models get scaled one-hot inputs,
    tree models median/mode-imputed ordinal inputs."""
    if ALIASES.get(name, name) in ("logreg", "knn"):
        pre = build_preprocessor(num_cols, cat_cols, encoding="onehot", scale=True)
    else:
        pre = build_preprocessor(num_cols, cat_cols, encoding="ordinal", scale=False)
    weights = [BalancedWeights(labelCol=label)] if params.get("class_weight") == "balanced" else []
    return Pipeline(stages=[pre] + weights + [classifier_stage(name, label, id_col=id_col, **params)])


# ----------------------------------------------------------------------------- M16
def coefficient_report(pipeline_model, feature_names: list[str] | None = None) -> DataFrame:
    """(feature, coefficient) of a fitted logistic regression, by |coefficient| desc."""
    lr = pipeline_model.stages[-1]
    coefs = lr.coefficients.toArray().tolist()
    names = feature_names or [f"f{i}" for i in range(len(coefs))]
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(n, float(c)) for n, c in zip(names, coefs)],
                               "feature string, coefficient double")
    return df.orderBy(F.desc(F.abs("coefficient")), "feature")


def feature_names(pipeline_model, df: DataFrame, features: str = "features") -> list[str]:
    """Slot names of the assembled vector, read from the ML attribute metadata."""
    out = pipeline_model.transform(df.limit(0))
    meta = out.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    slots = []
    for kind in ("numeric", "binary", "nominal"):
        slots += [(a["idx"], a["name"]) for a in meta.get(kind, [])]
    return [n for _, n in sorted(slots)]
