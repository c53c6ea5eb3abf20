"""Hyper-parameter search over typed spaces.

Parameter draws are made on the driver from a seeded generator (a handful of
numbers per trial); each trial is one cross-validated score (k distributed
fits) and trials run on a driver thread pool.  The best parameters are refit on
all rows.  ``search(..., sampler='random')`` is the only sampler: sequential
model-based samplers are single-machine loops and are not provided.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators.evaluate import cached_frame, cv_scores

# Fixed search spaces: (kind, args).  loguniform(lo, hi); int(lo, hi, step); choice([...]).
SPACES = {
    "logreg": {"C": ("loguniform", 0.01, 8.0)},
    "logreg_wide": {"C": ("loguniform", 1e-3, 1e3)},
    "knn": {"n_neighbors": ("int", 3, 31, 2), "weights": ("choice", ["uniform", "distance"]),
            "p": ("choice", [1, 2])},
    "tree": {"criterion": ("choice", ["gini", "entropy", "log_loss"]), "max_depth": ("int", 2, 10, 1),
             "min_samples_split": ("int", 2, 40, 1), "min_samples_leaf": ("int", 1, 20, 1),
             "max_features": ("choice", [None, "sqrt", "log2"]), "class_weight": ("choice", [None, "balanced"])},
    "rf": {"n_estimators": ("int", 100, 700, 100), "criterion": ("choice", ["gini", "entropy", "log_loss"]),
           "max_depth": ("int", 2, 12, 1), "min_samples_split": ("int", 2, 40, 1), "min_samples_leaf": ("int", 1, 20, 1)},
    "gb": {"n_estimators": ("int", 100, 700, 100), "learning_rate": ("loguniform", 0.01, 0.2),
           "max_depth": ("int", 2, 6, 1)},
}


def draw(space: dict, rng: np.random.Generator) -> dict:
    out = {}
    for name, spec in space.items():
        kind = spec[0]
        if kind == "loguniform":
            lo, hi = spec[1], spec[2]
            out[name] = float(math.exp(rng.uniform(math.log(lo), math.log(hi))))
        elif kind == "int":
            lo, hi, step = spec[1], spec[2], spec[3]
            out[name] = int(lo + step * rng.integers(0, (hi - lo) // step + 1))
        elif kind == "choice":
            vals = spec[1]
            out[name] = vals[int(rng.integers(0, len(vals)))]
        else:
            raise ValueError(f"unknown space kind '{kind}'")
    return out


def search(build, space: dict | str, data: DataFrame, label: str, n_iter: int = 30,
           seed: int = 42, fold_col: str = "fold", k: int = 5, parallelism: int = 4,
           refit: bool = True):
    """Random search.  ``build(params)`` returns an unfitted estimator.

    Returns (trials DataFrame (trial, params, mean, std) ordered by mean desc,
    best params, refit model or None).
    """
    if isinstance(space, str):
        if space not in SPACES:
            raise ValueError(f"no search space for '{space}'")
        space = SPACES[space]
    rng = np.random.default_rng(seed)
    draws = [draw(space, rng) for _ in range(n_iter)]

    def run(i):
        m, s, _ = cv_scores(build(dict(draws[i])), cached, label, fold_col, k, parallelism=k)
        return i, json.dumps(draws[i], sort_keys=True), float(m), float(s)

    with cached_frame(data) as cached, ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        rows = list(ex.map(run, range(n_iter)))
    spark = data.sparkSession
    trials = (spark.createDataFrame(rows, "trial int, params string, mean double, std double")
                   .orderBy(F.desc("mean"), "trial"))
    best_i = max(rows, key=lambda r: (r[2], -r[0]))[0]
    best = dict(draws[best_i])
    model = build(dict(best)).fit(data) if refit else None
    return trials, best, model
