"""The model catalogue: names, settings, search grids and Spark estimators."""

from __future__ import annotations

import itertools
import random
import warnings
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)

from tabspark.config import EngineConfig
from tabspark.operators.learners import AdaptiveBoosting, NearestNeighbours
from tabspark.operators.softmax_boosting import SoftmaxBoosting
from tabspark.operators.trees import SplitLimit

MAX_DEPTH = 30  # deepest tree Spark ML accepts


@dataclass(frozen=True)
class TrainStats:
    """What penalties and multi-class wrappers need to know about the training rows."""
    n: int
    n_classes: int = 0
    label_std: float = 1.0


@dataclass(frozen=True)
class ModelSpec:
    name: str
    task: str
    build: Callable[[dict, TrainStats, int], Estimator]
    defaults: dict = field(default_factory=dict)
    grid: dict = field(default_factory=dict)
    speed: str = "medium"
    needs_scaling: bool = False
    handles_missing: bool = False
    interpretable: bool = False
    ignored: tuple = ()  # accepted settings without a Spark ML counterpart

    def estimator(self, params: dict | None, stats: TrainStats, seed: int = 42) -> Estimator:
        merged = {**self.defaults, **(params or {})}
        together = self.build is _gbt_clf and stats.n_classes > 2  # that booster knows all settings
        unused = [] if together else sorted(set(self.ignored) & set(params or {}))
        if unused:
            warnings.warn(f"{self.name}: no Spark ML counterpart for {unused}; ignored", stacklevel=2)
        return self.build(merged, stats, seed)


def _depth(p: dict) -> int:
    """Spark's trees end at MAX_DEPTH: no limit means that one, and a deeper one is said to be cut."""
    d = p.get("max_depth")
    if d is not None and int(d) > MAX_DEPTH:
        warnings.warn(f"trees can be {MAX_DEPTH} levels deep at most; max_depth={d} is taken as that", stacklevel=4)
    return MAX_DEPTH if d is None else min(int(d), MAX_DEPTH)


def _tree(p: dict) -> dict:
    return dict(maxDepth=_depth(p), minInstancesPerNode=p.get("min_samples_leaf", 1), maxBins=64)


def _held(tree: Estimator, p: dict) -> Estimator:
    """Spark's trees know no least number of rows to split: splits of fewer are undone after the fit."""
    least = int(p.get("min_samples_split") or 2)
    return SplitLimit(tree, least) if least > 2 else tree


def _subset(p: dict, default: str) -> str:
    return p.get("max_features") or default


def _logistic(p, s, seed):
    return LogisticRegression(maxIter=p["max_iter"], regParam=1.0 / (p.get("C", 1.0) * s.n),
                              elasticNetParam=p.get("l1_ratio", 0.0), standardization=False)


def _forest_clf(p, s, seed):
    return _held(RandomForestClassifier(numTrees=p["n_estimators"], seed=seed, bootstrap=p.get("bootstrap", True),
                                        featureSubsetStrategy=_subset(p, "sqrt"), **_tree(p)), p)


def _forest_reg(p, s, seed):
    return _held(RandomForestRegressor(numTrees=p["n_estimators"], seed=seed, featureSubsetStrategy=_subset(p, "all"),
                                       **_tree(p)), p)


def _gbt_common(p, seed):
    return dict(maxIter=p["n_estimators"], stepSize=p["learning_rate"], subsamplingRate=p.get("subsample", 1.0),
                featureSubsetStrategy=_subset(p, "all"), seed=seed, **_tree(p))


def _gbt_clf(p, s, seed):
    if s.n_classes <= 2:
        return GBTClassifier(**_gbt_common(p, seed))
    return SoftmaxBoosting(rounds=p["n_estimators"], learningRate=p["learning_rate"], maxDepth=_depth(p), seed=seed,
                           minLeaf=p.get("min_samples_leaf", 1), minSplit=p.get("min_samples_split", 2),
                           subsample=p.get("subsample", 1.0), maxFeatures=_subset(p, "all"))


def _svm(p, s, seed):
    if p.get("kernel", "linear") != "linear":
        raise ValueError("only the linear kernel is built")
    one = LinearSVC(maxIter=p.get("max_iter", 100), regParam=1.0 / (p.get("C", 1.0) * s.n), standardization=False)
    return one if s.n_classes <= 2 else OneVsRest(classifier=one)


def _knn(task):
    return lambda p, s, seed: NearestNeighbours(task=task, k=p["n_neighbors"], weights=p.get("weights", "uniform"),
                                                metric=p.get("metric", "euclidean"))


def _ada(task):
    return lambda p, s, seed: AdaptiveBoosting(task=task, rounds=p["n_estimators"],
                                               learningRate=p["learning_rate"], seed=seed)


def _linear(p, s, seed):
    # One-hot blocks are collinear; a vanishing penalty picks the least-norm solution
    # and keeps the one-pass normal equations solvable.
    return LinearRegression(regParam=1e-9 * s.label_std, solver="normal")


def _ridge(p, s, seed):
    # Spark scales the label, so an L2 penalty is multiplied by its deviation.
    return LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0,
                            regParam=p["alpha"] * s.label_std / s.n)


def _elastic(alpha: float, ratio: float, s: TrainStats) -> LinearRegression:
    total = alpha * ratio + alpha * (1 - ratio) * s.label_std
    return LinearRegression(standardization=False, regParam=total, elasticNetParam=alpha * ratio / total,
                            maxIter=200, tol=1e-8)


# Names, default settings and search grids of the catalogue.
_SPECS = [
    ModelSpec("Logistic Regression", "classification", _logistic, {"max_iter": 1000},
              {"C": [0.01, 0.1, 1, 10, 100], "solver": ["lbfgs", "saga"], "l1_ratio": [0.0, 0.5, 1.0],
               "max_iter": [200, 500]},
              "fast", needs_scaling=True, interpretable=True, ignored=("solver",)),
    ModelSpec("Random Forest", "classification", _forest_clf,
              {"n_estimators": 100, "max_depth": 10, "min_samples_split": 10, "min_samples_leaf": 4},
              {"n_estimators": [50, 100, 150], "max_depth": [5, 10, 15], "min_samples_split": [10, 20, 30],
               "min_samples_leaf": [4, 8, 12], "max_features": ["sqrt", "log2"], "bootstrap": [True]},
              "medium"),
    ModelSpec("Gradient Boosting", "classification", _gbt_clf,
              {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
              {"n_estimators": [50, 100], "learning_rate": [0.01, 0.05, 0.1], "max_depth": [3, 4, 5],
               "min_samples_split": [20, 30, 40], "min_samples_leaf": [10, 15, 20], "subsample": [0.6, 0.8],
               "max_features": ["sqrt", "log2"]},
              "slow", ignored=("min_samples_split",)),
    ModelSpec("Decision Tree", "classification",
              lambda p, s, seed: _held(DecisionTreeClassifier(seed=seed, **_tree(p)), p),
              {"max_depth": 10, "min_samples_split": 2, "min_samples_leaf": 1},
              {"max_depth": [5, 10, 15, 20, None], "min_samples_split": [2, 5, 10, 20],
               "min_samples_leaf": [1, 2, 4, 8], "max_features": ["sqrt", "log2", None]},
              "fast", interpretable=True, ignored=("max_features",)),
    ModelSpec("K-Nearest Neighbors", "classification", _knn("classification"), {"n_neighbors": 5},
              {"n_neighbors": [3, 5, 7, 9, 11, 15], "weights": ["uniform", "distance"],
               "metric": ["euclidean", "manhattan", "minkowski"]},
              "medium", needs_scaling=True, interpretable=True),
    ModelSpec("SVM", "classification", _svm, {"kernel": "linear"}, {"C": [0.1, 1.0, 10.0, 100.0]},
              "slow", needs_scaling=True),
    ModelSpec("Naive Bayes", "classification", lambda p, s, seed: NaiveBayes(modelType="gaussian"), {}, {},
              "fast", interpretable=True),
    ModelSpec("AdaBoost", "classification", _ada("classification"), {"n_estimators": 50, "learning_rate": 1.0},
              {"n_estimators": [50, 100, 200], "learning_rate": [0.5, 1.0, 1.5, 2.0]}, "medium"),
    ModelSpec("Linear Regression", "regression", _linear, {}, {}, "fast", needs_scaling=True, interpretable=True),
    ModelSpec("Ridge", "regression", _ridge, {"alpha": 1.0}, {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]},
              "fast", needs_scaling=True, interpretable=True),
    ModelSpec("Lasso", "regression", lambda p, s, seed: _elastic(p["alpha"], 1.0, s), {"alpha": 1.0},
              {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]}, "fast", needs_scaling=True, interpretable=True),
    ModelSpec("Elastic Net", "regression", lambda p, s, seed: _elastic(p["alpha"], p["l1_ratio"], s),
              {"alpha": 1.0, "l1_ratio": 0.5},
              {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]},
              "fast", needs_scaling=True, interpretable=True),
    ModelSpec("Decision Tree", "regression", lambda p, s, seed: _held(DecisionTreeRegressor(seed=seed, **_tree(p)), p),
              {"max_depth": 10, "min_samples_split": 2},
              {"max_depth": [5, 10, 15, 20, None], "min_samples_split": [2, 5, 10, 20], "min_samples_leaf": [1, 2, 4, 8]},
              "fast", interpretable=True),
    ModelSpec("Random Forest", "regression", _forest_reg, {"n_estimators": 100, "max_depth": None},
              {"n_estimators": [100, 200, 300, 500], "max_depth": [None, 10, 20, 30, 40],
               "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4], "max_features": ["sqrt", "log2"]},
              "medium"),
    ModelSpec("Gradient Boosting", "regression", lambda p, s, seed: GBTRegressor(**_gbt_common(p, seed)),
              {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
              {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.05, 0.1, 0.2], "max_depth": [3, 4, 5, 6],
               "min_samples_split": [2, 5, 10], "subsample": [0.8, 0.9, 1.0]},
              "slow", ignored=("min_samples_split",)),
    ModelSpec("K-Nearest Neighbors", "regression", _knn("regression"), {"n_neighbors": 5}, {}, "medium",
              needs_scaling=True, interpretable=True),
    ModelSpec("AdaBoost", "regression", _ada("regression"), {"n_estimators": 50, "learning_rate": 1.0}, {}, "medium"),
]

CATALOGUE: dict[tuple[str, str], ModelSpec] = {(s.task, s.name): s for s in _SPECS}


def model_names(task: str) -> list[str]:
    if task not in ("classification", "regression"):
        raise ValueError(f"no models for a task called {task}")
    return [s.name for s in _SPECS if s.task == task]


def get_spec(name: str, task: str) -> ModelSpec:
    names = model_names(task)
    if name not in names:
        raise ValueError(f"{task} has no model called '{name}', only {', '.join(names)}")
    return CATALOGUE[(task, name)]


def default_models(task: str, config: EngineConfig = EngineConfig()) -> list[str]:
    wanted = config.default_classification_models if task == "classification" else config.default_regression_models
    return [n for n in wanted if n in model_names(task)]


def fast_models(task: str) -> list[str]:
    return [n for n in model_names(task) if get_spec(n, task).speed == "fast"]


def interpretable_models(task: str) -> list[str]:
    return [n for n in model_names(task) if get_spec(n, task).interpretable]


def models_handling_missing(task: str) -> list[str]:
    return [n for n in model_names(task) if get_spec(n, task).handles_missing]


def param_grid(name: str, task: str) -> dict[str, list[Any]]:
    return dict(get_spec(name, task).grid)


def sample_grid(name: str, task: str, n_iter: int, seed: int) -> list[dict]:
    """Settings drawn without replacement from the full grid.

    Choices that differ only in settings Spark ML does not have, or in depths
    beyond the deepest tree, are one choice.
    """
    spec = get_spec(name, task)
    active = {k: v for k, v in spec.grid.items() if k not in spec.ignored}
    if "max_depth" in active:
        deepest = {MAX_DEPTH if d is None else min(int(d), MAX_DEPTH): d for d in reversed(active["max_depth"])}
        active["max_depth"] = [d for d in active["max_depth"] if d in deepest.values()]
    if not active:
        return []
    every = [dict(zip(active, values)) for values in itertools.product(*active.values())]
    return random.Random(seed).sample(every, min(n_iter, len(every)))
