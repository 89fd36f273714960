"""Gradient boosting of several classes at once, on histograms.

Each round grows one tree per class on the softmax gradients. Features are
binned once; a level of all trees of a round is one pass that adds up the
gradients by (class, node, feature, bin), and the driver picks the splits from
these sums, whose number the settings bound and not the rows. Unless rounds see
a share of the rows only, rows of equal bins and class stay equal in every round,
so they are one row with its count.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tabspark.operators.learners import _Columns
from tabspark.session import cut_lineage

#: Rows, drawn by hash, from which the edges of the bins are read; bins of a feature at most.
_SAMPLE, _BINS = 20_000, 64


class _Settings(_Columns):
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinks every tree", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    minLeaf = Param(Params._dummy(), "minLeaf", "rows of a leaf at least", TypeConverters.toInt)
    minSplit = Param(Params._dummy(), "minSplit", "rows of a split node at least", TypeConverters.toInt)
    subsample = Param(Params._dummy(), "subsample", "share of the rows that a round sees", TypeConverters.toFloat)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "all, sqrt or log2 of the features at each split", TypeConverters.toString)
    refresh = Param(Params._dummy(), "refresh", "rounds between checkpoints of the scores", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)


class _Trees:
    """Trees of equal depth as flat arrays: node i has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, classes: int, depth: int):
        self.classes, self.depth, self.inner = classes, depth, (1 << depth) - 1
        self.feature = np.empty((0, classes, self.inner), np.int32)
        self.cut = np.empty((0, classes, self.inner))
        self.value = np.empty((0, classes, 1 << depth))

    def add(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
        self.feature = np.concatenate([self.feature, feature[None]])
        self.cut = np.concatenate([self.cut, cut[None]])
        self.value = np.concatenate([self.value, value[None]])

    def scores(self, x: np.ndarray, since: int = 0) -> np.ndarray:
        """(rows, classes) sums of the trees from round ``since`` on."""
        out = np.zeros((len(x), self.classes))
        rows = np.arange(len(x))
        for t in range(since, len(self.feature)):
            for k in range(self.classes):
                node = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (x[rows, self.feature[t, k, node]] > self.cut[t, k, node])
                out[:, k] += self.value[t, k, node - self.inner]
        return out


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


class SoftmaxBoosting(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Gradient boosting for three classes or more, with class probabilities.

    Labels are 0, 1 ...; rows with a null label are left out. Scores start at the
    log shares of the classes. Leaves hold one Newton step of the softmax loss.
    """

    @keyword_only
    def __init__(self, *, rounds: int = 100, learningRate: float = 0.1, maxDepth: int = 3, minLeaf: int = 1, minSplit: int = 2,
                 subsample: float = 1.0, maxFeatures: str = "all", refresh: int = 10, seed: int = 42,
                 featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self._defaults()
        self._setDefault(rounds=100, learningRate=0.1, maxDepth=3, minLeaf=1, minSplit=2, subsample=1.0, maxFeatures="all",
                         refresh=10, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "SoftmaxBoostingModel":
        get = self.getOrDefault
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y")).where("y IS NOT NULL")
        shares = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # one per class
        if not shares:
            raise ValueError("no labelled rows to fit on")
        classes, total = max(shares) + 1, sum(shares.values())
        start = np.log(np.array([max(shares.get(k, 0), 1e-9) for k in range(classes)]) / total)
        draw = F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(min(1.0, 1.2 * (_SAMPLE + 100) / total) * (1 << 30))
        sample = _matrix(rows.where(draw).select("x").toArrow()["x"].combine_chunks(), len(rows.first()["x"]), np.float64)
        if not len(sample):  # a few rows of one hash
            sample = np.array([rows.first()["x"]])
        width = sample.shape[1]
        edges = [_edges(sample[:, f]) for f in range(width)]

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0), width, np.float64)
                    cells = np.column_stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)]).astype(np.uint8)
                    raw = np.tile(start, (len(x), 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c.tobytes() for c in cells], pa.binary()), b.column(1),
                         pa.array([r.tobytes() for r in raw], pa.binary())], names=["b", "y", "raw"])

        kinds = "id long, b binary, y int, raw binary, w double"
        cells = rows.mapInArrow(binned, "b binary, y int, raw binary")
        if get("subsample") >= 1.0:
            # in a fixed order, so that sums don't depend on how the rows were dealt
            cells = cells.groupBy("b", "y", "raw").agg(F.count(F.lit(1)).cast("double").alias("w")).sortWithinPartitions("b", "y")
        else:
            cells = cells.withColumn("w", F.lit(1.0))
        data = cut_lineage(cells.withColumn("id", F.monotonically_increasing_id()).select("id", "b", "y", "raw", "w"))
        trees, gains = _Trees(classes, get("maxDepth")), np.zeros(width)
        fresh = 0  # rounds that the stored scores hold
        rng = np.random.default_rng(get("seed"))
        for t in range(get("rounds")):
            tree = self._round(data, trees, fresh, classes, width, edges, t, rng, gains)
            trees.add(*tree)
            if (t + 1) % get("refresh") == 0 and t + 1 < get("rounds"):
                data = cut_lineage(data.mapInArrow(_rescored(trees, fresh, width), kinds))
                fresh = t + 1
        model = SoftmaxBoostingModel()
        self._hand_over(model)
        state = {"start": start.tolist(), "feature": trees.feature.tolist(), "gains": gains.tolist(),
                 "value": trees.value.tolist(), "cut": _thresholds(trees, edges).tolist()}
        return model._set(state=json.dumps(state), nClasses=classes)

    def _round(self, data: DataFrame, trees: _Trees, fresh: int, classes: int, width: int, edges: list, t: int, rng, gains: np.ndarray):
        """One tree per class: (feature, last bin to the left, leaf values)."""
        get, depth = self.getOrDefault, self.getOrDefault("maxDepth")
        inner = (1 << depth) - 1
        feature = np.zeros((classes, inner), np.int32)
        cut = np.full((classes, inner), np.inf)  # everything goes left
        value = np.zeros((classes, 1 << depth))
        dead = np.zeros((classes, inner + (1 << depth)), bool)  # below a leaf
        share, cells = get("subsample"), _BINS
        rate = get("learningRate") * (classes - 1) / classes
        for level in range(depth):
            nodes, base = 1 << level, (1 << level) - 1
            sums = np.zeros((3, classes * nodes * width * cells))
            found = data.mapInArrow(
                _histograms(trees, fresh, feature, cut, classes, width, level, share, get("seed") * 1_000_003 + t), "cell long, g double, h double, n double"
            ).groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toPandas()  # bounded by classes, nodes, features and bins
            sums[:, found["cell"].to_numpy(np.int64)] = found[["g", "h", "n"]].to_numpy().T
            g, h, n = sums.reshape(3, classes, nodes, width, cells)
            for k in range(classes):
                for j in range(nodes):
                    node = base + j
                    if dead[k, node]:
                        dead[k, 2 * node + 1:2 * node + 3] = True
                        continue
                    whole = [a[k, j, 0].sum() for a in (g, h, n)]
                    best = _best_split(g[k, j], n[k, j], get("minLeaf"), get("minSplit"), _features(width, get("maxFeatures"), rng))
                    first = j << (depth - level)  # of the node's leaves
                    if best is None:
                        value[k, first:first + (1 << (depth - level))] = rate * _step(*whole[:2])
                        dead[k, 2 * node + 1:2 * node + 3] = True
                        continue
                    gain, f, last = best
                    gains[f] += gain
                    feature[k, node], cut[k, node] = f, last
                    half = 1 << (depth - level - 1)
                    left = [a[k, j, f, :last + 1].sum() for a in (g, h)]
                    value[k, first:first + half] = rate * _step(*left)
                    value[k, first + half:first + 2 * half] = rate * _step(whole[0] - left[0], whole[1] - left[1])
        return feature, cut, value


def _edges(values: np.ndarray) -> np.ndarray:
    """Upper ends of the bins: between distinct values, or between quantiles where there are many."""
    own = np.unique(values[~np.isnan(values)])
    if len(own) > _BINS:
        own = np.unique(np.quantile(values[~np.isnan(values)], np.linspace(0, 1, _BINS + 1)[1:], method="lower"))
        return own[:-1][:_BINS - 1]
    return (own[:-1] + own[1:]) / 2


def _thresholds(trees: _Trees, edges: list) -> np.ndarray:
    """The bins' ends in place of their numbers."""
    out = np.full(trees.cut.shape, np.inf)
    for f, e in enumerate(edges):
        own = (trees.feature == f) & np.isfinite(trees.cut)
        out[own] = np.append(e, np.inf)[trees.cut[own].astype(np.int64)]
    return out


def _features(width: int, kind: str, rng) -> np.ndarray:
    take = {"sqrt": max(1, int(math.sqrt(width))), "log2": max(1, int(math.log2(width)))}.get(kind, width)
    return np.arange(width) if take >= width else np.sort(rng.choice(width, take, replace=False))


def _step(g: float, h: float) -> float:
    return g / h if abs(h) > 1e-150 else 0.0


def _best_split(g: np.ndarray, n: np.ndarray, min_leaf: int, min_split: int, allowed: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, last bin on the left) of the split that takes off most of the gradients' spread."""
    whole_g, whole_n = g[0].sum(), n[0].sum()
    if whole_n < max(min_split, 2):
        return None
    left_g, left_n = np.cumsum(g[allowed], axis=1)[:, :-1], np.cumsum(n[allowed], axis=1)[:, :-1]
    right_g, right_n = whole_g - left_g, whole_n - left_n
    ok = (left_n >= max(min_leaf, 1)) & (right_n >= max(min_leaf, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left_g ** 2 / left_n + right_g ** 2 / right_n - whole_g ** 2 / whole_n, -1.0)
    at = int(np.argmax(gain))
    f, last = divmod(at, gain.shape[1])
    if gain[f, last] <= 1e-12 * max(whole_n, 1.0):
        return None
    return float(gain[f, last]), int(allowed[f]), last


def _histograms(trees: _Trees, fresh: int, feature, cut, classes: int, width: int, level: int, share: float, salt: int):
    """Sums of gradients, curvatures and rows by (class, node of the level, feature, bin)."""
    nodes, base = 1 << level, (1 << level) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, classes * nodes * width * _BINS))
        for b in batches:
            if share < 1.0:
                ids = b.column(0).to_numpy().astype(np.uint64)
                draw = (ids + np.uint64(salt & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
                draw = (draw ^ (draw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                b = b.filter(pa.array((draw >> np.uint64(34)).astype(np.float64) / (1 << 30) < share))
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), width, np.uint8)
            y = b.column(2).to_numpy()
            p = _softmax(_matrix(b.column(3), classes, np.float64) + trees.scores(x, fresh))
            w = b.column(4).to_numpy()
            rows, bins = np.arange(len(x)), x.astype(np.int64) + np.arange(width) * _BINS
            for k in range(classes):
                g = (y == k) - p[:, k]
                h = np.abs(g) * (1 - np.abs(g))
                node = np.zeros(len(x), np.int64)
                for _ in range(level):
                    node = 2 * node + 1 + (x[rows, feature[k, node]] > cut[k, node])
                cell = (((k * nodes + node - base) * width * _BINS)[:, None] + bins).ravel()
                for i, v in enumerate((g * w, h * w, w)):
                    total[i] += np.bincount(cell, np.repeat(v, width), total.shape[1])
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(total[i, at]) for i in range(3)]], names=["cell", "g", "h", "n"])

    return run


def _rescored(trees: _Trees, fresh: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = _matrix(b.column(3), trees.classes, np.float64) + trees.scores(_matrix(b.column(1), width, np.uint8), fresh)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in raw], pa.binary()), b.column(4)],
                                                 names=["id", "b", "y", "raw", "w"])

    return run


class SoftmaxBoostingModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """All trees as one setting, so that the model is saved and sent like any other."""

    state = Param(Params._dummy(), "state", "trees as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._defaults()

    def _trees(self) -> tuple[_Trees, np.ndarray]:
        state = json.loads(self.getOrDefault("state"))
        feature = np.array(state["feature"], np.int32)
        trees = _Trees(len(state["start"]), int(math.log2(len(state["value"][0][0]))) if state["value"] else 0)
        if len(feature):
            trees.feature, trees.cut, trees.value = feature, np.array(state["cut"], np.float64), np.array(state["value"], np.float64)
        return trees, np.array(state["start"])

    @property
    def rounds(self) -> int:
        return len(json.loads(self.getOrDefault("state"))["feature"])

    def first_rounds(self, rounds: int) -> "SoftmaxBoostingModel":
        """The model after fewer rounds; the gains, which are kept as sums, stay those of all."""
        state = json.loads(self.getOrDefault("state"))
        state |= {k: state[k][:rounds] for k in ("feature", "cut", "value")}
        return self.copy()._set(state=json.dumps(state))

    @property
    def featureImportances(self):
        gains = np.array(json.loads(self.getOrDefault("state"))["gains"])
        return Vectors.dense(gains / gains.sum() if gains.sum() > 0 else gains)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, start = self._trees()
        shared = dataset.sparkSession.sparkContext.broadcast((trees, start))

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.Series) -> pd.Series:
            trees, start = shared.value
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(_softmax(start + trees.scores(np.stack(x.to_numpy())))))

        scored = dataset.withColumn("_p", probabilities(vector_to_array(self.getFeaturesCol())))
        first = (F.array_position(F.col("_p"), F.array_max("_p")) - 1).cast("double")
        return (scored.withColumn(self.getProbabilityCol(), array_to_vector("_p"))
                .withColumn(self.getPredictionCol(), first).drop("_p"))
