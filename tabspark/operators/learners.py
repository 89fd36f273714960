"""Learners Spark ML lacks: nearest neighbours and adaptive boosting, as ML stages."""

from __future__ import annotations


import math

import numpy as np
import pandas as pd
from pyspark import SparkContext, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from tabspark.config import EngineConfig
from tabspark.operators.knn import NeighbourIndex, weighted
from tabspark.session import cut_lineage, scratch_path


#: Thresholds that a boosted tree tries for each feature: a stump has one split, which no deeper one puts right.
_BINS = 256


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    task = Param(Params._dummy(), "task", "classification or regression", TypeConverters.toString)
    nClasses = Param(Params._dummy(), "nClasses", "number of label classes", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction",
                         probabilityCol="probability", task="classification", nClasses=0)

    @property
    def classifies(self) -> bool:
        return self.getOrDefault("task") == "classification"

    def _hand_over(self, model):
        for name in ("featuresCol", "labelCol", "predictionCol", "probabilityCol", "task"):
            model._set(**{name: self.getOrDefault(name)})
        return model


class _KnnParams(_Columns):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "euclidean, minkowski or manhattan", TypeConverters.toString)


class NearestNeighbours(Estimator, _KnnParams):
    """Keeps the training rows; all work happens when scoring."""

    @keyword_only
    def __init__(self, *, task: str = "classification", k: int = 5, weights: str = "uniform",
                 metric: str = "euclidean", featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self._defaults()
        self._setDefault(k=5, weights="uniform", metric="euclidean")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "NearestNeighboursModel":
        # Equal rows are kept apart by their position; any unique number serves as id,
        # and the written table fixes it for good.
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("vec"),
                              F.col(self.getLabelCol()).cast("double").alias("y"))
        path = scratch_path(dataset.sparkSession, "neighbours")
        rows = rows.withColumn("id", F.monotonically_increasing_id())
        rows.write.parquet(path)
        model = self._hand_over(NearestNeighboursModel(dataset.sparkSession.read.schema(rows.schema).parquet(path)))
        n_classes = 0
        if self.classifies:
            n_classes = int(model.train.agg(F.max("y")).first()[0]) + 1
        return model._set(k=self.getOrDefault("k"), weights=self.getOrDefault("weights"),
                          metric=self.getOrDefault("metric"), nClasses=n_classes)


class NearestNeighboursModel(Model, _KnnParams, MLReadable, MLWritable):
    def __init__(self, train: DataFrame | None = None, config: EngineConfig = EngineConfig()):
        super().__init__()
        self._defaults()
        self._setDefault(k=5, weights="uniform", metric="euclidean")
        self.train, self.config, self._indexes = train, config, {}

    def _index(self, metric: str) -> NeighbourIndex:
        """The prepared train rows, the same for every table that is scored."""
        key = self.getOrDefault("k"), metric, self.config
        if key not in self._indexes:
            self._indexes[key] = NeighbourIndex(self.train.select("id", "vec"), key[0], metric, self.config)
        return self._indexes[key]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Neighbours are searched once per distinct feature vector, then joined back."""
        metric = "manhattan" if self.getOrDefault("metric") == "manhattan" else "euclidean"
        index = self._index(metric)
        if index.fits_broadcast():
            return self._transform_rows(dataset, index)
        vec = vector_to_array(self.getFeaturesCol())
        keyed = dataset.withColumn("_vec", vec).withColumn("_id", F.sha2(F.col("_vec").cast("string"), 256))
        probes = keyed.groupBy(F.col("_id").alias("id")).agg(F.first("_vec").alias("vec"))
        found = index.join(probes).join(self.train.select(F.col("id").alias("neighbour"), "y"), "neighbour")
        d = F.sqrt("distance") if metric == "euclidean" else F.col("distance")
        found = weighted(found.withColumn("distance", d), self.getOrDefault("weights"), "id")
        if self.classifies:
            shares = [(F.sum(F.when(F.col("y") == float(c), F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias(f"p{c}")
                      for c in range(self.getOrDefault("nClasses"))]
            scored = found.groupBy("id").agg(F.array(*shares).alias("_p"))
        else:
            scored = found.groupBy("id").agg((F.sum(F.col("y") * F.col("_w")) / F.sum("_w")).alias("_p"))
        joined = keyed.join(scored.withColumnRenamed("id", "_id"), "_id", "left").drop("_id", "_vec")
        return self._finish(joined)

    def _transform_rows(self, dataset: DataFrame, index: NeighbourIndex) -> DataFrame:
        """Bounded training side: a vectorised lookup per row, no shuffle of the rows."""
        shared = dataset.sparkSession.sparkContext.broadcast(index.collect(self.train))
        k, classes = self.getOrDefault("k"), self.getOrDefault("nClasses") if self.classifies else 0
        uniform, euclidean = self.getOrDefault("weights") == "uniform", index.metric == "euclidean"

        def score(vec: pd.Series) -> pd.Series:
            if len(vec) == 0:
                return pd.Series([], dtype=object)
            i, at, d = shared.value.search(np.stack(vec.to_numpy()).astype(np.float64), k)
            y = shared.value.known[at]
            d = np.sqrt(d) if euclidean else d
            w = np.ones(len(d))
            if not uniform:
                hit = np.zeros(len(vec), bool)
                hit[i[d == 0]] = True
                with np.errstate(divide="ignore"):
                    w = np.where(hit[i], (d == 0).astype(float), 1.0 / d)
            total = np.bincount(i, weights=w, minlength=len(vec))
            if classes:
                cells = np.bincount(i * classes + y.astype(int), weights=w, minlength=len(vec) * classes)
                return pd.Series(list(cells.reshape(len(vec), classes) / total[:, None]))
            return pd.Series(np.bincount(i, weights=w * y, minlength=len(vec)) / total)

        lookup = F.pandas_udf(score, "array<double>" if classes else "double")
        return self._finish(dataset.withColumn("_p", lookup(vector_to_array(self.getFeaturesCol()))))

    def _finish(self, df: DataFrame) -> DataFrame:
        if not self.classifies:
            return df.withColumnRenamed("_p", self.getPredictionCol())
        return (df.withColumn(self.getProbabilityCol(), array_to_vector("_p"))
                .withColumn(self.getPredictionCol(), _first_max("_p")).drop("_p"))

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


def _first_max(column: str) -> Column:
    """Position of the greatest entry; the first one on ties."""
    return (F.array_position(F.col(column), F.array_max(column)) - 1).cast("double")


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.train.write.parquet(f"{path}/train")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/train"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _BoostParams(_Columns, HasSeed):
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinks every round", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of one tree", TypeConverters.toInt)
    checkpointEvery = Param(Params._dummy(), "checkpointEvery", "rounds between checkpoints", TypeConverters.toInt)


class AdaptiveBoosting(Estimator, _BoostParams):
    """Boosts shallow Spark trees by re-weighting rows (SAMME; AdaBoost.R2 for regression).

    One round is one distributed tree fit and one aggregate. The weights depend
    on all earlier rounds, so the weighted table is checkpointed regularly.
    """

    @keyword_only
    def __init__(self, *, task: str = "classification", rounds: int = 50, learningRate: float = 1.0,
                 maxDepth: int = 0, checkpointEvery: int = 10, seed: int = 42,
                 featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self._defaults()
        self._setDefault(rounds=50, learningRate=1.0, maxDepth=0, checkpointEvery=10, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "AdaptiveBoostingModel":
        label, features = self.getLabelCol(), self.getFeaturesCol()
        rows = dataset.select(F.col(features), F.col(label).cast("double").alias(label))
        summary = rows.agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("m")).first()
        n_classes = int(summary["m"]) + 1 if self.classifies else 0
        depth = self.getOrDefault("maxDepth") or (1 if self.classifies else 3)
        current = cut_lineage(rows.withColumn("_w", F.lit(1.0 / summary["n"])))
        trees, weights, kept = [], [], None
        for i in range(self.getOrDefault("rounds")):
            common = dict(featuresCol=features, labelCol=label, weightCol="_w", maxDepth=depth,
                          predictionCol="_pred", seed=self.getSeed() + i, minWeightFractionPerNode=0.0, maxBins=_BINS)
            if self.classifies:
                tree = DecisionTreeClassifier(rawPredictionCol="", probabilityCol="", **common).fit(current)
            else:
                tree = DecisionTreeRegressor(**common).fit(current)
            scored = tree.transform(current)
            step = self._class_step(scored, label, n_classes) if self.classifies else self._value_step(scored, label)
            if step is None and not trees and not self.classifies:
                step = 1.0, F.lit(1.0), True  # the first tree is kept however weak
            if step is None:
                break
            weight, factor, perfect = step
            trees.append(tree)
            weights.append(weight)
            if perfect:
                break
            # Kept for the several passes of the next round; the round before is then released.
            raw = scored.withColumn("_w", F.col("_w") * factor).drop("_pred").persist(StorageLevel.MEMORY_AND_DISK)
            total = raw.agg(F.sum("_w")).first()[0]
            if kept is not None:
                kept.unpersist()
            kept, current = raw, raw.withColumn("_w", F.col("_w") / F.lit(total))
            if (i + 1) % self.getOrDefault("checkpointEvery") == 0:
                current = cut_lineage(current)
        if kept is not None:
            kept.unpersist()
        if not trees:
            raise RuntimeError("boosting found no usable tree in its first round")
        model = self._hand_over(AdaptiveBoostingModel(trees))
        return model._set(treeWeights=weights, nClasses=n_classes)

    def _class_step(self, scored: DataFrame, label: str, n_classes: int):
        wrong = F.when(F.col("_pred") != F.col(label), F.col("_w")).otherwise(0.0)
        row = scored.agg(F.sum(wrong).alias("e"), F.sum("_w").alias("w")).first()
        error = row["e"] / row["w"]
        if error <= 0:
            return 1.0, F.lit(1.0), True
        if error >= 1.0 - 1.0 / n_classes:
            return None
        alpha = self.getOrDefault("learningRate") * (math.log((1 - error) / error) + math.log(n_classes - 1))
        return alpha, F.when(F.col("_pred") != F.col(label), F.lit(math.exp(alpha))).otherwise(1.0), False

    def _value_step(self, scored: DataFrame, label: str):
        gap = F.abs(F.col("_pred") - F.col(label))
        worst, size = scored.filter(F.col("_w") > 0).agg(F.max(gap), F.max(F.abs(label))).first()
        if worst <= 1e-12 * size:  # a leaf's weighted mean is exact up to rounding
            return 1.0, F.lit(1.0), True
        loss = gap / F.lit(worst)
        row = scored.agg(F.sum(loss * F.col("_w")).alias("e"), F.sum("_w").alias("w")).first()
        error = row["e"] / row["w"]
        if error <= 0:
            return 1.0, F.lit(1.0), True
        if error >= 0.5:
            return None
        beta = error / (1 - error)
        rate = self.getOrDefault("learningRate")
        return rate * math.log(1 / beta), F.pow(F.lit(beta), (1 - loss) * F.lit(rate)), False


class AdaptiveBoostingModel(Model, _BoostParams, MLReadable, MLWritable):
    treeWeights = Param(Params._dummy(), "treeWeights", "vote of every tree", TypeConverters.toListFloat)

    def __init__(self, trees: list | None = None):
        super().__init__()
        self._defaults()
        self.trees = trees or []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = self.getOrDefault("treeWeights")
        df, names = dataset, [f"_tree_{i}" for i in range(len(self.trees))]
        for tree, name in zip(self.trees, names):
            tree = tree.copy().setPredictionCol(name)
            if self.classifies:
                tree = tree.setRawPredictionCol("").setProbabilityCol("")
            df = tree.transform(df)
        votes = F.array(*[F.struct(F.col(n).alias("p"), F.lit(float(w)).alias("w")) for n, w in zip(names, weights)])
        if self.classifies:
            total = sum(weights) or 1.0
            def share(c: float) -> Column:
                return F.aggregate(votes, F.lit(0.0), lambda a, v: a + F.when(v["p"] == c, v["w"]).otherwise(0.0)) / total

            shares = F.array(*[share(float(c)) for c in range(self.getOrDefault("nClasses"))])
            return (df.withColumn("_p", shares).withColumn(self.getProbabilityCol(), array_to_vector("_p"))
                    .withColumn(self.getPredictionCol(), _first_max("_p")).drop("_p", *names))
        # Weighted median: the first prediction, in order, at which half of the weight is reached.
        half = F.lit(0.5 * sum(weights))
        state = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("m"))
        median = F.aggregate(F.array_sort(votes), state, lambda a, v: F.struct(
            (a["w"] + v["w"]).alias("w"),
            F.when(a["m"].isNull() & (a["w"] + v["w"] >= half), v["p"]).otherwise(a["m"]).alias("m")))
        return df.withColumn(self.getPredictionCol(), median["m"]).drop(*names)

    @property
    def featureImportances(self):
        """Weighted mean of the trees' importances."""
        from pyspark.ml.linalg import Vectors
        weights = self.getOrDefault("treeWeights")
        total = sum(weights) or 1.0
        return Vectors.dense(sum(w * t.featureImportances.toArray() for w, t in zip(weights, self.trees)) / total)

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader(cls)


def first_rounds(model: Model, rounds: int) -> Model:
    """The boosted model that a fit of so many rounds would have given: later rounds never change earlier ones."""
    if isinstance(model, AdaptiveBoostingModel):
        short = AdaptiveBoostingModel(model.trees[:rounds])
        model._copyValues(short)
        return short._set(treeWeights=model.getOrDefault("treeWeights")[:rounds])
    if hasattr(model, "first_rounds"):
        return model.first_rounds(rounds)
    if not isinstance(model, (GBTClassificationModel, GBTRegressionModel)):
        raise TypeError(f"{type(model).__name__} is not built round by round")
    java = model._java_obj
    sc = SparkContext._active_spark_context
    kept = min(rounds, len(java.trees()))
    base = sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = sc._gateway.new_array(base, kept), sc._gateway.new_array(sc._jvm.double, kept)
    for i in range(kept):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    package = sc._jvm.org.apache.spark.ml
    if isinstance(model, GBTClassificationModel):
        short = GBTClassificationModel(package.classification.GBTClassificationModel(java.uid(), trees, weights, java.numFeatures(), 2))
    else:
        short = GBTRegressionModel(package.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures()))
    return model._copyValues(short)


class _TreesWriter(MLWriter):
    def __init__(self, instance: AdaptiveBoostingModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession,
                                         extraMetadata={"nTrees": len(self.instance.trees)})
        for i, tree in enumerate(self.instance.trees):
            tree.save(f"{path}/trees/{i}")


class _TreesReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> AdaptiveBoostingModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        task = metadata["paramMap"].get("task", "classification")
        kind = DecisionTreeClassificationModel if task == "classification" else DecisionTreeRegressionModel
        model = self.cls([kind.load(f"{path}/trees/{i}") for i in range(metadata["nTrees"])])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
