"""The whole feature preparation as one fitted stage."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, functions as F

from tabspark.config import EngineConfig
from tabspark.functions.expr import (
    as_text, categorical_columns, col, dtype_of, free_names, numeric_columns, present,
)
from tabspark.functions.rank import column_ranges, exact_quantiles
from tabspark.operators.encode import (
    FrequencyEncoderModel, one_hot_columns, scaled, sorted_categories,
)
from tabspark.operators.valuecounts import distinct_counts, value_counts
from tabspark.session import scratch_path

NUMERIC, FREQUENCY, ONE_HOT, IDENTIFIER, DROPPED = "numeric", "frequency", "one_hot", "id", "dropped"


def _role(config: EngineConfig) -> Column:
    ratio = F.col("n_unique") / F.col("n_rows")
    return (F.when((F.col("n_rows") > config.id_min_rows) & (ratio > config.id_threshold), IDENTIFIER)
            .when(F.col("n_unique") <= config.one_hot_threshold, ONE_HOT).otherwise(FREQUENCY))


def feature_roles(df: DataFrame, features: list[str] | None = None,
                  config: EngineConfig = EngineConfig()) -> DataFrame:
    """(column, role, n_unique): how every feature will be encoded.

    Only text columns are counted; numeric columns keep a null ``n_unique``.
    """
    features = features or df.columns
    part = df.select([col(c) for c in features])
    numeric, text = set(numeric_columns(part)), categorical_columns(part)
    parts = []
    if text:
        parts.append(distinct_counts(part, text).select("column", _role(config).alias("role"), "n_unique"))
    fixed = [(c, NUMERIC if c in numeric else DROPPED) for c in features if c not in text]
    if fixed:
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("role"),
                                  F.lit(None).cast("long").alias("n_unique")) for c, r in fixed])
        parts.append(df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def role_counts(df: DataFrame, features: list[str] | None = None,
                config: EngineConfig = EngineConfig()) -> DataFrame:
    return feature_roles(df, features, config).groupBy("role").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns"))  # one entry per column


class TablePreprocessor(Estimator, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns roles, medians, scales, categories and frequencies from a table."""

    featureCols = Param(Params._dummy(), "featureCols", "feature columns", TypeConverters.toListString)
    freqScaling = Param(Params._dummy(), "freqScaling", "standard or centered", TypeConverters.toString)
    oneHotThreshold = Param(Params._dummy(), "oneHotThreshold", "most categories for one-hot", TypeConverters.toInt)
    idThreshold = Param(Params._dummy(), "idThreshold", "distinct share of an id column", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featureCols: list[str] | None = None, outputCol: str = "features",
                 freqScaling: str = "standard", oneHotThreshold: int = 15, idThreshold: float = 0.95):
        super().__init__()
        self._setDefault(outputCol="features", freqScaling="standard", oneHotThreshold=15, idThreshold=0.95)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "TablePreprocessorModel":
        config = EngineConfig(one_hot_threshold=self.getOrDefault("oneHotThreshold"),
                              id_threshold=self.getOrDefault("idThreshold"))
        features = self.getOrDefault("featureCols")
        part = dataset.select([col(c) for c in features])
        text = categorical_columns(part)
        roles = {}
        if text:
            # One row per column.
            roles = {r["column"]: r["role"] for r in
                     distinct_counts(part, text).select("column", _role(config).alias("role")).collect()}
        by_role = {role: [c for c in text if roles.get(c, ONE_HOT) == role]
                   for role in (FREQUENCY, ONE_HOT, IDENTIFIER)}
        numeric = numeric_columns(part)
        ranges = column_ranges(part, numeric)
        n_rows = ranges["n"]
        medians = exact_quantiles(part, numeric, [0.5], config)
        state = {"numeric": [], "frequency": [], "one_hot": [], "id": by_role[IDENTIFIER], "dropped": []}
        for i, c in enumerate(numeric):
            if ranges[f"c{i}"] == 0:
                state["dropped"].append(c)  # nothing to impute from
                continue
            m, s = _after_imputation(ranges[f"c{i}"], n_rows, ranges[f"m{i}"], ranges[f"s{i}"], medians[c][0])
            state["numeric"].append({"name": c, "median": medians[c][0], "mean": m, "std": s})
        state["dropped"] += [c for c in features if c not in numeric and c not in text]
        encoder = None
        encoded = by_role[FREQUENCY] + by_role[ONE_HOT]
        if encoded:
            # Counted once for both encodings, and stored: frequencies are read at every transform.
            path = scratch_path(dataset.sparkSession, "categories")
            value_counts(part, encoded).write.partitionBy("column").parquet(path)
            counts = dataset.sparkSession.read.schema("value string, cnt long, column string").parquet(path)
            known = sorted_categories(counts, by_role[ONE_HOT])
            state["one_hot"] = [{"name": c, "categories": known[c]} for c in by_role[ONE_HOT]]
        if by_role[FREQUENCY]:
            stored = counts.filter(F.col("column").isin(by_role[FREQUENCY]))
            encoder, moments = FrequencyEncoderModel.of(stored, by_role[FREQUENCY])
            for c in by_role[FREQUENCY]:
                if self.getOrDefault("freqScaling") == "centered":
                    state["frequency"].append({"name": c, "mean": 0.5, "std": 1.0})
                    continue
                mean = moments[c][0] / n_rows
                variance = max(moments[c][1] / n_rows - mean * mean, 0.0)
                state["frequency"].append({"name": c, "mean": mean, "std": math.sqrt(variance)})
        model = TablePreprocessorModel(encoder)
        model._set(outputCol=self.getOutputCol(), state=json.dumps(state))
        return model


def _after_imputation(n: int, n_rows: int, mean: float, std: float, fill: float) -> tuple[float, float]:
    """Mean and deviation once the missing rows hold ``fill``."""
    missing = n_rows - n
    if not missing:
        return mean, std
    new_mean = (n * mean + missing * fill) / n_rows
    square = (n * (std * std + (mean - new_mean) ** 2) + missing * (fill - new_mean) ** 2) / n_rows
    return new_mean, math.sqrt(square)


class TablePreprocessorModel(Model, HasOutputCol, MLReadable, MLWritable):
    """Adds the feature vector; ``wide`` gives the same features as named columns."""

    state = Param(Params._dummy(), "state", "fitted numbers and categories, as JSON", TypeConverters.toString)

    def __init__(self, encoder: FrequencyEncoderModel | None = None):
        super().__init__()
        self._setDefault(outputCol="features")
        self.encoder = encoder

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault("state"))

    def input_names(self) -> list[str]:
        """Columns that the features are made of."""
        s = self.fitted
        return [x["name"] for kind in ("numeric", "frequency", "one_hot") for x in s[kind]]

    def feature_names(self) -> list[str]:
        s = self.fitted
        return ([x["name"] for x in s["numeric"]] + [x["name"] for x in s["frequency"]]
                + [f"{x['name']}_{v}" for x in s["one_hot"] for v in x["categories"]])

    def _expressions(self, df: DataFrame, encoded: dict[str, str]) -> list[Column]:
        s, out = self.fitted, []
        for x in s["numeric"]:
            v = present(col(x["name"]), dtype_of(df, x["name"])).cast("double")
            out.append(scaled(F.coalesce(v, F.lit(x["median"])), x["mean"], x["std"]).alias(x["name"]))
        for x in s["frequency"]:
            out.append(scaled(F.col(encoded[x["name"]]), x["mean"], x["std"]).alias(x["name"]))
        for x in s["one_hot"]:
            text = as_text(col(x["name"]), dtype_of(df, x["name"]))
            out += one_hot_columns(text, x["name"], x["categories"])
        return out

    def _encoded(self, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        if self.encoder is None:
            return df, {}
        columns = self.encoder.getInputCols()
        free = free_names([*df.columns, *columns], *[f"_freq_{i}" for i in range(len(columns))])
        names = dict(zip(columns, free))
        return self.encoder.encode(df, names), names

    def wide(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        encoded, names = self._encoded(df)
        return encoded.select([col(k) for k in keep] + self._expressions(df, names))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        encoded, names = self._encoded(dataset)
        exprs = self._expressions(dataset, names)
        out = self.getOutputCol()
        parts = free_names([*dataset.columns, out], *[f"_part_{i}" for i in range(len(exprs))])
        wide = encoded.select([col(c) for c in dataset.columns if c.lower() != out.lower()]
                              + [e.alias(p) for e, p in zip(exprs, parts)])
        assembled = VectorAssembler(inputCols=parts, outputCol=out).transform(wide).drop(*parts)
        attrs = [{"idx": i, "name": n} for i, n in enumerate(self.feature_names())]
        return assembled.withMetadata(out, {"ml_attr": {"attrs": {"numeric": attrs}, "num_attrs": len(attrs)}})

    def write(self) -> MLWriter:
        return _PreprocessorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PreprocessorReader(cls)


class _PreprocessorWriter(MLWriter):
    def __init__(self, instance: TablePreprocessorModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession,
                                         extraMetadata={"encoded": self.instance.encoder is not None})
        if self.instance.encoder is not None:
            self.instance.encoder.save(f"{path}/encoder")


class _PreprocessorReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TablePreprocessorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        encoder = FrequencyEncoderModel.load(f"{path}/encoder") if metadata.get("encoded") else None
        model = self.cls(encoder)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
