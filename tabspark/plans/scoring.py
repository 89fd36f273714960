"""Scoring new tables with a trained pipeline."""

from __future__ import annotations

import logging

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabspark.functions.expr import col, free_names
from tabspark.sources.packages import ModelPackage

log = logging.getLogger(__name__)


def score(package: ModelPackage, df: DataFrame, probabilities: bool = True) -> DataFrame:
    """The original columns, ``Prediction`` and, where the model gives them, ``Probability_Class_{i}``.

    Original columns may have any name: while the model works they travel in one
    structure beside the feature vector, and a result whose name is taken gets
    an underscore. Row-local except for the lookup of frequencies, so it also
    runs on a stream.
    """
    if package.target in df.columns:
        log.warning("target column %s is ignored when scoring", package.target)
        df = df.drop(package.target)
    first, *rest = package.pipeline.stages
    inputs = first.input_names() if hasattr(first, "input_names") else first.getInputCols()
    row, vector = free_names([*df.columns, *inputs], "_row"), first.getOutputCol()
    held = df.select(F.struct(*[col(c) for c in df.columns]).alias(row[0]), *[col(c) for c in inputs if c in df.columns])
    scored = first.transform(held).select(F.col(row[0]).alias("_row"), vector)
    for stage in rest:
        scored = stage.transform(scored)
    given = [F.col("_row").getField(c).alias(c) for c in df.columns]
    classes = range(len(package.labels)) if probabilities and package.labels and "probability" in scored.columns else ()
    names = free_names(df.columns, "Prediction", *[f"Probability_Class_{i}" for i in classes])
    out = [F.col("predicted_label" if package.labels else "prediction").alias(names[0])]
    if classes:
        p = vector_to_array("probability")
        out += [p[i].alias(n) for i, n in zip(classes, names[1:])]
    return scored.select(given + out)


def prediction_summary(scored: DataFrame, task: str, prediction: str = "Prediction") -> DataFrame:
    """Total rows, and distinct predictions (classes) or mean and population deviation (numbers)."""
    total = F.count(F.lit(1)).alias("total")
    if task == "classification":
        return scored.groupBy(col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("p").alias("n_classes"))
    v = col(prediction).cast("double")
    return scored.agg(total, F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
