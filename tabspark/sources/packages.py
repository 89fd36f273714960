"""Sinks for predictions and trained pipelines, and the way back."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Writes in parallel, one file per task, header in every CSV file."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


@dataclass
class ModelPackage:
    """Everything needed to score new tables."""
    pipeline: PipelineModel
    model_name: str
    task: str
    target: str
    feature_names: list[str]
    labels: list[str]
    n_samples: int
    source: str  # "trained" or "tuned"
    train_date: str = ""

    def metadata(self) -> dict:
        return {"model_name": self.model_name, "task": self.task, "target": self.target,
                "feature_names": self.feature_names, "labels": self.labels, "n_features": len(self.feature_names),
                "n_samples": self.n_samples, "source": self.source,
                "train_date": self.train_date or datetime.now(timezone.utc).isoformat()}


def save_package(spark: SparkSession, package: ModelPackage, path: str) -> str:
    package.pipeline.write().overwrite().save(f"{path}/pipeline")
    text = json.dumps(package.metadata())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return path


def load_package(spark: SparkSession, path: str) -> ModelPackage:
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    meta.pop("n_features")
    return ModelPackage(pipeline=PipelineModel.load(f"{path}/pipeline"), **meta)
