"""Scoring a stream of new rows with the batch pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabspark.plans.scoring import score
from tabspark.session import scratch_path
from tabspark.sources.packages import ModelPackage


def score_stream(package: ModelPackage, rows: DataFrame, path: str, checkpoint: str | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Appends scored rows to a Parquet folder, each input row exactly once.

    Scoring keeps no state; the checkpoint only records which input was read.
    """
    spark = rows.sparkSession
    writer = (score(package, rows).writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint or scratch_path(spark, "stream")))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
