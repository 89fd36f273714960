"""File metadata and admission, without reading file contents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabspark.config import EngineConfig

_DDL = "name string, extension string, file_exists boolean, size_bytes long, size_mb double"


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """(name, extension, file_exists, size_bytes, size_mb) of a file or of every file in a folder.

    Taken from the file system's listing, on any file system Spark can reach:
    a scan would not show empty files.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    sizes = [(os.path.basename(path), False, 0)]
    if system.exists(place):
        sizes = [(s.getPath().getName(), True, s.getLen()) for s in system.listStatus(place) if s.isFile()]
    rows = [(n, os.path.splitext(n)[1].lower(), exists, size, round(size / (1024 * 1024), 2)) for n, exists, size in sizes]
    return spark.createDataFrame(rows, _DDL)


def validate_file(spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(name, valid, message) per file: the first failing check gives the message."""
    limit = config.max_file_size_mb
    allowed = list(config.allowed_extensions)
    failure = (
        F.when(~F.col("file_exists"), F.concat(F.lit("File not found: "), F.col("name")))
        .when(~F.col("extension").isin(allowed), F.concat(
            F.lit("Unsupported file type: "), F.col("extension"), F.lit(f". Allowed: {allowed}")))
        .when(F.col("size_bytes") > limit * 1_000_000, F.format_string(
            f"File too large: %.1fMB (max: {limit}MB)", F.col("size_bytes") / 1_000_000.0))
        .when(F.col("size_bytes") == 0, F.lit("File is empty (0 bytes)")))
    return file_info(spark, path).select("name", failure.isNull().alias("valid"),
                                         F.coalesce(failure, F.lit("File is valid")).alias("message"))
