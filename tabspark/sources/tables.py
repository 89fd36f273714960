"""Table scans: CSV with encoding fallback and type inference, and typed formats."""

from __future__ import annotations

import os
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabspark.config import EngineConfig
from tabspark.functions.expr import col

# Texts that mean "missing" in a CSV cell.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Texts that read as booleans.
TRUE_TOKENS, FALSE_TOKENS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]

_INT = r"^[+-]?[0-9]{1,19}$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"


def csv_encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files to read in each encoding: UTF-8 if every line of a file is valid, otherwise Latin-1 (which accepts any byte)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("fine"))
    files = lines.groupBy("file").agg(F.bool_and("fine").alias("fine")).collect()  # one row per file
    if all(r["fine"] for r in files):
        return {"UTF-8": [path]}
    if not any(r["fine"] for r in files):
        return {"ISO-8859-1": [path]}
    return {name: [unquote(r["file"]) for r in files if r["fine"] == fine] for name, fine in (("UTF-8", True), ("ISO-8859-1", False))}


def scan_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All cells as text. ``multiline`` allows line breaks inside quotes, at the price of one task per file."""
    try:
        parts = [spark.read.option("header", True).option("encoding", name).option("escape", '"')
                 .option("multiLine", multiline).option("inferSchema", False).csv(files)
                 for name, files in csv_encodings(spark, path).items()]
        return reduce(DataFrame.unionByName, parts)
    except AnalysisException as error:
        raise _not_found(error, path) from error


def _not_found(error: AnalysisException, path: str) -> Exception:
    missing = "PATH_NOT_FOUND" in str(error.getCondition() or "")
    return FileNotFoundError(f"File not found: {path}") if missing else error


def _cell(name: str) -> Column:
    """The cell's text, null where it is a missing token."""
    return F.when(~col(name).isin(NA_TOKENS), col(name))


def infer_types(texts: DataFrame) -> DataFrame:
    """(column, inferred_type, n_missing): the narrowest type every present cell of a column fits.

    One aggregate over all columns. Mixed columns stay text; a column without
    any value is double.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(texts.columns):
        cell, trimmed = _cell(c), F.trim(_cell(c))
        whole = trimmed.rlike(_INT) & trimmed.try_cast("bigint").isNotNull()
        aggs += [F.count(cell).alias(f"c{i}"), F.count(F.when(whole, True)).alias(f"i{i}"),
                 F.count(F.when(trimmed.rlike(_FLOAT) | trimmed.rlike(_INFINITE), True)).alias(f"f{i}"),
                 F.count(F.when(cell.isin(TRUE_TOKENS + FALSE_TOKENS), True)).alias(f"b{i}")]
    rows = []
    for i, c in enumerate(texts.columns):
        n = F.col(f"c{i}")
        kind = (F.when(n == 0, "double").when(F.col(f"b{i}") == n, "boolean").when(F.col(f"i{i}") == n, "bigint")
                .when(F.col(f"f{i}") == n, "double").otherwise("string"))
        rows.append(F.struct(F.lit(c).alias("column"), kind.alias("inferred_type"),
                             (F.col("n") - n).alias("n_missing")))
    return texts.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def apply_types(texts: DataFrame, types: dict[str, str]) -> DataFrame:
    out = []
    for c in texts.columns:
        cell, kind = _cell(c), types.get(c, "string")
        if kind == "boolean":
            cell = F.when(cell.isin(TRUE_TOKENS), True).when(cell.isin(FALSE_TOKENS), False)
        elif kind != "string":
            cell = F.trim(cell).try_cast(kind)
        out.append(cell.alias(c))
    return texts.select(out)


def read_csv(spark: SparkSession, path: str, schema=None, multiline: bool = False) -> DataFrame:
    """Typed table from a CSV file or folder; an explicit schema skips the inference pass."""
    texts = scan_csv(spark, path, multiline)
    if schema is not None:
        return apply_types(texts, {f.name: f.dataType.simpleString() for f in schema})
    types = {r["column"]: r["inferred_type"] for r in infer_types(texts).collect()}  # one row per column
    return apply_types(texts, types)


def load_table(spark: SparkSession, path: str, config: EngineConfig = EngineConfig(),
               multiline: bool = False) -> DataFrame:
    """Reads by extension; a missing file or an unknown extension raises."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in config.allowed_extensions:
        raise ValueError(f"Unsupported file type: {extension}. Supported types: {list(config.allowed_extensions)}")
    if extension == ".csv":
        return read_csv(spark, path, multiline=multiline)
    try:
        return spark.read.format(extension[1:]).load(path)
    except AnalysisException as error:
        raise _not_found(error, path) from error


def preview_file(spark: SparkSession, path: str, n_rows: int = 5, config: EngineConfig = EngineConfig()) -> DataFrame:
    """First rows; the limit reaches the scan, and text cells are not typed."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension == ".csv":
        return spark.read.option("header", True).option("escape", '"').csv(path).limit(n_rows)
    return load_table(spark, path, config).limit(n_rows)
