"""Single encoding steps: imputation, scaling, one-hot and frequency encoding."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReader, MLWriter, MLReadable, MLWritable,
)
from pyspark.sql import Column, DataFrame, functions as F

from tabspark.config import EngineConfig
from tabspark.functions.expr import as_text, col, countable_columns, dtype_of, free_names, present
from tabspark.functions.rank import column_ranges, exact_quantiles
from tabspark.operators.valuecounts import value_counts
from tabspark.session import scratch_path

# Categories at least this frequent number a thousand at most, whatever the data.
_HOT_FREQUENCY = 0.001
_SALTS = 1024


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select([new[c].alias(c) if c in new else col(c) for c in df.columns])


def impute_median(df: DataFrame, columns: list[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """Missing numbers become the exact interpolated median."""
    medians = exact_quantiles(df, columns, [0.5], config)
    return _replace(df, {c: F.coalesce(present(col(c), dtype_of(df, c)).cast("double"), F.lit(medians[c][0]))
                         for c in columns})


def impute_constant(df: DataFrame, columns: list[str], value: str = "missing") -> DataFrame:
    return _replace(df, {c: F.coalesce(as_text(col(c), dtype_of(df, c)), F.lit(value)) for c in columns})


def scaled(c: Column, mean: float | None, std: float | None) -> Column:
    return (c - F.lit(float(mean or 0.0))) / F.lit(float(std) if std else 1.0)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns are only centred."""
    stats = column_ranges(df, columns)
    return _replace(df, {c: scaled(present(col(c), dtype_of(df, c)).cast("double"), stats[f"m{i}"], stats[f"s{i}"])
                         for i, c in enumerate(columns)})


def categories(df: DataFrame, columns: list[str], fill: str = "missing") -> dict[str, list[str]]:
    """Sorted categories of low-cardinality columns (the caller has checked the count)."""
    return sorted_categories(value_counts(df, columns), columns, fill) if columns else {}


def sorted_categories(counts: DataFrame, columns: list[str], fill: str = "missing") -> dict[str, list[str]]:
    out: dict[str, set] = {c: set() for c in columns}
    for r in counts.filter(F.col("column").isin(columns)).select("column", "value").collect():
        out[r["column"]].add(fill if r["value"] is None else r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot_columns(c: Column, name: str, values: list[str], fill: str = "missing") -> list[Column]:
    """One 0/1 column per category; a category unknown at fit gives zeros only."""
    text = F.coalesce(c, F.lit(fill))
    return [(text == F.lit(v)).cast("double").alias(f"{name}_{v}") for v in values]


def one_hot(df: DataFrame, column: str, values: list[str] | None = None, keep: list[str] = ()) -> DataFrame:
    values = categories(df, [column])[column] if values is None else values
    text = as_text(col(column), dtype_of(df, column))
    return df.select([col(k) for k in keep] + one_hot_columns(text, column, values))


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, cnt, frequency): share of the present rows per category."""
    totals = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return with_shares(value_counts(df, columns), {c: totals[f"c{i}"] for i, c in enumerate(columns)})


def with_shares(counts: DataFrame, totals: dict[str, int]) -> DataFrame:
    """Value counts with the share of each value; the totals, one per column, are literals."""
    total = F.lit(None).cast("double")
    for c, n in totals.items():
        total = F.when(F.col("column") == c, F.lit(float(n))).otherwise(total)
    return counts.filter(F.col("value").isNotNull()).select(
        "column", "value", "cnt", (F.col("cnt") / total).alias("frequency"))


class FrequencyEncoder(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces categories by their share of the rows seen at fit."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "FrequencyEncoderModel":
        path = scratch_path(dataset.sparkSession, "frequencies")
        columns = self.getInputCols()
        value_counts(dataset, columns).write.parquet(path)
        return FrequencyEncoderModel.of(dataset.sparkSession.read.parquet(path), columns)[0]


class FrequencyEncoderModel(Model, HasInputCols, MLReadable, MLWritable):
    """Fitted frequencies, kept as a table because categories can be many."""

    nCategories = Param(Params._dummy(), "nCategories", "categories over all columns", TypeConverters.toInt)
    nBytes = Param(Params._dummy(), "nBytes", "text size of all categories", TypeConverters.toFloat)
    broadcastRows = Param(Params._dummy(), "broadcastRows", "largest broadcast, in rows", TypeConverters.toInt)
    broadcastBytes = Param(Params._dummy(), "broadcastBytes", "largest broadcast, in bytes", TypeConverters.toInt)

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        config = EngineConfig()
        self._setDefault(broadcastRows=config.broadcast_rows, broadcastBytes=config.broadcast_bytes)
        self.table = table

    @classmethod
    def of(cls, counts: DataFrame, columns: list[str]) -> tuple["FrequencyEncoderModel", dict]:
        """The model of stored counts, and per column the sums of frequency and its square over the rows."""
        c = F.col("cnt").cast("double")
        rows = counts.filter(F.col("value").isNotNull()).groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 24).alias("b"), F.sum("cnt").alias("t"),
            F.sum(c * c).alias("c2"), F.sum(c * c * c).alias("c3")).collect()  # one per column
        sums = {c: (0.0, 0.0) for c in columns} | {
            r["column"]: (r["c2"] / r["t"], r["c3"] / r["t"] ** 2) for r in rows}
        model = cls(with_shares(counts, {r["column"]: r["t"] for r in rows}))
        model._set(inputCols=columns, nCategories=sum(r["n"] for r in rows), nBytes=float(sum(r["b"] for r in rows)))
        return model, sums

    def fits_broadcast(self) -> bool:
        return (self.getOrDefault("nCategories") <= self.getOrDefault("broadcastRows")
                and self.getOrDefault("nBytes") <= self.getOrDefault("broadcastBytes"))

    def _lookup(self, column: str, value: str, frequency: str) -> DataFrame:
        return self.table.filter(F.col("column") == column).select(
            F.col("value").alias(value), F.col("frequency").alias(frequency))

    def encode(self, dataset: DataFrame, outputs: dict[str, str]) -> DataFrame:
        """Append one frequency column per entry of ``outputs`` (input column -> new column)."""
        small = self.fits_broadcast()
        for c, out in outputs.items():
            if c not in dataset.columns:
                dataset = dataset.withColumn(out, F.lit(0.0))
                continue
            order = dataset.columns
            text = as_text(col(c), dtype_of(dataset, c))
            key, value, frequency = free_names(order, "_key", "_value", "_frequency")
            if small:
                joined = (dataset.withColumn(key, text)
                          .join(F.broadcast(self._lookup(c, value, frequency)), F.col(key) == F.col(value), "left"))
                new = F.coalesce(frequency, F.lit(0.0))
            else:
                joined, new = self._join_large(dataset, text, self._lookup(c, value, frequency))
            dataset = joined.select([col(n) for n in order] + [new.alias(out)])
        return dataset

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = self.getInputCols()
        outputs = dict(zip(columns, free_names([*dataset.columns, *columns], *[f"_freq_{i}" for i in range(len(columns))])))
        wide = self.encode(dataset, outputs)
        kept = [F.col(outputs[n]).alias(n) if n in outputs else col(n) for n in dataset.columns]
        return wide.select(kept + [F.col(o).alias(c) for c, o in outputs.items() if c not in dataset.columns])

    @staticmethod
    def _join_large(dataset: DataFrame, text: Column, lookup: DataFrame) -> tuple[DataFrame, Column]:
        """Frequent categories by broadcast, the others by a shuffle join.

        At most a thousand categories reach the hot threshold. Rows that found
        their value there enter the shuffle without a key, spread by a salt, so
        a category holding a third of the rows does not fill one partition.
        """
        value, frequency = lookup.columns
        key, hot_value, hot_share, cold_key, cold_salt, salt = free_names(
            [*dataset.columns, value, frequency], "_key", "_hot_value", "_hot", "_cold_key", "_cold_salt", "_salt")
        hot = lookup.filter(F.col(frequency) >= _HOT_FREQUENCY).select(
            F.col(value).alias(hot_value), F.col(frequency).alias(hot_share))
        cold = lookup.filter(F.col(frequency) < _HOT_FREQUENCY).withColumn(cold_salt, F.lit(0))
        done = F.col(hot_share).isNotNull() | F.col(key).isNull()
        spread = F.pmod(F.xxhash64(*[col(n) for n in countable_columns(dataset)]), F.lit(_SALTS))
        rows = (dataset.withColumn(key, text)
                .join(F.broadcast(hot), F.col(key) == F.col(hot_value), "left")
                .withColumn(cold_key, F.when(~done, F.col(key)))
                .withColumn(salt, F.when(done, spread.cast("int") + 1).otherwise(F.lit(0))))
        joined = rows.join(cold, (F.col(cold_key) == F.col(value)) & (F.col(salt) == F.col(cold_salt)), "left")
        return joined, F.coalesce(hot_share, frequency, F.lit(0.0))

    def write(self) -> MLWriter:
        return _FrequencyWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FrequencyReader(cls)


class _FrequencyWriter(MLWriter):
    def __init__(self, instance: FrequencyEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/frequencies")


class _FrequencyReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FrequencyEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/frequencies"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
