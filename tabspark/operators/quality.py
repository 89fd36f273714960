"""Table and target admission, and the data quality report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabspark.config import EngineConfig
from tabspark.functions.expr import (
    FLOAT_TYPES, as_text, col, countable_columns, dtype_of, free_names, numeric_columns, one_row_sum, present, row_digest,
)
from tabspark.operators.valuecounts import distinct_counts
from tabspark.session import cut_lineage


def _summary(df: DataFrame, spread: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """One wide aggregate: rows, values per column and (optionally) constancy.

    A column is constant exactly when its least and greatest value agree, which
    needs no distinct count and so no shuffle of the values.
    """
    index = {c: i for i, c in enumerate(df.columns)}
    aggs = [F.count(F.lit(1)).alias("n")]
    countable = set(countable_columns(df))
    for c, i in index.items():
        v = present(col(c), dtype_of(df, c))
        aggs.append(F.count(v).alias(f"c{i}"))
        if spread:
            t = v if c in countable else F.to_json(F.struct(v.alias("v")))
            aggs.append((F.min(t) == F.max(t)).alias(f"k{i}"))
    return df.agg(*aggs), index


def validate_table(df: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row (valid, message); the checks run in order and the first failure wins."""
    s, index = _summary(df, spread=True)
    n = F.col("n")
    all_null = F.filter(F.array(*[F.when(F.col(f"c{i}") == 0, F.lit(c)) for c, i in index.items()]),
                        lambda x: x.isNotNull())
    not_constant = [F.coalesce(~F.col(f"k{i}"), F.lit(False)) for i in index.values()]
    varied = reduce(lambda a, b: a | b, not_constant)
    # Message formats.
    failure = (
        F.when(n == 0, F.lit("DataFrame is empty (no data)"))
        .when(n < config.min_rows, F.format_string(f"Too few rows: %d (minimum: {config.min_rows})", n))
        .when(F.lit(len(index) < config.min_columns),
              F.lit(f"Too few columns: {len(index)} (minimum: {config.min_columns})"))
        .when(F.size(all_null) > 0,
              F.concat(F.lit("Columns are entirely null: "), F.array_join(all_null, ", ")))
        .when(F.lit(not numeric_columns(df)), F.lit(
            "No numeric columns found. Dataset must have at least one numeric feature."))
        .when(~varied, F.lit("All columns contain only one unique value"))
    )
    fine = F.format_string(f"DataFrame is valid (%d rows, {len(index)} columns)", n)
    return s.select(failure.isNull().alias("valid"), F.coalesce(failure, fine).alias("message"))


def _target_counts(df: DataFrame, target: str) -> DataFrame:
    v = present(col(target), dtype_of(df, target))
    return (df.select(as_text(v, dtype_of(df, target)).alias("value"))
            .groupBy("value").agg(F.count(F.lit(1)).alias("cnt")))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, present rows, classes, smallest and largest class."""
    v = F.col("value").isNotNull()
    return _target_counts(df, target).agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(v, F.col("cnt"))), F.lit(0)).alias("n_present"),
        F.count("value").alias("n_unique"),
        F.min(F.when(v, F.col("cnt"))).alias("min_class"),
        F.max(F.when(v, F.col("cnt"))).alias("max_class"),
        F.min("value").alias("some_value"),
    )


def validate_target(df: DataFrame, target: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row (valid, message, warning) for a target column."""
    n, unique = F.col("n"), F.col("n_unique")
    null_ratio = F.try_divide(n - F.col("n_present"), n)
    majority = F.try_divide("max_class", n)
    # Message formats.
    failure = (
        F.when(n == 0, F.lit(f"Target '{target}' is empty"))
        .when(F.col("n_present") == 0, F.lit(f"Target '{target}' is entirely null"))
        .when(null_ratio > config.max_null_ratio, F.format_string(
            f"Target '%s' has too many missing values: %.1f%% (max: {config.max_null_ratio * 100:.0f}%%)",
            F.lit(target), null_ratio * 100))
        .when(unique == 1, F.concat(F.lit(f"Target '{target}' has only one unique value: "), F.col("some_value")))
        .when((unique <= 50) & (F.col("min_class") < 3), F.format_string(
            "Target has class with only %d sample(s). Each class needs at least 3 samples "
            "for proper train/val/test splitting.", F.col("min_class")))
    )
    fine = F.format_string("Target is valid (%d samples, %d unique values)", n, unique)
    warning = F.when(failure.isNull() & (unique <= 50), F.concat_ws(
        "; ",
        F.when(F.col("min_class") < 4, F.format_string(
            "Class with only %d samples - may not appear in all splits", F.col("min_class"))),
        F.when(majority > 0.95, F.format_string(
            "Target is highly imbalanced: %.1f%% in majority class", majority * 100)),
    ))
    return target_summary(df, target).select(
        failure.isNull().alias("valid"), F.coalesce(failure, fine).alias("message"),
        F.coalesce(warning, F.lit("")).alias("warning"))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def nulls_by_column(df: DataFrame) -> DataFrame:
    """(column, n_missing, missing_pct) for every column, from one aggregate."""
    s, index = _summary(df)
    n = F.col("n")
    rows = [F.struct(F.lit(c).alias("column"), (n - F.col(f"c{i}")).alias("n_missing"),
                     F.try_divide((n - F.col(f"c{i}")) * 100.0, n).alias("missing_pct")) for c, i in index.items()]
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def null_summary(df: DataFrame) -> DataFrame:
    s, index = _summary(df)
    n = F.col("n")
    missing = {c: n - F.col(f"c{i}") for c, i in index.items()}
    ratio = F.array(*[F.try_divide(m, n) for m in missing.values()])
    above = F.filter(F.array(*[F.when(F.try_divide(m, n) > 0.5, F.lit(c)) for c, m in missing.items()]),
                     lambda x: x.isNotNull())
    return s.select(
        one_row_sum(list(missing.values())).cast("long").alias("total_nulls"),
        one_row_sum([(m > 0).cast("long") for m in missing.values()]).cast("long").alias("columns_with_nulls"),
        F.array_max(ratio).alias("max_null_ratio"),
        F.array_join(above, ",").alias("columns_above_50pct_null"),
    )


def missing_severity(df: DataFrame) -> DataFrame:
    pct = F.col("missing_pct")
    return (nulls_by_column(df).filter(pct > 0)
            .withColumn("severity", F.when(pct > 30, "high").when(pct > 10, "medium").otherwise("low"))
            .orderBy(pct.desc(), "column"))


def dtype_summary(df: DataFrame) -> DataFrame:
    """Columns and present cells per data type."""
    s, index = _summary(df)
    rows = [F.struct(F.lit(dtype_of(df, c).simpleString()).alias("dtype"), F.col(f"c{i}").alias("c"))
            for c, i in index.items()]
    return (s.select(F.explode(F.array(*rows)).alias("r")).groupBy("r.dtype")
            .agg(F.count(F.lit(1)).alias("n_columns"), F.sum("r.c").alias("n_values")))


def _row_hash(df: DataFrame) -> Column:
    """A 64-bit hash that equal rows share; the pattern of nulls enters it."""
    parts = []
    for c in df.columns:
        dt = dtype_of(df, c)
        if isinstance(dt, FLOAT_TYPES):
            parts.append(present(col(c), dt) + F.lit(0.0).cast(dt))  # one zero
        elif isinstance(dt, (T.DecimalType, T.ArrayType, T.StructType, T.MapType)):
            parts.append(as_text(col(c), dt))
        else:
            parts.append(col(c))
    return F.xxhash64(*parts, *[p.isNull() for p in parts])


def duplicate_rows(df: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Rows beyond the first of each group of equal rows (nulls are equal).

    Rows are first counted by a 64-bit hash. Only those that share theirs are
    looked at again and compared by a SHA-256 of the whole row, so most rows are
    shuffled as eight bytes and never digested.
    """
    hashes = df.select(_row_hash(df).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    suspects = cut_lineage(hashes.where("c > 1").select("h"))
    n = suspects.count()
    name = free_names(df.columns, "_h")[0]
    suspects = suspects.withColumnRenamed("h", name)
    few = F.broadcast(suspects) if n <= config.broadcast_rows else suspects
    rows = df.withColumn(name, _row_hash(df)).join(few, name, "left_semi")
    return (rows.select(F.unhex(row_digest(df)).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("c"))
            .agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_rows")))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct present value."""
    s, index = _summary(df, spread=True)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"k{i}").alias("k"), F.col(f"c{i}").alias("n_values"))
            for c, i in index.items()]
    return (s.select(F.explode(F.array(*rows)).alias("r"))
            .filter(F.col("r.k")).select("r.column", "r.n_values"))


def high_cardinality_columns(df: DataFrame, ratio: float = 0.9) -> DataFrame:
    """Columns whose exact distinct count exceeds ``ratio`` of all rows."""
    return (distinct_counts(df, countable_columns(df))
            .filter(F.col("n_unique") > F.col("n_rows") * ratio)
            .select("column", "n_unique"))


def target_preview(df: DataFrame, target: str, top: int = 10) -> DataFrame:
    """Most frequent target values beside the target's own summary."""
    counts = _target_counts(df, target)
    head = counts.filter(F.col("value").isNotNull()).orderBy(F.col("cnt").desc(), "value").limit(top)
    s = target_summary(df, target).select(F.struct(
        "n_unique", (F.col("n") - F.col("n_present")).alias("n_missing"),
        F.try_divide("n_unique", "n").alias("unique_ratio")).alias("s"))
    return (head.withColumn("s", s.scalar()).select("value", "cnt", "s.*")
            .withColumn("dtype", F.lit(dtype_of(df, target).simpleString())))


def validation_report(df: DataFrame, target: str | None = None,
                      config: EngineConfig = EngineConfig()) -> DataFrame:
    """All admission and quality checks as (check, status, message, value).

    Three jobs' worth of work: one wide aggregate for everything that needs no
    distinct values, one value-count shuffle, one row-digest shuffle.
    """
    def line(name: str, status: Column, message: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), status.alias("status"), message.alias("message"),
                        value.cast("double").alias("value"))

    def verdict(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(line(name, F.when(F.col("valid"), "pass").otherwise("fail"),
                                 F.col("message"), F.lit(None)).alias("r"))

    info = F.lit("info")
    parts = [verdict(validate_table(df, config), "table")]
    if target is not None:
        if target in df.columns:
            parts.append(verdict(validate_target(df, target, config), "target"))
        else:
            text = f"Column '{target}' not found. Available columns: {df.columns}"
            parts.append(df.limit(0).agg(F.count(F.lit(1))).select(
                line("target", F.lit("fail"), F.lit(text), F.lit(None)).alias("r")))
    s, index = _summary(df, spread=True)
    n = F.col("n")
    missing = [n - F.col(f"c{i}") for i in index.values()]
    constant = F.filter(F.array(*[F.when(F.col(f"k{i}"), F.lit(c)) for c, i in index.items()]),
                        lambda x: x.isNotNull())
    parts.append(s.select(F.explode(F.array(
        line("n_rows", info, F.lit(""), n),
        line("n_columns", info, F.lit(""), F.lit(len(index))),
        line("total_nulls", info, F.lit(""), one_row_sum(missing)),
        line("columns_with_nulls", info, F.lit(""), one_row_sum([(m > 0).cast("long") for m in missing])),
        line("max_null_ratio", info, F.lit(""), F.array_max(F.array(*[F.try_divide(m, n) for m in missing]))),
        line("constant_columns", info, F.array_join(F.array_sort(constant), ","), F.size(constant)),
    )).alias("r")))
    parts.append(high_cardinality_columns(df).agg(
        F.array_sort(F.collect_list("column")).alias("names")).select(  # at most one entry per column
        line("high_cardinality_columns", info, F.array_join("names", ","), F.size("names")).alias("r")))
    parts.append(duplicate_rows(df).select(
        line("duplicate_rows", info, F.lit(""), F.col("duplicate_rows")).alias("r")))
    return reduce(DataFrame.unionByName, parts).select("r.*")
