"""Projections, filters and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabspark.functions.expr import (
    booleans_to_text, categorical_columns, col, dtype_of, numeric_columns, present,
)


def preview(df: DataFrame, n_rows: int = 5, order_by: list[str] | None = None) -> DataFrame:
    return (df.orderBy(*order_by) if order_by else df).limit(n_rows)


def select_target(df: DataFrame, target: str) -> DataFrame:
    """Features first, target last; the rows stay aligned by construction."""
    require_columns(df, [target])
    return df.select([col(c) for c in df.columns if c != target] + [col(target)])


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n not in df.columns]


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = missing_columns(df, names)
    if missing:
        raise ValueError(f"Missing columns: {missing}. Available columns: {df.columns}")


def column_exists(df: DataFrame, name: str) -> tuple[bool, str]:
    if name in df.columns:
        return True, f"Column '{name}' exists"
    return False, f"Column '{name}' not found. Available columns: {df.columns}"


def columns_exist(df: DataFrame, names: list[str]) -> tuple[bool, str]:
    missing = missing_columns(df, names)
    return (False, f"Missing columns: {missing}") if missing else (True, f"All {len(names)} columns exist")


def column_report(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per asked column: whether it exists and how many values it holds."""
    have = [n for n in names if n in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.count(present(col(n), dtype_of(df, n))).alias(f"c{i}") for i, n in enumerate(have)])
    index = {n: i for i, n in enumerate(have)}
    rows = [F.struct(F.lit(n).alias("column"), F.lit(n in index).alias("column_exists"),
                     (F.col(f"c{index[n]}") if n in index else F.lit(0).cast("long")).alias("n_values"))
            for n in names]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def feature_target_check(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Features and target share one DataFrame, so equal length is structural."""
    if not features:
        return df.limit(0).agg(F.lit(False).alias("valid"), F.lit("Feature matrix has no columns").alias("message"))
    if target in features:
        text = f"Target '{target}' is still in feature matrix"
        return df.limit(0).agg(F.lit(False).alias("valid"), F.lit(text).alias("message"))
    require_columns(df, [*features, target])
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(True).alias("valid"),
        F.format_string("Feature-target split is valid (%d samples, %d features)",
                        F.col("n"), F.lit(len(features))).alias("message"))


def select_by_type(df: DataFrame, keep_keys: list[str] = ()) -> DataFrame:
    """Numeric columns, then text columns; every other type is dropped."""
    wanted = [*numeric_columns(df), *categorical_columns(df)]
    return booleans_to_text(df.select([col(c) for c in [*keep_keys, *[w for w in wanted if w not in keep_keys]]]))


def drop_target(df: DataFrame, target: str) -> DataFrame:
    return df.drop(target)


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.filter(present(col(column), dtype_of(df, column)).isNotNull())
