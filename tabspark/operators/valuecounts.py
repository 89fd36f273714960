"""The value-count relation (column, value, cnt) behind many operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabspark.functions.expr import FLOAT_TYPES, INTEGER_TYPES, as_text, col, dtype_of, present, short_key


def _key(df: DataFrame, index: int, name: str, keep_text: bool) -> Column:
    """A cell as (column number, whole number, double, text): numbers are counted as numbers."""
    dt, v = dtype_of(df, name), col(name)
    whole = double = text = F.lit(None)
    if isinstance(dt, INTEGER_TYPES + (T.BooleanType,)):
        whole = v
    elif isinstance(dt, T.DateType):
        whole = F.unix_date(v)
    elif isinstance(dt, T.TimestampType):
        whole = F.unix_micros(v)
    elif isinstance(dt, FLOAT_TYPES + (T.DecimalType,)):
        double = present(v, dt)
    else:
        text = as_text(v, dt) if keep_text else short_key(as_text(v, dt))
    return F.struct(F.lit(index).alias("c"), whole.cast("long").alias("l"), double.cast("double").alias("d"),
                    text.cast("string").alias("s"))


def _counts(df: DataFrame, columns: list[str], keep_text: bool) -> DataFrame:
    keys = F.array(*[_key(df, i, c, keep_text) for i, c in enumerate(columns)])
    return (df.select(F.explode(keys).alias("k")).groupBy("k.c", "k.l", "k.d", "k.s")
            .agg(F.count(F.lit(1)).alias("cnt")))


def _names(columns: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, cnt): rows per distinct value of every column; a null value has its own row.

    One unpivot and one shuffle for all columns, combined on the map side, so
    a value that fills a third of the rows still reaches the reducers as one
    row per task. Values become text only after they are counted.
    """
    text = F.coalesce(F.col("s"), F.col("l").cast("string"), F.col("d").cast("string"))
    for i, c in enumerate(columns):
        dt, here = dtype_of(df, c), F.col("c") == i
        if isinstance(dt, T.BooleanType):
            text = F.when(here, F.when(F.col("l") == 1, "True").when(F.col("l") == 0, "False")).otherwise(text)
        elif isinstance(dt, T.DateType):
            text = F.when(here, F.date_from_unix_date(F.col("l").cast("int")).cast("string")).otherwise(text)
        elif isinstance(dt, T.FloatType):
            text = F.when(here, F.col("d").cast("float").cast("string")).otherwise(text)
    return _counts(df, columns, True).select(_names(columns).alias("column"), text.alias("value"), "cnt")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct, present and total rows per column; long texts are compared by digest."""
    held = F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()
    return (
        _counts(df, columns, False).groupBy("c")
        .agg(F.count(F.when(held, True)).alias("n_unique"),
             F.coalesce(F.sum(F.when(held, F.col("cnt"))), F.lit(0)).alias("n_present"),
             F.sum("cnt").alias("n_rows"))
        .select(_names(columns).alias("column"), "n_unique", "n_present", "n_rows")
    )
