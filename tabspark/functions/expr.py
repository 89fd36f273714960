"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = INTEGER_TYPES + FLOAT_TYPES + (T.DecimalType,)
COUNTABLE_TYPES = NUMERIC_TYPES + (
    T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores added until they differ from all taken ones in any case."""
    used = {n.lower() for n in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC_TYPES)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Text columns, and booleans because they are encoded as text."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def countable_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, COUNTABLE_TYPES)]


def present(c: Column, dtype: T.DataType) -> Column:
    """NaN becomes null and decimals become doubles: one notion of missing."""
    if isinstance(dtype, FLOAT_TYPES):
        return F.when(~F.isnan(c), c)
    if isinstance(dtype, T.DecimalType):
        return c.cast("double")
    return c


def normalise(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    keep = columns or df.columns
    return df.select([present(col(n), dtype_of(df, n)).alias(n) for n in keep])


def bool_text(c: Column) -> Column:
    """Booleans as 'True' / 'False' (a plain cast would give lower case)."""
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))


def booleans_to_text(df: DataFrame) -> DataFrame:
    return df.select([
        bool_text(col(f.name)).alias(f.name) if isinstance(f.dataType, T.BooleanType) else col(f.name)
        for f in df.schema
    ])


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Text that is equal exactly when the values are equal."""
    if isinstance(dtype, T.BooleanType):
        return bool_text(c)
    if isinstance(dtype, T.DecimalType):
        return c.cast("double").cast("string")
    if isinstance(dtype, FLOAT_TYPES):
        return (F.when(~F.isnan(c), c) + F.lit(0.0).cast(dtype)).cast("string")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def short_key(text: Column) -> Column:
    """The text itself, or a SHA-256 of the whole text where that is smaller.

    Used where only equality matters, so that long texts are not shuffled.
    """
    return F.when(F.length(text) <= 64, text).otherwise(F.concat(F.lit("sha256:"), F.sha2(text, 256)))


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a whole row; lengths and null marks keep fields apart."""
    parts = []
    for n in columns or df.columns:
        text = as_text(col(n), dtype_of(df, n))
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.sha2(F.concat(*parts), 256)


def one_row_sum(columns: list[Column]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + c
    return total
