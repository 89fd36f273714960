"""Named queries over the standard tables, each with its SQL statement where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, exprs: list[str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*exprs)


def rounded(df: DataFrame, digits: int | dict = 6) -> DataFrame:
    """Doubles rounded (per column when ``digits`` is a dict), whole numbers as bigint."""
    out = []
    for f in df.schema:
        c: Column = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            d = digits.get(f.name, 6) if isinstance(digits, dict) else digits
            c = F.round(c.cast("double"), d) + F.lit(0.0)  # no negative zero
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(out)


def r(expr: str, alias: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f'round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS "{alias}"'


# Columns with missing values and booleans, which the stored tables lack. The
# texts are valid in Spark SQL and in DuckDB.
LINES = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
    "l_extendedprice", "l_discount", "l_tax",
    "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "l_linestatus", "l_discount > 0.05 AS discounted", "l_shipdate", "1 AS one",
]
PARTS = [
    "p_partkey", "p_name",
    "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS p_brand",
    "p_type", "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size", "p_retailprice",
    "p_size > 25 AS pricey",
]
ORDERS = [
    "o_orderkey", "o_custkey", "o_orderstatus",
    "CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END AS o_totalprice", "o_orderpriority",
]


def select(exprs: list[str], name: str) -> str:
    return f"SELECT {', '.join(exprs)} FROM {name}"


LINES_SQL, PARTS_SQL, ORDERS_SQL = select(LINES, "lineitem"), select(PARTS, "part"), select(ORDERS, "orders")


def lines(spark, sf_dir):
    return derived(spark, sf_dir, "lineitem", LINES)


def parts(spark, sf_dir):
    return derived(spark, sf_dir, "part", PARTS)


def orders(spark, sf_dir):
    return derived(spark, sf_dir, "orders", ORDERS)
