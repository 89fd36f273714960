"""Projections, admission checks, profiling and task detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabspark.operators import quality as q, select as sel, task as t
from tabspark.suite.registry import (
    LINES,
    LINES_SQL, ORDERS_SQL, PARTS_SQL, lines, orders, parts, query, r, rounded, table,
)


@query("preview", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return sel.preview(df, 5, ["o_orderkey"])


@query("select_target", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders")
def select_target(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return sel.select_target(df, "o_orderstatus")


@query("drop_target", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def drop_target(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return sel.drop_target(df, "o_orderstatus")


@query("drop_null_target", f"SELECT * FROM ({ORDERS_SQL}) WHERE o_totalprice IS NOT NULL")
def drop_null_target(spark, d):
    return sel.drop_missing(orders(spark, d), "o_totalprice")


@query("select_by_type", f"""
SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice, p_name, p_brand, p_type,
       CASE WHEN pricey THEN 'True' WHEN NOT pricey THEN 'False' END AS pricey FROM ({PARTS_SQL})""")
def select_by_type(spark, d):
    return rounded(sel.select_by_type(parts(spark, d)))


@query("bool_to_string", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CASE WHEN discounted THEN 'True' WHEN NOT discounted THEN 'False' END AS discounted FROM ({LINES_SQL})""")
def bool_to_string(spark, d):
    from tabspark.functions.expr import booleans_to_text
    return rounded(booleans_to_text(lines(spark, d).select("l_orderkey", "l_linenumber", "discounted")))


@query("columns_exist", f"""
SELECT 'l_quantity' AS "column", true AS column_exists, count(l_quantity) AS n_values FROM ({LINES_SQL})
UNION ALL SELECT 'l_returnflag', true, count(l_returnflag) FROM ({LINES_SQL})
UNION ALL SELECT 'no_such_column', false, 0""")
def columns_exist(spark, d):
    return sel.column_report(lines(spark, d), ["l_quantity", "l_returnflag", "no_such_column"])


@query("feature_target_check", """
SELECT true AS valid, 'Feature-target split is valid (' || count(*) || ' samples, 3 features)' AS message FROM lineitem
UNION ALL SELECT false, 'Target ''l_tax'' is still in feature matrix'""")
def feature_target_check(spark, d):
    df = table(spark, d, "lineitem")
    good = sel.feature_target_check(df, ["l_quantity", "l_discount", "l_extendedprice"], "l_tax")
    return good.unionByName(sel.feature_target_check(df, ["l_quantity", "l_tax"], "l_tax"))


@query("validate_table", """
SELECT 'lineitem' AS table_name, count(*) >= 10 AS valid,
       'DataFrame is valid (' || count(*) || ' rows, 11 columns)' AS message FROM lineitem
UNION ALL SELECT 'region', count(*) >= 10, 'Too few rows: ' || count(*) || ' (minimum: 10)' FROM region
UNION ALL SELECT 'narrow', count(*) < 10, 'Too few columns: 1 (minimum: 2)' FROM orders
UNION ALL SELECT 'all_null', count(empty) > 0, 'Columns are entirely null: empty'
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey < 0 THEN o_totalprice END AS empty FROM orders)
UNION ALL SELECT 'text_only', count(*) < 10,
  'No numeric columns found. Dataset must have at least one numeric feature.' FROM customer
UNION ALL SELECT 'constant', count(DISTINCT one) > 1 OR count(DISTINCT two) > 1, 'All columns contain only one unique value'
  FROM (SELECT 1 AS one, 'x' AS two FROM customer)""")
def validate_table(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    cases = {
        "lineitem": table(spark, d, "lineitem"), "region": table(spark, d, "region"),
        "narrow": o.select("o_orderkey"),
        "all_null": o.selectExpr("o_orderkey", "CASE WHEN o_orderkey < 0 THEN o_totalprice END AS empty"),
        "text_only": c.select("c_name", "c_mktsegment"), "constant": c.selectExpr("1 AS one", "'x' AS two"),
    }
    return reduce(DataFrame.unionByName, [
        q.validate_table(df).select(F.lit(n).alias("table_name"), "valid", "message") for n, df in cases.items()])


@query("validate_target", f"""
WITH v AS (
  SELECT 'returnflag' AS target, l_returnflag AS y FROM lineitem
  UNION ALL SELECT 'totalprice', CAST(o_totalprice AS STRING) FROM ({ORDERS_SQL})
  UNION ALL SELECT 'one', '1' FROM orders
  UNION ALL SELECT 'acctbal', CAST(c_acctbal AS STRING) FROM customer),
c AS (SELECT target, y, count(*) AS cnt FROM v GROUP BY target, y),
s AS (SELECT target, sum(cnt) AS n, sum(cnt) FILTER (y IS NOT NULL) AS n_present, count(y) AS u,
             min(cnt) FILTER (y IS NOT NULL) AS lo, max(cnt) FILTER (y IS NOT NULL) AS hi, min(y) AS one_value FROM c GROUP BY target),
f AS (SELECT *, CASE WHEN (n - n_present) / n > 0.5 THEN 'Target ''' || target || ''' has too many missing values: '
                     || printf('%.1f', (n - n_present) / n * 100) || '% (max: 50%)'
                 WHEN u = 1 THEN 'Target ''' || target || ''' has only one unique value: ' || one_value
                 WHEN u <= 50 AND lo < 3 THEN 'Target has class with only ' || lo || ' sample(s). Each class needs at least 3 samples for proper train/val/test splitting.' END AS failure FROM s)
SELECT target, failure IS NULL AS valid,
       coalesce(failure, 'Target is valid (' || n || ' samples, ' || u || ' unique values)') AS message,
       CASE WHEN failure IS NULL AND u <= 50 AND hi / n > 0.95 THEN 'Target is highly imbalanced: '
            || printf('%.1f', hi / n * 100) || '% in majority class' ELSE '' END AS warning FROM f""")
def validate_target(spark, d):
    o = orders(spark, d)
    cases = {
        "returnflag": table(spark, d, "lineitem").selectExpr("l_returnflag AS returnflag"),
        "totalprice": o.selectExpr("o_totalprice AS totalprice"), "one": o.selectExpr("1 AS one"),
        "acctbal": table(spark, d, "customer").selectExpr("c_acctbal AS acctbal"),
    }
    return reduce(DataFrame.unionByName, [
        q.validate_target(df, n).select(F.lit(n).alias("target"), "valid", "message", "warning")
        for n, df in cases.items()])


@query("table_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def table_shape(spark, d):
    return q.table_shape(table(spark, d, "lineitem"))


_LINE_NAMES = [e.split(" AS ")[-1] for e in LINES]
_NULL_COLS = _LINE_NAMES
_NULL_ROWS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_missing, (count(*) - count({c})) * 100.0 / count(*) AS pct FROM lines"""
    for c in _NULL_COLS)


@query("null_by_column", f"""
WITH lines AS ({LINES_SQL}), x AS ({_NULL_ROWS})
SELECT "column", n_missing, {r('pct', 'missing_pct')} FROM x""")
def null_by_column(spark, d):
    return rounded(q.nulls_by_column(lines(spark, d).select(_NULL_COLS)))


@query("null_summary", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
                  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders),
s AS (SELECT count(*) AS n, count(*) - count(o_totalprice) AS a, count(*) - count(o_orderpriority) AS b FROM o)
SELECT a + b AS total_nulls, CAST((a > 0) AS BIGINT) + CAST((b > 0) AS BIGINT) AS columns_with_nulls,
       round(greatest(a, b) / n, 6) + 0.0 AS max_null_ratio,
       CASE WHEN a / n > 0.5 THEN 'o_totalprice' ELSE '' END AS columns_above_50pct_null FROM s""")
def null_summary(spark, d):
    df = table(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority")
    return rounded(q.null_summary(df))


@query("missing_severity", f"""
WITH lines AS ({LINES_SQL}), x AS ({_NULL_ROWS})
SELECT "column", n_missing, {r('pct', 'missing_pct')},
       CASE WHEN pct > 30 THEN 'high' WHEN pct > 10 THEN 'medium' ELSE 'low' END AS severity FROM x WHERE pct > 0""")
def missing_severity(spark, d):
    return rounded(q.missing_severity(lines(spark, d).select(_NULL_COLS)))


@query("dtype_summary", """
SELECT 'bigint' AS dtype, CAST(3 AS BIGINT) AS n_columns, count(l_orderkey) + count(l_partkey) + count(l_suppkey) AS n_values FROM lineitem
UNION ALL SELECT 'int', 1, count(l_linenumber) FROM lineitem
UNION ALL SELECT 'double', 4, count(l_quantity) + count(l_extendedprice) + count(l_discount) + count(l_tax) FROM lineitem
UNION ALL SELECT 'string', 2, count(l_returnflag) + count(l_linestatus) FROM lineitem
UNION ALL SELECT 'timestamp_ntz', 1, count(l_shipdate) FROM lineitem""")
def dtype_summary(spark, d):
    return q.dtype_summary(table(spark, d, "lineitem"))


@query("duplicate_rows", f"""
WITH t AS ({LINES_SQL}), u AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE l_orderkey % 10 = 0)
SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS c FROM u GROUP BY {", ".join(_LINE_NAMES)})""")
def duplicate_rows(spark, d):
    """Whole order lines, a tenth of the orders twice."""
    df = lines(spark, d)
    return q.duplicate_rows(df.unionByName(df.where("l_orderkey % 10 = 0")))


@query("constant_columns", f"""
SELECT 'one' AS "column", count(one) AS n_values FROM ({LINES_SQL}) HAVING count(DISTINCT one) = 1
UNION ALL SELECT 'l_linestatus', count(l_linestatus) FROM ({LINES_SQL}) HAVING count(DISTINCT l_linestatus) = 1
UNION ALL SELECT 'l_quantity', count(l_quantity) FROM ({LINES_SQL}) HAVING count(DISTINCT l_quantity) = 1""")
def constant_columns(spark, d):
    return q.constant_columns(lines(spark, d))


def _distinct_rows(cols: list[str], src: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, count(*) AS n_rows FROM {src}""" for c in cols)


@query("high_cardinality_columns", f"""
SELECT "column", n_unique FROM ({_distinct_rows([
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate"], "lineitem")}) WHERE n_unique > 0.9 * n_rows
UNION ALL
SELECT "column", n_unique FROM ({_distinct_rows(["doc_id", "text", "lang", "source", "n_chars"], "documents")}) WHERE n_unique > 0.9 * n_rows""")
def high_cardinality_columns(spark, d):
    return q.high_cardinality_columns(table(spark, d, "lineitem")).unionByName(
        q.high_cardinality_columns(table(spark, d, "documents")))


@query("target_preview", f"""
WITH lines AS ({LINES_SQL}),
s AS (SELECT count(DISTINCT l_quantity) AS u, count(*) - count(l_quantity) AS m, count(*) AS n FROM lines)
SELECT CAST(l_quantity AS STRING) AS value, count(*) AS cnt, (SELECT u FROM s) AS n_unique, (SELECT m FROM s) AS n_missing,
       round((SELECT u / n FROM s), 6) + 0.0 AS unique_ratio, 'double' AS dtype
FROM lines WHERE l_quantity IS NOT NULL GROUP BY l_quantity ORDER BY cnt DESC, value LIMIT 10""")
def target_preview(spark, d):
    return rounded(q.target_preview(lines(spark, d), "l_quantity"))


@query("validation_report", f"""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM ({ORDERS_SQL})),
s AS (SELECT count(*) AS n, count(*) - count(o_totalprice) AS a, count(DISTINCT o_orderstatus) AS u,
             count(DISTINCT o_orderkey) AS k, count(DISTINCT o_custkey) AS c, count(DISTINCT o_totalprice) AS p FROM o)
SELECT 'table' AS "check", 'pass' AS status, 'DataFrame is valid (' || n || ' rows, 5 columns)' AS message, CAST(NULL AS DOUBLE) AS value FROM s
UNION ALL SELECT 'target', 'pass', 'Target is valid (' || n || ' samples, ' || u || ' unique values)', NULL FROM s
UNION ALL SELECT 'n_rows', 'info', '', n FROM s UNION ALL SELECT 'n_columns', 'info', '', 5
UNION ALL SELECT 'total_nulls', 'info', '', a FROM s UNION ALL SELECT 'columns_with_nulls', 'info', '', CAST(a > 0 AS INT) FROM s
UNION ALL SELECT 'max_null_ratio', 'info', '', round(a / n, 6) + 0.0 FROM s
UNION ALL SELECT 'constant_columns', 'info', '', 0 UNION ALL
SELECT 'high_cardinality_columns', 'info', 'o_orderkey', 1 FROM s WHERE k > 0.9 * n AND c <= 0.9 * n AND p <= 0.9 * n
UNION ALL SELECT 'duplicate_rows', 'info', '', 0""")
def validation_report(spark, d):
    return rounded(q.validation_report(orders(spark, d), "o_orderstatus"))


_TARGETS = [  # (table, column, kind)
    ("orders", "o_orderstatus", "text"), ("lineitem", "l_linestatus", "text"), ("labels", "quality", "int"),
    ("embeddings", "label", "int"), ("lineitem", "l_quantity", "float"), ("part", "p_size", "int"),
    ("lineitem", "l_extendedprice", "float"), ("events", "value", "float"), ("part", "p_retailprice", "float"),
    ("orders", "o_custkey", "int"), ("orders", "o_orderkey", "int"),
]
_DTYPES = {"o_custkey": "bigint", "o_orderkey": "bigint", "quality": "int", "label": "int", "p_size": "int"}


def _target_profile_sql() -> str:
    rows = []
    for tbl, c, kind in _TARGETS:
        zero_one = f"bool_and({c} IN (0, 1))" if kind != "text" else "false"
        dtype = {"text": "string", "float": "double"}.get(kind) or _DTYPES[c]
        rows.append(f"""SELECT '{c}' AS "column", '{kind}' AS kind, '{dtype}' AS dtype, count(*) AS n, count({c}) AS total,
            count(DISTINCT {c}) AS u, {zero_one} AS zero_one FROM {tbl}""")
    return " UNION ALL ".join(rows)


_RULES_SQL = f"""
p AS (SELECT *, u / total AS ratio FROM ({_target_profile_sql()})),
rules AS (
  SELECT "column", 'data_type' AS rule, 'classification' AS task, 0.95::DOUBLE AS confidence FROM p WHERE kind = 'text'
  UNION ALL SELECT "column", 'binary', 'classification', CASE WHEN zero_one THEN 0.99 ELSE 0.90 END FROM p WHERE zero_one OR u = 2
  UNION ALL SELECT "column", 'unique_count', CASE WHEN u <= 20 THEN 'classification' ELSE 'regression' END,
    CASE WHEN u <= 10 AND total > 20 AND ratio < 0.3 THEN 0.95 WHEN u <= 20 THEN 0.80 ELSE 0.75 END FROM p
  UNION ALL SELECT "column", 'unique_ratio', CASE WHEN ratio < 0.05 THEN 'classification' ELSE 'regression' END,
    CASE WHEN ratio < 0.05 THEN 0.85 ELSE 0.80 END FROM p WHERE ratio < 0.05 OR ratio > 0.5
  UNION ALL SELECT "column", 'integer_pattern', 'classification', 0.70 FROM p WHERE kind = 'int' AND u < 20
  UNION ALL SELECT "column", 'continuous', 'regression', CASE WHEN ratio > 0.8 THEN 0.95 ELSE 0.90 END FROM p
    WHERE kind IN ('int', 'float') AND (ratio > 0.8 OR (kind = 'int' AND ratio > 0.5))),
v AS (SELECT "column", sum(CASE WHEN task = 'classification' THEN confidence ELSE 0 END) AS c,
             sum(CASE WHEN task = 'regression' THEN confidence ELSE 0 END) AS g,
             avg(confidence) FILTER (task = 'classification') AS ca, avg(confidence) FILTER (task = 'regression') AS ga
      FROM rules GROUP BY "column"),
verdict AS (SELECT "column", CASE WHEN c > g THEN 'classification' ELSE 'regression' END AS task,
                   CASE WHEN c > g THEN ca ELSE ga END AS confidence FROM v)"""


def _over_targets(spark, d, fn) -> DataFrame:
    by_table: dict[str, list[str]] = {}
    for tbl, c, _ in _TARGETS:
        by_table.setdefault(tbl, []).append(c)
    return reduce(DataFrame.unionByName, [fn(table(spark, d, tbl), cols) for tbl, cols in by_table.items()])


@query("detect_rules", f'WITH {_RULES_SQL} SELECT "column", rule, task, round(confidence, 6) AS confidence FROM rules')
def detect_rules(spark, d):
    return rounded(_over_targets(spark, d, t.detect_rules))


@query("detect_task", f"""WITH {_RULES_SQL}
SELECT "column", task, round(confidence, 6) AS confidence, confidence < 0.70 AS needs_review FROM verdict""")
def detect_task(spark, d):
    return rounded(_over_targets(spark, d, t.detect_task))


@query("detect_details", f"""WITH {_RULES_SQL}
SELECT "column", task, round(confidence, 6) AS confidence, n AS n_samples, u AS n_unique, round(ratio, 6) AS unique_ratio,
       dtype, n - total AS null_count, round((n - total) / n, 6) + 0.0 AS null_ratio FROM verdict JOIN p USING ("column")""")
def detect_details(spark, d):
    return rounded(_over_targets(spark, d, t.detect_details))


@query("sample_values", """
SELECT CAST(o_orderstatus AS STRING) AS sample_value FROM orders WHERE o_orderstatus IS NOT NULL ORDER BY o_orderkey LIMIT 10""")
def sample_values(spark, d):
    return t.sample_values(table(spark, d, "orders"), "o_orderstatus", 10, ["o_orderkey"])


@query("validation_report_empty", """
WITH o AS (SELECT * FROM orders WHERE o_orderkey < 0), n AS (SELECT count(*) AS n FROM o)
SELECT 'table' AS "check", 'fail' AS status, 'DataFrame is empty (no data)' AS message, CAST(NULL AS DOUBLE) AS value FROM n
UNION ALL SELECT 'target', 'fail', 'Target ''o_orderstatus'' is empty', NULL FROM n
UNION ALL SELECT 'n_rows', 'info', '', n FROM n UNION ALL SELECT 'n_columns', 'info', '', 6
UNION ALL SELECT 'total_nulls', 'info', '', n FROM n UNION ALL SELECT 'columns_with_nulls', 'info', '', n FROM n
UNION ALL SELECT 'max_null_ratio', 'info', '', NULL UNION ALL SELECT 'constant_columns', 'info', '', 0
UNION ALL SELECT 'high_cardinality_columns', 'info', '', 0 UNION ALL SELECT 'duplicate_rows', 'info', '', 0""")
def validation_report_empty(spark, d):
    return rounded(q.validation_report(table(spark, d, "orders").where("o_orderkey < 0"), "o_orderstatus"))


@query("detect_task_override", f"""WITH {_RULES_SQL}
SELECT "column", 'regression' AS task, 1.0::DOUBLE AS confidence, false AS needs_review FROM verdict""")
def detect_task_override(spark, d):
    """The user's word against every rule."""
    return rounded(_over_targets(spark, d, lambda df, names: t.detect_task(df, names, "regression")))
