"""Encoding, imputation, scaling, splits and folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabspark.config import EngineConfig
from tabspark.operators import encode as e, preprocess as p, split as sp
from tabspark.suite.registry import LINES_SQL, PARTS_SQL, lines, parts, query, r, rounded, table

_LINE_PARTS_SQL = f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount,
  l_returnflag, l_linestatus, p_brand, p_name, p_type, pricey FROM ({LINES_SQL}) JOIN ({PARTS_SQL}) ON l_partkey = p_partkey"""
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def line_parts(spark, d) -> DataFrame:
    """Order lines with the attributes of their part."""
    return (lines(spark, d).join(parts(spark, d), F.col("l_partkey") == F.col("p_partkey"))
            .select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_quantity",
                    "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "p_brand", "p_name", "p_type", "pricey"))


def _roles_sql(name: str, numeric: list[str], text: list[str], dropped: list[str], src: str) -> str:
    rows = [f"""SELECT '{name}' AS table_name, '{c}' AS "column", 'numeric' AS role, CAST(NULL AS BIGINT) AS n_unique""" for c in numeric]
    rows += [f"SELECT '{name}', '{c}', 'dropped', NULL" for c in dropped]
    rows += [f"""SELECT '{name}', '{c}', CASE WHEN count(*) > 50 AND count(DISTINCT {c}) / count(*) > 0.95 THEN 'id'
        WHEN count(DISTINCT {c}) <= 15 THEN 'one_hot' ELSE 'frequency' END, count(DISTINCT {c}) FROM {src}""" for c in text]
    return " UNION ALL ".join(rows)


_ROLES_SQL = " UNION ALL ".join([
    _roles_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"], [], "customer"),
    _roles_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type", "pricey"], [], f"({PARTS_SQL})"),
    _roles_sql("documents", ["doc_id", "n_chars"], ["text", "lang", "source"], [], "documents"),
    _roles_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                            "l_discount", "l_tax", "one"], ["l_returnflag", "l_linestatus", "discounted"], ["l_shipdate"],
               f"({LINES_SQL})"),
])


def _role_tables(spark, d) -> dict[str, DataFrame]:
    return {"customer": table(spark, d, "customer"), "part": parts(spark, d),
            "documents": table(spark, d, "documents"), "lineitem": lines(spark, d)}


@query("feature_roles", _ROLES_SQL)
def feature_roles(spark, d):
    return reduce(DataFrame.unionByName, [
        p.feature_roles(df).select(F.lit(n).alias("table_name"), "column", "role", "n_unique")
        for n, df in _role_tables(spark, d).items()])


@query("feature_role_counts", f"""
SELECT table_name, role, count(*) AS n_columns, string_agg("column", ',' ORDER BY "column") AS columns
FROM ({_ROLES_SQL}) GROUP BY table_name, role""")
def feature_role_counts(spark, d):
    return reduce(DataFrame.unionByName, [
        p.role_counts(df).select(F.lit(n).alias("table_name"), "role", "n_columns", "columns")
        for n, df in _role_tables(spark, d).items()])


@query("freq_fit", f"""
WITH t AS ({_LINE_PARTS_SQL})
SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS cnt, {r("count(*) / (SELECT count(p_brand) FROM t)", "frequency")}
FROM t WHERE p_brand IS NOT NULL GROUP BY p_brand
UNION ALL SELECT 'p_name', p_name, count(*), {r("count(*) / (SELECT count(p_name) FROM t)", "frequency")}
FROM t WHERE p_name IS NOT NULL GROUP BY p_name""")
def freq_fit(spark, d):
    return rounded(e.frequencies(line_parts(spark, d), ["p_brand", "p_name"]))


_FREQ_SQL = f"""
WITH t AS ({_LINE_PARTS_SQL}),
b AS (SELECT p_brand, count(*) / (SELECT count(p_brand) FROM t) AS f FROM t WHERE p_brand IS NOT NULL GROUP BY 1),
n AS (SELECT p_name, count(*) / (SELECT count(p_name) FROM t) AS f FROM t WHERE p_name IS NOT NULL GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, {r("coalesce(b.f, 0)", "p_brand")}, {r("coalesce(n.f, 0)", "p_name")}
FROM t LEFT JOIN b ON t.p_brand = b.p_brand LEFT JOIN n ON t.p_name = n.p_name"""


@query("freq_encode", _FREQ_SQL)
def freq_encode(spark, d):
    df = line_parts(spark, d).select(*_KEYS, "p_brand", "p_name")
    return rounded(e.FrequencyEncoder(inputCols=["p_brand", "p_name"]).fit(df).transform(df))


@query("freq_encode_shuffled", _FREQ_SQL)
def freq_encode_shuffled(spark, d):
    """The same through the joins for categories too many to broadcast."""
    df = line_parts(spark, d).select(*_KEYS, "p_brand", "p_name")
    model = e.FrequencyEncoder(inputCols=["p_brand", "p_name"]).fit(df)
    return rounded(model._set(broadcastRows=0).transform(df))


@query("impute_median", f"""
WITH t AS ({LINES_SQL})
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice,
       coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)) AS l_quantity FROM t""")
def impute_median(spark, d):
    df = lines(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rounded(e.impute_median(df, ["l_quantity"]))


@query("impute_constant", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, coalesce(l_returnflag, 'missing') AS l_returnflag FROM ({LINES_SQL})""")
def impute_constant(spark, d):
    return rounded(e.impute_constant(lines(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_returnflag"]))


@query("standard_scale", f"""
WITH t AS ({LINES_SQL}),
s AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS em, stddev_pop(l_extendedprice) AS es,
             avg(one) AS om FROM t)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {r("(l_quantity - qm) / qs", "l_quantity", 5)},
       {r("(l_extendedprice - em) / es", "l_extendedprice", 5)}, {r("one - om", "one")} FROM t, s""")
def standard_scale(spark, d):
    df = lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "one")
    return rounded(e.standard_scale(df, ["l_quantity", "l_extendedprice", "one"]), {"l_quantity": 5, "l_extendedprice": 5})


# Part types of the standard tables, in order.
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_BRANDLESS = ["A", "N", "R", "missing"]


@query("one_hot", f"""
SELECT l_orderkey, l_linenumber, {', '.join(f'CAST(p_type = {chr(39)}{v}{chr(39)} AS DOUBLE) AS "p_type_{v}"' for v in _TYPES)}
FROM ({_LINE_PARTS_SQL})""")
def one_hot(spark, d):
    return rounded(e.one_hot(line_parts(spark, d), "p_type", keep=["l_orderkey", "l_linenumber"]))


@query("one_hot_unseen", f"""
SELECT l_orderkey, l_linenumber, {', '.join(f'CAST(p_type = {chr(39)}{v}{chr(39)} AS DOUBLE) AS "p_type_{v}"' for v in _TYPES[1:])}
FROM ({_LINE_PARTS_SQL})""")
def one_hot_unseen(spark, d):
    """Fitted without the first type, applied to all rows: its rows get zeros only."""
    df = line_parts(spark, d)
    first = df.agg(F.min("p_type")).scalar()
    known = e.categories(df.filter(F.col("p_type") != first), ["p_type"])["p_type"]
    return rounded(e.one_hot(df, "p_type", known, keep=["l_orderkey", "l_linenumber"]))


def _onehot_sql(name: str, values: list[str], text: str) -> str:
    return ", ".join(f"""CAST({text} = '{v}' AS DOUBLE) AS "{name}_{v}" """ for v in values)


_WIDE_SQL = f"""
WITH t AS ({_LINE_PARTS_SQL}), n AS (SELECT count(*) AS n FROM t),
q AS (SELECT *, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM t)) AS qi,
             coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM t)) AS di FROM t),
b AS (SELECT p_brand, count(*) / (SELECT count(p_brand) FROM t) AS bf FROM t WHERE p_brand IS NOT NULL GROUP BY 1),
m AS (SELECT p_name, count(*) / (SELECT count(p_name) FROM t) AS mf FROM t WHERE p_name IS NOT NULL GROUP BY 1),
j AS (SELECT q.*, coalesce(bf, 0) AS bf, coalesce(mf, 0) AS mf FROM q LEFT JOIN b ON q.p_brand = b.p_brand LEFT JOIN m ON q.p_name = m.p_name),
s AS (SELECT avg(qi) AS qm, stddev_pop(qi) AS qs, avg(di) AS dm, stddev_pop(di) AS ds, avg(bf) AS bm, stddev_pop(bf) AS bs,
             avg(mf) AS mm, stddev_pop(mf) AS ms FROM j)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, {r("(qi - qm) / qs", "l_quantity", 5)}, {r("(di - dm) / ds", "l_discount", 5)},
  {r("(bf - BM) / bs", "p_brand", 5)}, {r("(mf - mm) / ms", "p_name", 5)},
  {_onehot_sql("l_returnflag", _BRANDLESS, "coalesce(l_returnflag, 'missing')")}, {_onehot_sql("l_linestatus", ["F", "O"], "l_linestatus")},
  {_onehot_sql("p_type", _TYPES, "p_type")},
  {_onehot_sql("pricey", ["False", "True"], "CASE WHEN pricey THEN 'True' ELSE 'False' END")} FROM j, s"""
_WIDE_FEATURES = ["l_quantity", "l_discount", "p_brand", "p_name", "l_returnflag", "l_linestatus", "p_type", "pricey"]


@query("preprocess_wide", _WIDE_SQL)
def preprocess_wide(spark, d):
    """Fit and transform on all rows: numbers, then frequencies, then one-hot blocks."""
    df = line_parts(spark, d)
    model = p.TablePreprocessor(featureCols=_WIDE_FEATURES).fit(df)
    return rounded(model.wide(df, _KEYS), {c: 5 for c in ("l_quantity", "l_discount", "p_brand", "p_name")})


@query("feature_names", f"""
WITH t AS ({_LINE_PARTS_SQL}), c AS (
  SELECT * FROM (VALUES (0, 'l_quantity', ''), (1, 'l_discount', ''), (2, 'p_brand', ''), (3, 'p_name', '')) AS v(block, feature, value)
  UNION ALL SELECT DISTINCT 4, 'l_returnflag_' || coalesce(l_returnflag, 'missing'), coalesce(l_returnflag, 'missing') FROM t
  UNION ALL SELECT DISTINCT 5, 'l_linestatus_' || l_linestatus, l_linestatus FROM t
  UNION ALL SELECT DISTINCT 6, 'p_type_' || p_type, p_type FROM t
  UNION ALL SELECT DISTINCT 7, 'pricey_' || CASE WHEN pricey THEN 'True' ELSE 'False' END, CASE WHEN pricey THEN 'True' ELSE 'False' END FROM t)
SELECT row_number() OVER (ORDER BY block, value) - 1 AS position, feature FROM c""")
def feature_names(spark, d):
    """(position, feature) in vector order."""
    model = p.TablePreprocessor(featureCols=_WIDE_FEATURES).fit(line_parts(spark, d))
    return spark.createDataFrame(list(enumerate(model.feature_names())), "position long, feature string")


def _split_cte(tbl: str, key: str, target: str | None, out: str = "parts", cols: str = "*") -> str:
    """The split as window functions: test and validation quotas in hash order."""
    part = f"PARTITION BY {target} " if target else ""
    return f"""{out}_n AS (SELECT {cols}, row_number() OVER ({part}ORDER BY md5('42|' || {key}), CAST({key} AS STRING)) AS rn,
  count(*) OVER ({part.strip()}) AS n FROM {tbl}),
{out}_q AS (SELECT *, CAST(ceil(0.2::DOUBLE * n) AS BIGINT) AS nt FROM {out}_n),
{out} AS (SELECT *, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + ceil(0.2::DOUBLE * (n - nt)) THEN 'val' ELSE 'train' END AS split FROM {out}_q)"""


@query("split_random", f"WITH {_split_cte('orders', 'o_orderkey', None)} SELECT o_orderkey, split FROM parts")
def split_random(spark, d):
    return sp.split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("split_stratified", f"WITH {_split_cte('orders', 'o_orderkey', 'o_orderstatus')} SELECT o_orderkey, o_orderstatus, split FROM parts")
def split_stratified(spark, d):
    return sp.split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query("stratify_decision", """
SELECT 'o_orderstatus' AS target, min(c) >= 2 AND count(*) <= 50 AS stratify, count(*) AS n_classes, min(c) AS min_class
FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus)
UNION ALL SELECT 'o_custkey', min(c) >= 2 AND count(*) <= 50, count(*), min(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey)
UNION ALL SELECT 'l_quantity', min(c) >= 2 AND count(*) <= 50, count(*), min(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity)""")
def stratify_decision(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return reduce(DataFrame.unionByName, [
        sp.stratify_decision(df, c).select(F.lit(c).alias("target"), "stratify", "n_classes", "min_class")
        for df, c in ((o, "o_orderstatus"), (o, "o_custkey"), (li, "l_quantity"))])


@query("split_stratified_counted", f"WITH {_split_cte('orders', 'o_orderkey', 'o_orderstatus')} SELECT o_orderkey, o_orderstatus, split FROM parts")
def split_stratified_counted(spark, d):
    """The same with every quota searched down to single positions."""
    return sp.split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus",
                    config=EngineConfig(rank_bucket_rows=1))


@query("split_info_clf", f"""
WITH {_split_cte('orders', 'o_orderkey', 'o_orderstatus')}
SELECT split, o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS split_n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) + 0.0 AS class_share FROM parts GROUP BY split, o_orderstatus""")
def split_info_clf(spark, d):
    return rounded(sp.split_info_classes(split_stratified(spark, d), "o_orderstatus"))


@query("split_info_reg", f"""
WITH {_split_cte('orders', 'o_orderkey', None)}
SELECT split, count(*) AS n, {r("avg(o_totalprice)", "target_mean", 4)}, {r("stddev_samp(o_totalprice)", "target_std", 4)},
       {r("count(*) * 100.0 / (SELECT count(*) FROM orders)", "pct")}, CAST(3 AS BIGINT) AS n_features FROM parts GROUP BY split""")
def split_info_reg(spark, d):
    df = sp.split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", "regression")
    return rounded(sp.split_info(df, 3, "o_totalprice"), {"target_mean": 4, "target_std": 4})


@query("split_class_dist", f"""
WITH {_split_cte('labels', 'doc_id', 'toxic')}
SELECT split, CAST(toxic AS BIGINT) AS toxic, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) + 0.0 AS class_share
FROM parts GROUP BY split, toxic""")
def split_class_dist(spark, d):
    df = sp.split(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "toxic")
    return rounded(sp.split_info_classes(df, "toxic").select("split", "toxic", "class_share"))


@query("cv_folds", """
SELECT o_orderkey, o_orderstatus, ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey),
       CAST(o_orderkey AS STRING)) - 1 AS fold FROM orders""")
def cv_folds(spark, d):
    return rounded(sp.assign_folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus"))


_FIT_FEATURES = ["o_totalprice", "o_custkey", "o_orderpriority", "c_name", "c_mktsegment", "c_acctbal"]
# Order priorities of the standard tables, in order.
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("preprocess_fit_transform", f"""
WITH oc AS (SELECT o_orderkey, o_orderstatus, o_custkey, o_orderpriority, c_name, c_mktsegment, c_acctbal,
              CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
{_split_cte('oc', 'o_orderkey', 'o_orderstatus')},
tr AS (SELECT * FROM parts WHERE split = 'train'),
med AS (SELECT quantile_cont(o_totalprice, 0.5) AS mp FROM tr),
f AS (SELECT c_name, count(*) / (SELECT count(c_name) FROM tr) AS f FROM tr GROUP BY 1),
j AS (SELECT parts.*, coalesce(parts.o_totalprice, mp) AS tp, coalesce(f, 0) AS cf FROM parts LEFT JOIN f ON parts.c_name = f.c_name, med),
s AS (SELECT avg(tp) AS tm, stddev_pop(tp) AS ts, avg(o_custkey) AS km, stddev_pop(o_custkey) AS ks, avg(c_acctbal) AS am,
             stddev_pop(c_acctbal) AS sa, avg(cf) AS cm, stddev_pop(cf) AS cs FROM j WHERE split = 'train')
SELECT o_orderkey, split, {r("(tp - tm) / ts", "o_totalprice", 5)}, {r("(o_custkey - km) / ks", "o_custkey", 5)},
  {r("(c_acctbal - am) / sa", "c_acctbal", 5)}, {r("(cf - cm) / cs", "c_name", 5)},
  {_onehot_sql("o_orderpriority", _PRIORITIES, "o_orderpriority")}, {_onehot_sql("c_mktsegment", _SEGMENTS, "c_mktsegment")} FROM j, s""")
def preprocess_fit_transform(spark, d):
    """Fitted on the train rows of a stratified split, applied to all rows."""
    from tabspark.suite.registry import orders
    df = (orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
          .select("o_orderkey", "o_orderstatus", *_FIT_FEATURES))
    rows = sp.split(df, "o_orderkey", "o_orderstatus")
    model = p.TablePreprocessor(featureCols=_FIT_FEATURES).fit(rows.filter(F.col("split") == "train"))
    return rounded(model.wide(rows, ["o_orderkey", "split"]),
                   {c: 5 for c in ("o_totalprice", "o_custkey", "c_acctbal", "c_name")})
