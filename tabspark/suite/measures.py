"""Metrics, model comparison and exploratory aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabspark.operators import eda, information, metrics as m, split as sp
from tabspark.plans import training as tr
from tabspark.suite.features import _split_cte
from tabspark.suite.registry import (
    LINES_SQL, PARTS_SQL, derived, lines, parts, query, r, rounded, table,
)

# Fixed rules stand in for models, so that every metric has an exact answer.
# The texts are valid in Spark SQL and in DuckDB.
_TWO = ["l_orderkey", "CASE WHEN l_quantity > 25 AND l_discount < 0.06 THEN 1 ELSE 0 END AS label",
        "CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS prediction", "floor(l_quantity / 3) AS score"]
_THREE = ["CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END AS label",
          "CASE WHEN l_extendedprice < 20000 THEN 0 WHEN l_quantity < 30 THEN 1 WHEN l_quantity < 49 THEN 2 ELSE 3 END AS prediction",
          "50 - l_quantity AS s0", "l_extendedprice AS s1", "floor(l_quantity / 5) + l_discount AS s2"]
_REG = ["l_orderkey", "l_extendedprice AS y", "l_quantity * 1500 + l_discount * 1000 AS yhat"]


def _sql(exprs: list[str]) -> str:
    return f"SELECT {', '.join(exprs)} FROM lineitem"


_TWO_SQL, _THREE_SQL, _REG_SQL = _sql(_TWO), _sql(_THREE), _sql(_REG)


def _two(spark, d):
    return derived(spark, d, "lineitem", _TWO)


def _three(spark, d):
    return derived(spark, d, "lineitem", _THREE)


def _reg(spark, d):
    return derived(spark, d, "lineitem", _REG)


@query("metric_accuracy", f"SELECT {r('avg(CAST(label = prediction AS INT))', 'accuracy')} FROM ({_TWO_SQL})")
def metric_accuracy(spark, d):
    return rounded(m.accuracy(_two(spark, d), "label", "prediction"))


_PER_CLASS = """
c AS (SELECT label, prediction, count(*) AS n FROM t GROUP BY 1, 2),
k AS (SELECT DISTINCT unnest([label, prediction]) AS class FROM c),
p AS (SELECT class, coalesce((SELECT sum(n) FROM c WHERE label = class AND prediction = class), 0) AS tp,
             coalesce((SELECT sum(n) FROM c WHERE label = class), 0) AS support,
             coalesce((SELECT sum(n) FROM c WHERE prediction = class), 0) AS predicted FROM k),
pc AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
              CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f1, support, tp FROM p)"""


@query("metric_prf_binary", f"""
WITH t AS ({_TWO_SQL}), {_PER_CLASS}
SELECT {r('(SELECT sum(tp) / sum(support) FROM pc)', 'accuracy')}, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}
FROM pc WHERE class = 1""")
def metric_prf_binary(spark, d):
    return rounded(m.precision_recall_f1(_two(spark, d), "label", "prediction"))


@query("metric_prf_weighted", f"""
WITH t AS ({_THREE_SQL}), {_PER_CLASS}
SELECT {r('sum(tp) / sum(support)', 'accuracy')}, {r('sum(precision * support) / sum(support)', 'precision')},
       {r('sum(recall * support) / sum(support)', 'recall')}, {r('sum(f1 * support) / sum(support)', 'f1')} FROM pc""")
def metric_prf_weighted(spark, d):
    return rounded(m.precision_recall_f1(_three(spark, d), "label", "prediction"))


@query("confusion_matrix", f"""
WITH t AS ({_THREE_SQL}), k AS (SELECT DISTINCT unnest([label, prediction]) AS class FROM t)
SELECT CAST(a.class AS BIGINT) AS label, CAST(b.class AS BIGINT) AS prediction,
       (SELECT count(*) FROM t WHERE label = a.class AND prediction = b.class) AS n FROM k a, k b""")
def confusion_matrix(spark, d):
    return rounded(m.confusion_matrix(_three(spark, d), "label", "prediction"))


@query("class_report", f"""
WITH t AS ({_THREE_SQL}), {_PER_CLASS},
s AS (SELECT sum(tp) / sum(support) AS a, CAST(sum(support) AS BIGINT) AS n, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
  sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM pc)
SELECT CAST(class AS STRING) AS class, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', {r('a', 'x')}, {r('a', 'y')}, {r('a', 'z')}, n FROM s
UNION ALL SELECT 'macro avg', {r('mp', 'x')}, {r('mr', 'y')}, {r('mf', 'z')}, n FROM s
UNION ALL SELECT 'weighted avg', {r('wp', 'x')}, {r('wr', 'y')}, {r('wf', 'z')}, n FROM s""")
def class_report(spark, d):
    return rounded(m.class_report(_three(spark, d), "label", "prediction"))


def _auc_sql(src: str, positive: str, score: str) -> str:
    return f"""SELECT (sum(CASE WHEN p THEN rk END) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2)
      / (count(*) FILTER (p) * count(*) FILTER (NOT p)) AS auc, count(*) FILTER (p) AS pos
    FROM (SELECT {positive} AS p, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS rk FROM {src})"""


@query("metric_auc", f"WITH t AS ({_TWO_SQL}), a AS ({_auc_sql('t', 'label = 1', 'score')}) SELECT {r('auc', 'auc')} FROM a")
def metric_auc(spark, d):
    df = _two(spark, d).select((F.col("label") == 1).alias("p"), "score")
    return rounded(m.auc(df, "p", "score"))


@query("metric_auc_ovr", f"""
WITH t AS ({_THREE_SQL}), a AS ({_auc_sql('t', 'label = 0', 's0')} UNION ALL {_auc_sql('t', 'label = 1', 's1')}
  UNION ALL {_auc_sql('t', 'label = 2', 's2')})
SELECT {r('sum(auc * pos) / sum(pos)', 'auc')} FROM a""")
def metric_auc_ovr(spark, d):
    return rounded(m.auc_one_vs_rest(_three(spark, d), "label", {0: "s0", 1: "s1", 2: "s2"}))


@query("metric_regression", f"""
WITH t AS ({_REG_SQL}), e AS (SELECT avg((y - yhat) ** 2) AS mse, avg(abs(y - yhat)) AS mae, var_pop(y) AS vy FROM t)
SELECT {r('mse', 'mse', 1)}, {r('sqrt(mse)', 'rmse', 4)}, {r('mae', 'mae', 4)}, {r('1 - mse / vy', 'r2')} FROM e""")
def metric_regression(spark, d):
    row = m.regression_metrics(_reg(spark, d), "y", "yhat").select("mse", "rmse", "mae", "r2")
    return rounded(row, {"mse": 1, "rmse": 4, "mae": 4})


@query("metric_mape", f"""
SELECT CASE WHEN count(*) FILTER (y = 0) = 0 THEN round(avg(abs(y - yhat) / abs(y)), 6) + 0.0 END AS mape FROM ({_REG_SQL})""")
def metric_mape(spark, d):
    return rounded(m.regression_metrics(_reg(spark, d), "y", "yhat").select("mape"))


@query("metric_explained_variance", f"SELECT {r('1 - var_pop(y - yhat) / var_pop(y)', 'explained_variance')} FROM ({_REG_SQL})")
def metric_explained_variance(spark, d):
    return rounded(m.regression_metrics(_reg(spark, d), "y", "yhat").select("explained_variance"))


@query("residuals", f"SELECT l_orderkey, {r('y - yhat', 'residual')} FROM ({_REG_SQL})")
def residuals(spark, d):
    return rounded(m.residuals(_reg(spark, d), "y", "yhat").select("l_orderkey", "residual"))


@query("residual_summary", f"""
WITH e AS (SELECT y - yhat AS e FROM ({_REG_SQL}))
SELECT {r('avg(e)', 'mean', 4)}, {r('stddev_pop(e)', 'std', 4)}, {r('quantile_cont(e, 0.5)', 'median', 4)},
       {r('min(e)', 'min', 4)}, {r('max(e)', 'max', 4)} FROM e""")
def residual_summary(spark, d):
    return rounded(m.residual_summary(_reg(spark, d), "y", "yhat"), {c: 4 for c in ("mean", "std", "median", "min", "max")})


# Comparison of rule "models" on a stratified split of labelled documents.
_RULES = {"longer than 200": "n_chars > 200", "longer than 1000": "n_chars > 1000",
          "english": "lang = 'en'", "english or long": "lang = 'en' OR n_chars > 3000"}
_DOCS_SQL = "SELECT doc_id, quality, n_chars, lang FROM labels JOIN documents USING (doc_id)"


def _rule_scores_sql(extra: str = "") -> str:
    """Per rule and part: accuracy, precision, recall and f1 of class 1."""
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS model, split, quality AS y, CASE WHEN {c} THEN 1 ELSE 0 END AS p{extra} FROM parts" for n, c in _RULES.items())
    return f"""docs AS ({_DOCS_SQL}), {_split_cte('docs', 'doc_id', 'quality')}, s AS ({rows}),
k AS (SELECT model, split, count(*) AS n, count(*) FILTER (y = p) AS hit, count(*) FILTER (y = 1 AND p = 1) AS tp,
             count(*) FILTER (p = 1) AS pp, count(*) FILTER (y = 1) AS yp FROM s GROUP BY 1, 2),
g AS (SELECT model, split, hit / n AS accuracy, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS precision,
             CASE WHEN yp = 0 THEN 0 ELSE tp / yp END AS recall, CASE WHEN pp + yp = 0 THEN 0 ELSE 2 * tp / (pp + yp) END AS f1 FROM k),
cmp AS (SELECT v.model, t.accuracy AS ta, v.accuracy AS va, v.precision AS vp, v.recall AS vr, v.f1 AS vf
        FROM (SELECT * FROM g WHERE split = 'train') t JOIN (SELECT * FROM g WHERE split = 'val') v ON t.model = v.model)"""


def _rule_docs(spark, d) -> DataFrame:
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return sp.split(df.select("doc_id", "quality", "n_chars", "lang"), "doc_id", "quality")


def _rule_results(spark, d) -> dict:
    rows, out = _rule_docs(spark, d), {}
    for name, rule in _RULES.items():
        scored = rows.select("split", F.col("quality").alias(tr.LABEL),
                             F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END").alias("prediction"))
        part = lambda s: tr.classification_scores(scored.filter(F.col("split") == s), 2, with_auc=False)
        out[name] = tr.FitResult(name, "classification", None, {}, 0.0, 0, 2, part("train"), part("val"))
    return out


_CMP = f"""model, {r('ta', 'train_accuracy')}, {r('va', 'val_accuracy')}, {r('vp', 'val_precision')}, {r('vr', 'val_recall')}, {r('vf', 'val_f1')}"""
_CMP_COLS = ["model", "train_accuracy", "val_accuracy", "val_precision", "val_recall", "val_f1"]


@query("compare_models", f"WITH {_rule_scores_sql()} SELECT {_CMP} FROM cmp ORDER BY va DESC, model")
def compare_models(spark, d):
    return rounded(tr.comparison(spark, _rule_results(spark, d), "classification").select(_CMP_COLS))


@query("best_model_penalised", f"""
WITH {_rule_scores_sql()}, b AS (SELECT *, vf * (1 - 0.3::DOUBLE * abs(ta - va)) AS score FROM cmp ORDER BY score DESC, model LIMIT 1)
SELECT model, {r('vf', 'val_f1')}, {r('score', 'score')} FROM b""")
def best_model_penalised(spark, d):
    table_ = tr.comparison(spark, _rule_results(spark, d), "classification")
    return rounded(tr.best_by_penalty(table_, "classification", "val_f1").select("model", "val_f1", "score").limit(1))


@query("metrics_long", f"""
WITH {_rule_scores_sql()}, c AS (SELECT {_CMP} FROM cmp)
SELECT model, 'val_accuracy' AS metric, val_accuracy AS value FROM c UNION ALL SELECT model, 'val_precision', val_precision FROM c
UNION ALL SELECT model, 'val_recall', val_recall FROM c UNION ALL SELECT model, 'val_f1', val_f1 FROM c""")
def metrics_long(spark, d):
    return m.metrics_long(compare_models(spark, d), "model", ["val_accuracy", "val_precision", "val_recall", "val_f1"])


@query("compare_tuned", f"""
WITH {_rule_scores_sql(', doc_id')},
f AS (SELECT model, y, p, ntile(5) OVER (PARTITION BY model, y ORDER BY md5('42|' || doc_id), CAST(doc_id AS STRING)) AS fold FROM s WHERE split = 'train'),
cv AS (SELECT model, avg(a) AS cv FROM (SELECT model, fold, avg(CAST(y = p AS INT)) AS a FROM f GROUP BY 1, 2) GROUP BY 1)
SELECT model, {r('cv', 'best_cv_score')}, {r('va', 'val_score')}, CAST(0 AS BIGINT) AS iterations, {r('vp', 'val_precision')},
       {r('vr', 'val_recall')}, {r('vf', 'val_f1')} FROM cmp JOIN cv USING (model)""")
def compare_tuned(spark, d):
    """Rules ranked by validation accuracy beside their mean accuracy over the folds of the train rows."""
    results = _rule_results(spark, d)
    train = _rule_docs(spark, d).filter(F.col("split") == "train")
    folds = sp.assign_folds(train, "doc_id", "quality")
    hits = folds.groupBy("fold").agg(*[
        F.avg((F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END") == F.col("quality")).cast("double")).alias(f"a{i}")
        for i, rule in enumerate(_RULES.values())])
    means = hits.agg(*[F.avg(f"a{i}") for i in range(len(_RULES))]).first()
    tuned = {n: tr.TuneResult(n, "classification", None, {}, means[i], res.val["accuracy"], 0.0, 0, res.val)
             for i, (n, res) in enumerate(results.items())}
    return rounded(tr.tuning_comparison(spark, tuned, "classification").drop("tuning_time_s"))


_HIST = ["l_quantity", "l_extendedprice", "l_discount"]


def _histogram_sql(cols: list[str], src: str, bins: int) -> str:
    long = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS x FROM {src} WHERE {c} IS NOT NULL""" for c in cols)
    return f"""long AS ({long}),
rg AS (SELECT "column", CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi, count(*) AS n FROM long GROUP BY 1),
cnt AS (SELECT "column", least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin, count(*) AS c
        FROM long JOIN rg USING ("column") GROUP BY 1, 2),
h AS (SELECT rg."column", b.bin, lo, hi, n, coalesce(c, 0) AS c, (hi - lo) / {bins} AS w
      FROM rg CROSS JOIN (SELECT unnest(range({bins})) AS bin) b LEFT JOIN cnt ON cnt."column" = rg."column" AND cnt.bin = b.bin)"""


@query("histogram_30", f"""
WITH t AS ({LINES_SQL}), {_histogram_sql(_HIST, 't', 30)}
SELECT "column", bin, {r('lo + bin * w', 'bin_start')}, {r('lo + (bin + 1) * w', 'bin_end')}, c AS n, {r('c / (n * w)', 'density')} FROM h""")
def histogram_30(spark, d):
    return rounded(eda.histogram(lines(spark, d), _HIST, 30))


@query("target_histogram", f"""
WITH {_histogram_sql(['value'], 'events', 50)}
SELECT bin, {r('lo + bin * w', 'bin_start')}, {r('lo + (bin + 1) * w', 'bin_end')}, c AS n, {r('c / (n * w)', 'density')} FROM h""")
def target_histogram(spark, d):
    return rounded(eda.target_histogram(table(spark, d, "events"), "value", 50))


@query("kde", f"""
WITH s AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * count(*) ** -0.2 AS h FROM events),
c AS (SELECT least(CAST(floor((value - lo) / (hi - lo) * 2048) AS BIGINT), 2047) AS cell, count(*) AS w, avg(value) AS m FROM events, s GROUP BY 1),
g AS (SELECT p AS point, lo - (hi - lo) / 2 + p * (2 * (hi - lo) / 999) AS x FROM s, (SELECT unnest(range(1000)) AS p))
SELECT point, {r('x', 'x', 5)}, {r('(SELECT sum(w * exp(-0.5 * ((x - m) / h) ** 2)) FROM c) / (n * h * sqrt(2 * pi()))', 'density', 8)} FROM g, s""")
def kde(spark, d):
    return rounded(eda.kde(table(spark, d, "events"), "value"), {"x": 5, "density": 8})


@query("center_stats", f"""
WITH t AS ({LINES_SQL})
SELECT 'l_quantity' AS "column", {r('avg(l_quantity)', 'mean', 4)}, {r('quantile_cont(l_quantity, 0.5)', 'median', 4)} FROM t
UNION ALL SELECT 'l_extendedprice', {r('avg(l_extendedprice)', 'x', 4)}, {r('quantile_cont(l_extendedprice, 0.5)', 'y', 4)} FROM t
UNION ALL SELECT 'l_discount', {r('avg(l_discount)', 'x', 4)}, {r('quantile_cont(l_discount, 0.5)', 'y', 4)} FROM t""")
def center_stats(spark, d):
    return rounded(eda.center_stats(lines(spark, d), _HIST), {"mean": 4, "median": 4})


def _top_sql(c: str, src: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST({c} AS STRING) AS value, count(*) AS cnt,
      row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS STRING)) AS rank, least(10, count(*) OVER ()) AS n_shown,
      count(*) OVER () AS n_categories FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}"""


@query("top_categories", f"""
WITH t AS ({PARTS_SQL})
SELECT "column", value, cnt, rank, CAST(n_shown AS BIGINT) AS n_shown, n_categories FROM ({_top_sql('p_brand', 't')} UNION ALL
  {_top_sql('p_name', 't')} UNION ALL {_top_sql('p_type', 't')} UNION ALL {_top_sql('props', 'events')}) WHERE rank <= 10""")
def top_categories(spark, d):
    return eda.top_categories(parts(spark, d), ["p_brand", "p_name", "p_type"]).unionByName(
        eda.top_categories(table(spark, d, "events"), ["props"]))


def _iqr_sql(c: str, src: str) -> str:
    return f"""SELECT '{c}' AS "column", (SELECT count(*) FROM {src}, q WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))
      * 100.0 / (SELECT count(*) FROM {src}) AS pct FROM (SELECT 1)""".replace("q WHERE", f"""
      (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}) WHERE""")


@query("iqr_outliers", f"""
WITH x AS ({_iqr_sql('value', 'events')} UNION ALL {_iqr_sql('n_chars', 'documents')} UNION ALL {_iqr_sql('doc_id', 'documents')})
SELECT "column", {r('pct', 'outlier_pct')}, CASE WHEN pct > 10 THEN 'high' WHEN pct > 5 THEN 'medium' ELSE 'low' END AS severity FROM x WHERE pct > 0""")
def iqr_outliers(spark, d):
    return rounded(eda.iqr_outliers(table(spark, d, "events"), ["value"]).unionByName(
        eda.iqr_outliers(table(spark, d, "documents"), ["n_chars", "doc_id"])))


_CORR = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DERIVED_CORR = ["l_quantity AS q", "l_extendedprice AS e", "l_quantity * 2 + l_discount * 10 AS q2", "l_extendedprice - l_quantity * 900 AS e2",
                 "l_discount AS d", "l_tax + l_discount AS td"]
_DC = ["q", "e", "q2", "e2", "d", "td"]


def _pairs_sql(cols: list[str], src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM {src}"
                              for i, a in enumerate(cols) for b in cols[i + 1:])


@query("corr_matrix", f"""
WITH t AS ({LINES_SQL}), p AS ({_pairs_sql(_CORR, 't')})
SELECT column_a, column_b, {r('r', 'r')} FROM p UNION ALL SELECT column_b, column_a, {r('r', 'r')} FROM p
UNION ALL SELECT c, c, 1.0 FROM (SELECT unnest([{', '.join(f"'{c}'" for c in _CORR)}]) AS c)""")
def corr_matrix(spark, d):
    return rounded(eda.correlation_matrix(lines(spark, d), _CORR))


@query("corr_top_pairs", f"""
WITH t AS ({_sql(_DERIVED_CORR)}), p AS ({_pairs_sql(_DC, 't')})
SELECT column_a, column_b, {r('r', 'r', 4)}, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS band
FROM p ORDER BY round(abs(r), 10) DESC, column_a, column_b LIMIT 20""")
def corr_top_pairs(spark, d):
    return rounded(eda.top_correlated(derived(spark, d, "lineitem", _DERIVED_CORR), _DC))


@query("multicollinear", f"""
WITH t AS ({_sql(_DERIVED_CORR)}), p AS (SELECT abs(round(r, 4)) AS s FROM ({_pairs_sql(_DC, 't')}))
SELECT count(*) FILTER (s >= 0.85) AS n_multicollinear, count(*) FILTER (s >= 0.7) AS n_strong,
       count(*) FILTER (s >= 0.4 AND s < 0.7) AS n_moderate, count(*) FILTER (s < 0.4) AS n_weak FROM p""")
def multicollinear(spark, d):
    return eda.multicollinear(derived(spark, d, "lineitem", _DERIVED_CORR), _DC)


# twenty columns, most of them with missing values
_WIDE = [f"CASE WHEN (l_orderkey + l_linenumber * {i + 3}) % {i + 4} = 0 THEN NULL ELSE {c} * {1 + i % 3} + {d} * l_linenumber END AS w{i}"
         for i, (c, d) in enumerate((c, d) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for d in (0, 1, 2, 5, 9))]
_WIDE_SQL = f"SELECT {', '.join(_WIDE)} FROM lineitem"


@query("corr_matrix_wide", f"""
WITH t AS ({_WIDE_SQL}), p AS ({_pairs_sql([f'w{i}' for i in range(20)], 't')})
SELECT column_a, column_b, {r('r', 'r', 5)} FROM p UNION ALL SELECT column_b, column_a, {r('r', 'r', 5)} FROM p
UNION ALL SELECT c, c, 1.0 FROM (SELECT unnest([{', '.join(f"'w{i}'" for i in range(20))}]) AS c)""")
def corr_matrix_wide(spark, d):
    """190 pairs, each over the rows where both are present: one scan."""
    return rounded(eda.correlation_matrix(derived(spark, d, "lineitem", _WIDE)), 5)


@query("class_distribution", f"""
WITH t AS ({LINES_SQL})
SELECT l_returnflag AS class, count(*) AS n, {r('count(*) * 100.0 / (SELECT count(l_returnflag) FROM t)', 'pct')}
FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def class_distribution(spark, d):
    return rounded(eda.class_distribution(lines(spark, d), "l_returnflag"))


@query("class_statistics", f"""
WITH t AS ({LINES_SQL}), c AS (SELECT l_returnflag AS v, count(*) AS n FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1), a AS (SELECT count(*) AS n FROM t)
SELECT (SELECT n FROM a) AS n_rows, count(*) AS n_classes, (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS majority_class,
       {r('max(n) * 100.0 / (SELECT n FROM a)', 'majority_pct')}, {r('min(n) * 100.0 / (SELECT n FROM a)', 'minority_pct')},
       {r('max(n) / min(n)', 'balance_ratio')} FROM c""")
def class_statistics(spark, d):
    return rounded(eda.class_statistics(lines(spark, d), "l_returnflag"))


def _mi_sql(c: str) -> str:
    edges = " + ".join(f"CAST(x > (SELECT quantile_cont(x, {i / 10}) FROM f_{c}) AS INT)" for i in range(1, 10))
    return f"""f_{c} AS (SELECT coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM t)) AS x, l_returnflag AS y FROM t WHERE l_returnflag IS NOT NULL),
j_{c} AS (SELECT b, y, count(*) AS n FROM (SELECT {edges} AS b, y FROM f_{c}) GROUP BY 1, 2),
m_{c} AS (SELECT '{c}' AS "column", sum(n / tot * ln(n * tot / (nb * ny))) AS mi FROM (
  SELECT n, sum(n) OVER () AS tot, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny FROM j_{c}))"""


_MI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("mutual_information", f"""
WITH t AS ({LINES_SQL}), {', '.join(_mi_sql(c) for c in _MI)}
SELECT "column", {r('mi', 'mi', 8)} FROM ({' UNION ALL '.join(f'SELECT * FROM m_{c}' for c in _MI)}) ORDER BY mi DESC""")
def mutual_information(spark, d):
    return rounded(eda.mutual_information(lines(spark, d), _MI, "l_returnflag"), {"mi": 8})


_NEAR_MI = ["p_retailprice", "p_size", "p_partkey"]


def _near_mi_sql() -> str:
    """The estimator over all pairs of rows; digamma of a whole number is a sum of reciprocals."""
    parts = []
    for c in _NEAR_MI:
        parts.append(f"""
f_{c} AS (SELECT row_number() OVER () AS id, p_type AS c, CAST(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM t)) AS DOUBLE) AS x FROM t WHERE p_type IS NOT NULL),
g_{c} AS (SELECT c, count(*) AS nc FROM f_{c} GROUP BY c HAVING count(*) > 1),
r_{c} AS (SELECT a.id, any_value(a.x) AS x, any_value(g.nc) AS nc, list_sort(list(abs(a.x - b.x)))[CAST(least(3, any_value(g.nc) - 1) + 1 AS BIGINT)] AS r
         FROM f_{c} a JOIN g_{c} g ON a.c = g.c JOIN f_{c} b ON a.c = b.c GROUP BY a.id),
m_{c} AS (SELECT r.id, any_value(r.nc) AS nc, count(*) AS m FROM r_{c} r JOIN (SELECT x FROM f_{c} WHERE c IN (SELECT c FROM g_{c})) b
         ON abs(b.x - r.x) < r.r OR b.x = r.x GROUP BY r.id),
i_{c} AS (SELECT '{c}' AS "column", greatest(0.0, (SELECT psi FROM h WHERE i = (SELECT sum(nc) FROM g_{c})) + avg(k.psi) - avg(n.psi) - avg(q.psi)) AS mi
         FROM m_{c} m JOIN h k ON k.i = least(3, m.nc - 1) JOIN h n ON n.i = m.nc JOIN h q ON q.i = m.m)""")
    return f"""WITH t AS ({PARTS_SQL}),
h AS (SELECT i, -0.5772156649015329 + coalesce(sum(1.0::DOUBLE / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS psi
      FROM (SELECT unnest(range(1, (SELECT count(*) + 2 FROM t))) AS i)),{', '.join(parts)}
SELECT "column", {r('mi', 'mi', 8)} FROM ({' UNION ALL '.join(f'SELECT * FROM i_{c}' for c in _NEAR_MI)}) ORDER BY mi DESC"""


@query("mutual_information_knn", _near_mi_sql())
def mutual_information_knn(spark, d):
    return rounded(information.mutual_information_knn(parts(spark, d), _NEAR_MI, "p_type"), {"mi": 8})


@query("target_statistics", f"""
SELECT count(value) AS count, {r('avg(value)', 'mean', 5)}, {r('quantile_cont(value, 0.5)', 'median')}, {r('stddev_samp(value)', 'std', 5)},
  {r('min(value)', 'min')}, {r('quantile_cont(value, 0.25)', 'q25')}, {r('quantile_cont(value, 0.75)', 'q75')}, {r('max(value)', 'max')},
  {r('skewness(value)', 'skewness')}, {r('kurtosis(value)', 'kurtosis')} FROM events""")
def target_statistics(spark, d):
    return rounded(eda.target_statistics(table(spark, d, "events"), "value"), {"mean": 5, "std": 5})


@query("target_correlation", f"""
WITH t AS ({LINES_SQL})
SELECT "column", {r('abs_r', 'abs_r')} FROM ({' UNION ALL '.join(
    f'''SELECT '{c}' AS "column", abs(corr({c}, l_extendedprice)) AS abs_r FROM t''' for c in _CORR if c != 'l_extendedprice')})
ORDER BY round(abs_r, 10) DESC, "column" LIMIT 10""")
def target_correlation(spark, d):
    cols = [c for c in _CORR if c != "l_extendedprice"]
    return rounded(eda.target_correlation(lines(spark, d), cols, "l_extendedprice"))


_REPORT_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "one"]
_REPORT_TEXTS = ["l_returnflag", "l_linestatus", "discounted"]
_REPORT_COLUMNS = [*_REPORT_NUMBERS, *_REPORT_TEXTS, "l_shipdate"]


def _report_sql() -> str:
    """Row counts of the sections, from the columns, the rows and the classes."""
    def section(task: str, name: str, n: str) -> str:
        return f"SELECT '{task}' AS task, '{name}' AS section, CAST({n} AS BIGINT) AS n_rows"

    def total(parts: list[str]) -> str:
        return "(SELECT " + " + ".join(parts) + " FROM t)"

    parts = []
    for task, target in (("classification", "l_returnflag"), ("regression", "l_extendedprice")):
        numbers = [c for c in _REPORT_NUMBERS if c != target]
        texts = [c for c in _REPORT_TEXTS if c != target]
        columns = [c for c in _REPORT_COLUMNS if c != target]
        some = [f"CASE WHEN count({c}) > 0 THEN 1 ELSE 0 END" for c in numbers]
        varied = total([f"CASE WHEN var_pop({c}) > 0 THEN 1 ELSE 0 END" for c in numbers])
        reach = lambda c: f"1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
        far = [f"CASE WHEN max({c}) > quantile_cont({c}, 0.75) + {reach(c)} OR min({c}) < quantile_cont({c}, 0.25) - {reach(c)} THEN 1 ELSE 0 END"
               for c in numbers]
        parts += [
            section(task, "missing", str(len(columns))),
            section(task, "missing_severity", total([f"CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END" for c in columns])),
            section(task, "histograms", f"30 * {total(some)}"), section(task, "centers", str(len(numbers))),
            section(task, "outliers", total(far)), section(task, "correlation", str(len(numbers) ** 2)),
            section(task, "top_pairs", f"least(20, {varied} * ({varied} - 1) // 2)"),
            section(task, "top_categories", total([f"least(10, count(DISTINCT {c}))" for c in texts]))]
        if task == "classification":
            parts += [section(task, "class_distribution", f"(SELECT count(DISTINCT {target}) FROM t)"),
                      section(task, "class_statistics", "1"), section(task, "mutual_information", f"least(10, {len(numbers)})")]
        else:
            parts += [section(task, "target_histogram", "50"), section(task, "target_statistics", "1"),
                      section(task, "target_density", f"(SELECT CASE WHEN count({target}) > 10 AND var_pop({target}) > 0 THEN 1000 ELSE 0 END FROM t)"),
                      section(task, "target_correlation", f"least(10, {varied})")]
    return f"WITH t AS ({LINES_SQL}) " + " UNION ALL ".join(parts)


@query("eda_report", _report_sql())
def eda_report(spark, d):
    """Row counts of every exploratory table of whole order lines, for a target of either kind."""
    df = lines(spark, d)
    parts = []
    for target, task in (("l_returnflag", "classification"), ("l_extendedprice", "regression")):
        for name, found in eda.profile(df, target, task).items():
            parts.append(found.agg(F.lit(task).alias("task"), F.lit(name).alias("section"), F.count(F.lit(1)).alias("n_rows")))
    return reduce(DataFrame.unionByName, parts)
