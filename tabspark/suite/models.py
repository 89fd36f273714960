"""Sources and sinks, nearest neighbours, model fits, tuning, scoring and whole runs."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tabspark.config import EngineConfig
from tabspark.operators import knn, metrics as m, split as sp
from tabspark.plans import training as tr
from tabspark.plans.catalog import get_spec
from tabspark.plans.scoring import prediction_summary, score
from tabspark.plans.workflow import TabularWorkflow
from tabspark.session import scratch_path
from tabspark.sources import packages, tables
from tabspark.streaming.scoring import score_stream
from tabspark.suite.features import _split_cte
from tabspark.suite.registry import PARTS_SQL, derived, parts, query, r, rounded, table

# ---- sources ----------------------------------------------------------------

_TEXTS = {
    "orderkey": "CAST(l_orderkey AS STRING)", "quantity": "CAST(l_quantity AS STRING)", "flag": "l_returnflag",
    "line": "CASE WHEN l_linenumber = 1 THEN 'NA' ELSE CAST(l_linenumber AS STRING) END",
    "cheap": "CASE WHEN l_discount > 0.05 THEN 'True' WHEN l_discount > 0.02 THEN 'FALSE' ELSE 'null' END",
    "nothing": "CASE WHEN l_tax > 0.04 THEN 'n/a' ELSE '' END",
    "mixed": "CASE WHEN l_linenumber = 2 THEN 'x' ELSE '3' END",
}
_NA_SQL = ", ".join(f"'{t}'" for t in tables.NA_TOKENS)


def _infer_sql() -> str:
    cells = ", ".join(f"CASE WHEN ({e}) NOT IN ({_NA_SQL}) THEN {e} END AS {n}" for n, e in _TEXTS.items())
    rows = " UNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'double'
      WHEN count(*) FILTER ({c} IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')) = count({c}) THEN 'boolean'
      WHEN count(*) FILTER (regexp_full_match({c}, '[+-]?[0-9]+') AND TRY_CAST({c} AS BIGINT) IS NOT NULL) = count({c}) THEN 'bigint'
      WHEN count(*) FILTER (TRY_CAST({c} AS DOUBLE) IS NOT NULL) = count({c}) THEN 'double' ELSE 'string' END AS inferred_type,
      count(*) - count({c}) AS n_missing FROM t""" for c in _TEXTS)
    return f"WITH t AS (SELECT {cells} FROM lineitem) {rows}"


@query("infer_schema", _infer_sql())
def infer_schema(spark, d):
    return tables.infer_types(derived(spark, d, "lineitem", [f"{e} AS {n}" for n, e in _TEXTS.items()]))


@query("csv_scan", f"""
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice, pricey FROM ({PARTS_SQL})""")
def csv_scan(spark, d):
    """Written as CSV, then read back with encoding detection and type inference."""
    path = scratch_path(spark, "csv")
    packages.write_predictions(parts(spark, d), path)
    return rounded(tables.read_csv(spark, path))


@query("load_table", "SELECT * FROM orders")
def load_table(spark, d):
    return tables.load_table(spark, f"{d}/orders.parquet")


# ---- nearest neighbours -----------------------------------------------------

_NEAR_SQL = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
dist AS (SELECT a.vec_id AS probe_id, b.vec_id AS neighbor_id, b.label,
  list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM e a, e b),
near AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(d, 12), neighbor_id) AS rank FROM dist QUALIFY rank <= 5)"""


@query("knn_join", f"WITH {_NEAR_SQL} SELECT probe_id, neighbor_id, rank, {r('sqrt(d)', 'distance')} FROM near")
def knn_join(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(knn.knn_join(e, e, "vec_id", "vec_id", "embedding", 5))


@query("knn_classify", f"""
WITH {_NEAR_SQL}, votes AS (SELECT probe_id, label, count(*) AS v FROM near GROUP BY 1, 2)
SELECT probe_id, CAST(arg_min(label, -v * 1000000 + label) AS BIGINT) AS prediction, CAST(max(v) AS DOUBLE) AS votes FROM votes GROUP BY 1""")
def knn_classify(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(knn.knn_classify(e, e, "vec_id", "vec_id", "embedding", "label", 5))


@query("knn_regress", f"WITH {_NEAR_SQL} SELECT probe_id, {r('avg(label)', 'prediction')} FROM near GROUP BY 1")
def knn_regress(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(knn.knn_regress(e, e, "vec_id", "vec_id", "embedding", "label", 5))


# ---- models with a closed form ----------------------------------------------

_CLASS3 = "CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END"
_CLASS2 = "CASE WHEN l_quantity > 25 AND l_discount < 0.06 THEN 1 ELSE 0 END"
_SIGNAL = "3.0 * l_quantity - 200.0 * l_discount + 0.01 * l_extendedprice"
_X3 = ["l_quantity", "l_discount", "l_extendedprice"]


def _vectors(df: DataFrame, features: list[str], label: str) -> DataFrame:
    rows = df.withColumn(tr.LABEL, F.expr(label).cast("double"))
    return VectorAssembler(inputCols=features, outputCol=tr.FEATURES).transform(rows)


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", *_X3)


def _coefficients(model, names: list[str], df: DataFrame) -> DataFrame:
    rows = [*zip(names, map(float, model.coefficients)), ("(intercept)", float(model.intercept))]
    return df.sparkSession.createDataFrame(rows, "feature string, value double")


def _linear(spark, d, name: str, features: list[str], label: str, params: dict | None = None) -> DataFrame:
    rows = _vectors(_lines(spark, d), features, label)
    model = get_spec(name, "regression").estimator(params, tr.train_stats(rows, "regression")).fit(rows)
    return rounded(_coefficients(model, features, rows), 3)


@query("reg_linear_simple", f"""
SELECT {r('regr_slope(y, l_quantity)', 'slope')}, {r('regr_intercept(y, l_quantity)', 'intercept', 4)}
FROM (SELECT *, {_SIGNAL} AS y FROM lineitem)""")
def reg_linear_simple(spark, d):
    df = _lines(spark, d).withColumn("y", F.expr(_SIGNAL))
    return rounded(df.agg(F.regr_slope("y", "l_quantity").alias("slope"),
                          F.regr_intercept("y", "l_quantity").alias("intercept")), {"intercept": 4})


def _two_feature_sql(y: str, alpha: float) -> str:
    """Normal equations of two centred features with an L2 penalty."""
    return f"""
WITH t AS (SELECT l_quantity AS a, l_discount AS b, {y} AS y FROM lineitem),
s AS (SELECT count(*) * var_pop(a) + {alpha} AS aa, count(*) * var_pop(b) + {alpha} AS bb, count(*) * covar_pop(a, b) AS ab,
             count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t),
k AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb, ma, mb, my FROM s)
SELECT 'l_quantity' AS feature, {r('ca', 'value', 3)} FROM k UNION ALL SELECT 'l_discount', {r('cb', 'x', 3)} FROM k
UNION ALL SELECT '(intercept)', {r('my - ca * ma - cb * mb', 'x', 3)} FROM k"""


@query("reg_linear", _two_feature_sql("l_extendedprice", 0.0))
def reg_linear(spark, d):
    return _linear(spark, d, "Linear Regression", ["l_quantity", "l_discount"], "l_extendedprice")


@query("reg_ridge", _two_feature_sql("l_extendedprice", 1.0))
def reg_ridge(spark, d):
    return _linear(spark, d, "Ridge", ["l_quantity", "l_discount"], "l_extendedprice")


def _one_feature_sql(alpha: float, ratio: float) -> str:
    """Soft-thresholded covariance over the penalised variance."""
    return f"""
WITH t AS (SELECT l_quantity AS x, {_SIGNAL} AS y FROM lineitem),
s AS (SELECT covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM t),
k AS (SELECT sign(c) * greatest(abs(c) - {alpha * ratio}, 0) / (v + {alpha * (1 - ratio)}) AS b, mx, my FROM s)
SELECT 'l_quantity' AS feature, {r('b', 'value', 3)} FROM k UNION ALL SELECT '(intercept)', {r('my - b * mx', 'x', 3)} FROM k"""


@query("reg_lasso", _one_feature_sql(1.0, 1.0))
def reg_lasso(spark, d):
    return _linear(spark, d, "Lasso", ["l_quantity"], _SIGNAL)


@query("reg_elastic_net", _one_feature_sql(1.0, 0.5))
def reg_elastic_net(spark, d):
    return _linear(spark, d, "Elastic Net", ["l_quantity"], _SIGNAL)


def _bayes_sql() -> str:
    stats = ", ".join(f"avg({x}) AS m{i}, var_pop({x}) AS v{i}" for i, x in enumerate(_X3))
    like = " + ".join(f"(-0.5 * ln(2 * pi() * (v{i} + eps)) - ({x} - m{i}) ** 2 / (2 * (v{i} + eps)))" for i, x in enumerate(_X3))
    return f"""t AS (SELECT l_orderkey, {', '.join(_X3)}, {_CLASS3} AS label FROM lineitem),
g AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({x})' for x in _X3)}) AS eps FROM t),
c AS (SELECT label AS class, count(*) / (SELECT count(*) FROM t) AS prior, {stats} FROM t GROUP BY label),
id AS (SELECT *, row_number() OVER () AS row FROM t),
ll AS (SELECT row, l_orderkey, {', '.join(_X3)}, label, class, ln(prior) + {like} AS ll FROM id, c, g),
nb AS (SELECT row, any_value(l_orderkey) AS l_orderkey, {', '.join(f'any_value({x}) AS {x}' for x in _X3)}, any_value(label) AS label,
         arg_max(class, ll) AS prediction, max(ll) AS top, sum(exp(ll)) AS total,
         {', '.join(f'max(exp(ll)) FILTER (class = {i}) AS e{i}' for i in range(3))} FROM ll GROUP BY row)"""


def _bayes(spark, d):
    rows = _vectors(_lines(spark, d), _X3, _CLASS3)
    return get_spec("Naive Bayes", "classification").estimator(None, tr.train_stats(rows, "classification")).fit(rows), rows


def _bayes_package(spark, d) -> packages.ModelPackage:
    model, rows = _bayes(spark, d)
    labels = ["0", "1", "2"]
    stages = [VectorAssembler(inputCols=_X3, outputCol=tr.FEATURES), model,
              IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels)]
    return packages.ModelPackage(PipelineModel(stages), "Naive Bayes", "classification", "label", list(_X3), labels,
                                 rows.count(), "trained")


@query("clf_naive_bayes", f"WITH {_bayes_sql()} SELECT CAST(label AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction, count(*) AS n FROM nb GROUP BY 1, 2")
def clf_naive_bayes(spark, d):
    model, rows = _bayes(spark, d)
    scored = model.transform(rows)
    return m.confusion(scored, "label", "prediction").select(
        F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("prediction"), "n")


# ---- scoring ----------------------------------------------------------------

_SCORED = f"l_orderkey, {', '.join(_X3)}, CAST(prediction AS STRING) AS \"Prediction\""


@query("score_batch", f"WITH {_bayes_sql()} SELECT {_SCORED} FROM nb")
def score_batch(spark, d):
    """The target column in the input is ignored; the others come back unchanged."""
    rows = _lines(spark, d).withColumn("label", F.expr(_CLASS3))
    return rounded(score(_bayes_package(spark, d), rows, probabilities=False))


@query("score_proba", f"""WITH {_bayes_sql()}
SELECT {_SCORED}, {', '.join(r(f'e{i} / total', f'Probability_Class_{i}') for i in range(3))} FROM nb""")
def score_proba(spark, d):
    return rounded(score(_bayes_package(spark, d), _lines(spark, d)))


@query("write_predictions", f"WITH {_bayes_sql()} SELECT {_SCORED} FROM nb")
def write_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    packages.write_predictions(score(_bayes_package(spark, d), _lines(spark, d), probabilities=False), path)
    back = spark.read.option("header", True).schema(
        "l_orderkey long, l_quantity double, l_discount double, l_extendedprice double, Prediction string").csv(path)
    return rounded(back)


@query("save_package", """
SELECT 'Naive Bayes' AS model_name, 'classification' AS task, 'trained' AS source, CAST(3 AS BIGINT) AS n_features, count(*) AS n_samples FROM lineitem""")
def save_package(spark, d):
    path = packages.save_package(spark, _bayes_package(spark, d), scratch_path(spark, "package"))
    return spark.read.json(f"{path}/metadata").select("model_name", "task", "source", "n_features", "n_samples")


@query("load_package", f"""WITH {_bayes_sql()} SELECT CAST(prediction AS STRING) AS "Prediction", count(*) AS n FROM nb GROUP BY 1""")
def load_package(spark, d):
    path = packages.save_package(spark, _bayes_package(spark, d), scratch_path(spark, "package"))
    return score(packages.load_package(spark, path), _lines(spark, d)).groupBy("Prediction").agg(F.count(F.lit(1)).alias("n"))


@query("score_stream", f"""WITH {_bayes_sql()} SELECT CAST(prediction AS STRING) AS "Prediction", count(*) AS n FROM nb GROUP BY 1""")
def score_stream_query(spark, d):
    rows = (spark.readStream.schema(table(spark, d, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet")
            .parquet(d).select("l_orderkey", *_X3))
    path = scratch_path(spark, "scored")
    running = score_stream(_bayes_package(spark, d), rows, path)
    running.awaitTermination()
    return spark.read.parquet(path).groupBy("Prediction").agg(F.count(F.lit(1)).alias("n"))


@query("prediction_summary", f"""WITH {_bayes_sql()},
k AS (SELECT regr_slope({_SIGNAL}, l_quantity) AS b, regr_intercept({_SIGNAL}, l_quantity) AS a FROM lineitem)
SELECT 'classification' AS task, count(*) AS total, count(DISTINCT prediction) AS n_classes, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std FROM nb
UNION ALL SELECT 'regression', count(*), NULL, {r('avg(a + b * l_quantity)', 'x', 4)}, {r('stddev_pop(a + b * l_quantity)', 'y', 4)} FROM lineitem, k""")
def prediction_summary_query(spark, d):
    rows = _vectors(_lines(spark, d), ["l_quantity"], _SIGNAL)
    model = get_spec("Linear Regression", "regression").estimator(None, tr.train_stats(rows, "regression")).fit(rows)
    numbers = prediction_summary(model.transform(rows), "regression", "prediction")
    classes = prediction_summary(score(_bayes_package(spark, d), _lines(spark, d)), "classification")
    none = F.lit(None)
    return rounded(classes.select(F.lit("classification").alias("task"), "total", "n_classes", none.cast("double").alias("mean"),
                                  none.cast("double").alias("std")).unionByName(
        numbers.select(F.lit("regression").alias("task"), "total", none.cast("long").alias("n_classes"), "mean", "std")),
        {"mean": 4, "std": 4})


# ---- cross-validation -------------------------------------------------------

@query("cv_scores", """
WITH f AS (SELECT CAST(p_partkey AS DOUBLE) AS x, p_retailprice AS y, ntile(5) OVER (ORDER BY md5('42|' || p_partkey), CAST(p_partkey AS STRING)) - 1 AS fold FROM part),
k AS (SELECT i AS fold, regr_slope(y, x) FILTER (f.fold <> i) AS b, regr_intercept(y, x) FILTER (f.fold <> i) AS a
      FROM f, (SELECT unnest(range(5)) AS i) GROUP BY i),
s AS (SELECT fold, sqrt(avg((y - a - b * x) ** 2)) AS rmse FROM f JOIN k USING (fold) GROUP BY fold)
SELECT CAST(fold AS STRING) AS fold, round(rmse, 5) + 0.0 AS rmse FROM s
UNION ALL SELECT 'mean', round(avg(rmse), 5) + 0.0 FROM s UNION ALL SELECT 'std', round(stddev_pop(rmse), 5) + 0.0 FROM s""")
def cv_scores(spark, d):
    rows = sp.assign_folds(_vectors(table(spark, d, "part"), ["p_partkey"], "p_retailprice"), "p_partkey", k=5)
    scores = tr.cross_val_scores("Linear Regression", "regression", rows.select(tr.FEATURES, tr.LABEL, tr.FOLD).persist(), k=5)
    fit = tr.FitResult("", "", None, {}, 0.0, 0, 1, cv_scores=scores)
    out = [(str(i), s) for i, s in enumerate(scores)] + [("mean", fit.cv_mean), ("std", fit.cv_std)]
    return rounded(spark.createDataFrame(out, "fold string, rmse double"), 5)


# ---- fitted models, on tables whose answer SQL knows --------------------------
#
# All models see the whole part table, split by its key. One threshold of p_size
# decides the class and the amount, so a model that learns it makes no error, and
# the linear ones leave what their penalty takes.

_SIDE = "p_size > 25"
_CLASS_TABLE = ["p_partkey", f"CASE WHEN {_SIDE} THEN p_size + 100 ELSE p_size END AS wide", "p_retailprice",
                f"CASE WHEN {_SIDE} THEN 1 ELSE 0 END AS target"]
_AMOUNT_TABLE = ["p_partkey", f"CASE WHEN {_SIDE} THEN 1 ELSE 0 END AS side", f"CASE WHEN {_SIDE} THEN 120.0 ELSE 20.0 END AS target"]
_CLASS_SQL = f"class_rows AS (SELECT {', '.join(_CLASS_TABLE)} FROM part), " + _split_cte("class_rows", "p_partkey", "target")
_AMOUNT_SQL = f"amount_rows AS (SELECT {', '.join(_AMOUNT_TABLE)} FROM part), " + _split_cte("amount_rows", "p_partkey", None)


def _flow(spark, d, exprs: list[str], features: list[str], task: str, config: EngineConfig = EngineConfig(),
          name: str = "part", key: str = "p_partkey") -> TabularWorkflow:
    flow = TabularWorkflow(spark, config)
    flow.load(derived(spark, d, name, exprs))
    flow.select_target("target", key, features)
    flow.detect(task)
    flow.prepare()
    return flow


def _class_flow(spark, d) -> TabularWorkflow:
    return _flow(spark, d, _CLASS_TABLE, ["wide", "p_retailprice"], "classification")


def _amount_flow(spark, d) -> TabularWorkflow:
    return _flow(spark, d, _AMOUNT_TABLE, ["side"], "regression")


def _classified(name: str):
    """Confusion counts of the test rows; default settings."""
    def run(spark, d):
        flow = _class_flow(spark, d)
        flow.train_models([name], run_cv=False)
        cells = m.confusion(flow.trained[name].model.transform(flow.test), tr.LABEL, "prediction")
        out = cells.select(F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("prediction"), "n")
        out = spark.createDataFrame(out.collect(), out.schema)  # classes squared rows at most
        flow.close()
        return out
    return run


for _key, _name in [
    ("clf_random_forest", "Random Forest"), ("clf_gbt", "Gradient Boosting"), ("clf_decision_tree", "Decision Tree"),
    ("clf_linear_svm", "SVM"), ("clf_adaboost", "AdaBoost"),
]:
    query(_key, f"""WITH {_CLASS_SQL}
SELECT CAST(target AS BIGINT) AS label, CAST(target AS BIGINT) AS prediction, count(*) AS n FROM parts WHERE split = 'test' GROUP BY 1, 2""")(
        _classified(_name))


def _estimated(name: str):
    """Amounts and estimates of the test rows; default settings."""
    def run(spark, d):
        flow = _amount_flow(spark, d)
        flow.train_models([name], run_cv=False)
        scored = flow.trained[name].model.transform(flow.test)
        out = scored.groupBy(F.col("label").alias("amount"), (F.round("prediction", 3) + 0.0).alias("estimate")).agg(F.count(F.lit(1)).alias("n"))
        out = spark.createDataFrame(out.collect(), out.schema)  # two amounts
        flow.close()
        return out
    return run


for _key, _name in [("reg_decision_tree", "Decision Tree"), ("reg_random_forest", "Random Forest"),
                    ("reg_gbt", "Gradient Boosting"), ("reg_adaboost", "AdaBoost")]:
    query(_key, f"""WITH {_AMOUNT_SQL}
SELECT CAST(target AS DOUBLE) AS amount, CAST(target AS DOUBLE) AS estimate, count(*) AS n FROM parts WHERE split = 'test' GROUP BY 1, 2""")(
        _estimated(_name))


# three classes by thresholds, boosted together
_CLASS3_TABLE = ["p_partkey", "p_size", "p_retailprice", "CASE WHEN p_size <= 17 THEN 0 WHEN p_size <= 34 THEN 1 ELSE 2 END AS target"]


@query("clf_gbt_multiclass", f"""WITH rows3 AS (SELECT {', '.join(_CLASS3_TABLE)} FROM part), {_split_cte('rows3', 'p_partkey', 'target')}
SELECT CAST(target AS BIGINT) AS label, CAST(target AS BIGINT) AS prediction, count(*) AS n FROM parts WHERE split = 'test' GROUP BY 1, 2""")
def clf_gbt_multiclass(spark, d):
    flow = _flow(spark, d, _CLASS3_TABLE, ["p_size", "p_retailprice"], "classification")
    flow.train_models(["Gradient Boosting"], run_cv=False)
    scored = flow.trained["Gradient Boosting"].model.transform(flow.test)
    out = m.confusion(scored, tr.LABEL, "prediction").select(
        F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("prediction"), "n")
    out = spark.createDataFrame(out.collect(), out.schema)
    flow.close()
    return out


@query("clf_logistic", f"""
WITH l AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS x, CASE WHEN (p_partkey * 7919) % 10 < CASE WHEN p_size > 25 THEN 7 ELSE 3 END THEN 1 ELSE 0 END AS target FROM part),
{_split_cte('l', 'p_partkey', 'target')},
t AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, ln(avg(target) FILTER (x = 1) / (1 - avg(target) FILTER (x = 1))) AS l1,
             ln(avg(target) FILTER (x = 0) / (1 - avg(target) FILTER (x = 0))) AS l0 FROM parts WHERE split = 'train')
SELECT 'x' AS feature, {r('(l1 - l0) * sx', 'value', 2)} FROM t UNION ALL SELECT '(intercept)', {r('l0 + (l1 - l0) * mx', 'value', 2)} FROM t""")
def clf_logistic(spark, d):
    """One 0/1 feature and next to no penalty: the coefficient is the log odds ratio."""
    flow = _flow(spark, d, ["p_partkey", "CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS x",
                            "CASE WHEN (p_partkey * 7919) % 10 < CASE WHEN p_size > 25 THEN 7 ELSE 3 END THEN 1 ELSE 0 END AS target"], ["x"], "classification")
    flow.train_models(["Logistic Regression"], run_cv=False, params={"Logistic Regression": {"C": 1e9}})
    model = flow.trained["Logistic Regression"].model
    flow.close()
    return rounded(_coefficients(model, ["x"], flow.data), 2)


_NEAR_TABLE = ["p_partkey", "sqrt(CAST(p_partkey AS DOUBLE)) AS x", "CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS target"]


def _nearest_sql(target: str | None) -> str:
    return f"""near_rows AS (SELECT {', '.join(_NEAR_TABLE)} FROM part), {_split_cte('near_rows', 'p_partkey', target)},
near AS (SELECT a.p_partkey, any_value(a.target) AS target, list(b.target ORDER BY abs(a.x - b.x))[1:5] AS found
         FROM parts a, parts b WHERE a.split = 'test' AND b.split = 'train' GROUP BY 1)"""


@query("clf_knn", f"""WITH {_nearest_sql('target')}
SELECT CAST(target AS BIGINT) AS label, CAST(CASE WHEN list_sum(found) > 2 THEN 1 ELSE 0 END AS BIGINT) AS prediction, count(*) AS n FROM near GROUP BY 1, 2""")
def clf_knn(spark, d):
    flow = _flow(spark, d, _NEAR_TABLE, ["x"], "classification")
    flow.train_models(["K-Nearest Neighbors"], run_cv=False)
    out = m.confusion(flow.trained["K-Nearest Neighbors"].model.transform(flow.test), tr.LABEL, "prediction").select(
        F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("prediction"), "n")
    out = spark.createDataFrame(out.collect(), out.schema)
    flow.close()
    return out


@query("reg_knn", f"""WITH {_nearest_sql(None)}
SELECT CAST(target AS DOUBLE) AS amount, {r('list_sum(found) / 5.0', 'estimate')}, count(*) AS n FROM near GROUP BY 1, 2""")
def reg_knn(spark, d):
    flow = _flow(spark, d, _NEAR_TABLE, ["x"], "regression")
    flow.train_models(["K-Nearest Neighbors"], run_cv=False)
    scored = flow.trained["K-Nearest Neighbors"].model.transform(flow.test)
    out = scored.groupBy(F.col("label").alias("amount"), (F.round("prediction", 6) + 0.0).alias("estimate")).agg(F.count(F.lit(1)).alias("n"))
    out = spark.createDataFrame(out.collect(), out.schema)
    flow.close()
    return out


@query("feature_importance", f"""
WITH {_AMOUNT_SQL}
SELECT 'Decision Tree' AS model, 'side' AS feature, 1.0::DOUBLE AS importance
UNION ALL SELECT 'Linear Regression', 'side', {r("100 * stddev_pop(side)", 'x', 4)} FROM parts WHERE split = 'train'""")
def feature_importance(spark, d):
    """Importance of a tree's only feature beside the coefficient of the scaled one."""
    flow = _amount_flow(spark, d)
    flow.train_models(["Decision Tree", "Linear Regression"], run_cv=False)
    rows = [(n, f, v) for n, res in flow.trained.items() for f, v in res.importance]
    flow.close()
    return rounded(spark.createDataFrame(rows, "model string, feature string, importance double"), 4)


# ---- what a penalised line leaves of an exact linear relation -------------------
#
# y = a + c z for the scaled feature z. A fit on rows with mean mz and variance vz
# has slope b; its error at z is (c - b) (z - mz).

def _kept(penalty: str, v: str = "vz", c: str = "c", n: str = "n") -> str:
    """Slope of Ridge, Lasso or Elastic Net for variance v of the feature."""
    kind, alpha = penalty.split(":")
    if kind == "ridge":
        return f"({c} * {v} / ({v} + {alpha} / {n}))"
    ratio = {"lasso": 1.0, "half": 0.5}[kind]
    return f"(greatest({c} * {v} - {alpha} * {ratio}, 0) / ({v} + {alpha} * {1 - ratio}))"


_PENALTY = {"Linear Regression": "ridge:0.0", "Ridge": "ridge:1.0", "Lasso": "lasso:1.0", "Elastic Net": "half:1.0"}

# rows of the workflow's split with the folds of its train rows, and the scaled feature
_LINE_SQL = f"""{_AMOUNT_SQL},
tr AS (SELECT avg(side) AS ms, stddev_pop(side) AS ss, count(*) AS n FROM parts WHERE split = 'train'),
z AS (SELECT parts.*, (side - ms) / ss AS z, 100 * ss AS c, tr.n AS trained FROM parts, tr),
held AS (SELECT *, ntile(5) OVER (ORDER BY rn) - 1 AS fold FROM z WHERE split = 'train')"""


def _errors_sql(split: str, model: str) -> str:
    b = _kept(_PENALTY[model], "1.0", "c", "trained")
    return f"""SELECT '{model}' AS model, sqrt(avg(((c - {b}) * z) ** 2)) AS rmse, avg(abs((c - {b}) * z)) AS mae, avg(((c - {b}) * z) ** 2) AS mse,
  1 - avg(((c - {b}) * z) ** 2) / var_pop(target) AS r2, 1 - var_pop((c - {b}) * z) / var_pop(target) AS ev FROM z WHERE split = '{split}'"""


def _all_errors(split: str, models) -> str:
    return " UNION ALL ".join(_errors_sql(split, x) for x in models)


def _fold_errors(penalty: str) -> str:
    """(fold, rmse, r2) of a fit on the other folds' train rows."""
    return f"""SELECT f.fold, sqrt(avg(((h.c - {_kept(penalty, 'f.vz', 'h.c', 'f.n')}) * (h.z - f.mz)) ** 2)) AS rmse,
  1 - avg(((h.c - {_kept(penalty, 'f.vz', 'h.c', 'f.n')}) * (h.z - f.mz)) ** 2) / var_pop(h.target) AS r2
  FROM held h JOIN (SELECT i.fold, avg(z) AS mz, var_pop(z) AS vz, count(*) AS n FROM held, (SELECT DISTINCT fold FROM held) i
                    WHERE held.fold <> i.fold GROUP BY i.fold) f ON h.fold = f.fold GROUP BY f.fold"""


@query("evaluate_test_reg", f"""WITH {_LINE_SQL}, e AS ({_all_errors('test', _PENALTY)})
SELECT model, {r('mse', 'test_mse', 3)}, {r('rmse', 'test_rmse', 3)}, {r('mae', 'test_mae', 3)}, {r('r2', 'test_r2', 4)},
       {r('ev', 'test_explained_variance', 4)} FROM e""")
def evaluate_test_reg(spark, d):
    flow = _amount_flow(spark, d)
    flow.train_models(list(_PENALTY), run_cv=False)
    out = flow.evaluate()
    flow.close()
    return rounded(out, {"test_mse": 3, "test_rmse": 3, "test_mae": 3, "test_r2": 4, "test_explained_variance": 4})


@query("evaluate_test_clf", f"""WITH {_CLASS_SQL}
SELECT model, 1.0::DOUBLE AS test_accuracy, 1.0::DOUBLE AS test_precision, 1.0::DOUBLE AS test_recall, 1.0::DOUBLE AS test_f1,
       CASE WHEN count(DISTINCT target) = 2 THEN 1.0::DOUBLE END AS test_roc_auc
FROM parts, (VALUES ('Logistic Regression'), ('Decision Tree'), ('Naive Bayes')) AS v(model) WHERE split = 'test' GROUP BY model""")
def evaluate_test_clf(spark, d):
    flow = _class_flow(spark, d)
    flow.train_models(["Logistic Regression", "Decision Tree", "Naive Bayes"], run_cv=False)
    out = flow.evaluate()
    flow.close()
    return rounded(out)


_EXACT = ("Decision Tree", "Random Forest", "AdaBoost", "K-Nearest Neighbors")


@query("train_all_reg", f"""WITH {_LINE_SQL}, t AS ({_all_errors('train', _PENALTY)}), v AS ({_all_errors('val', _PENALTY)}),
cv AS ({" UNION ALL ".join(f"SELECT '{x}' AS model, * FROM ({_fold_errors(_PENALTY[x])})" for x in _PENALTY)}),
k AS (SELECT model, avg(rmse) AS m, stddev_pop(rmse) AS s FROM cv GROUP BY model)
SELECT model, {r('t.r2', 'train_r2', 4)}, {r('v.r2', 'val_r2', 4)}, {r('v.rmse', 'val_rmse', 3)}, {r('v.mae', 'val_mae', 3)},
       {r('k.m', 'cv_mean_rmse', 3)}, {r('k.s', 'cv_std', 3)} FROM t JOIN v USING (model) JOIN k USING (model)
UNION ALL SELECT model, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0 FROM (VALUES {", ".join(f"('{x}')" for x in _EXACT)}) AS x(model)""")
def train_all_reg(spark, d):
    """Default settings and five folds of all models but boosting, whose hundred rounds reg_gbt fits."""
    flow = _amount_flow(spark, d)
    out = flow.train_models([*_PENALTY, *_EXACT]).drop("train_time_s")
    flow.close()
    return rounded(out, {"train_r2": 4, "val_r2": 4, "val_rmse": 3, "val_mae": 3, "cv_mean_rmse": 3, "cv_std": 3})


_CLASSIFIERS = ("Logistic Regression", "Random Forest", "Decision Tree", "K-Nearest Neighbors", "SVM", "Naive Bayes", "AdaBoost")


@query("train_all_clf", f"""WITH {_CLASS_SQL}
SELECT model, 1.0::DOUBLE AS train_accuracy, 1.0::DOUBLE AS val_accuracy, 1.0::DOUBLE AS val_precision, 1.0::DOUBLE AS val_recall,
       1.0::DOUBLE AS val_f1, CASE WHEN count(DISTINCT target) = 2 THEN 1.0::DOUBLE END AS val_roc_auc, 1.0::DOUBLE AS cv_mean,
       CAST(NULL AS DOUBLE) AS cv_std FROM parts, (VALUES {", ".join(f"('{x}')" for x in _CLASSIFIERS)}) AS v(model)
WHERE split = 'val' GROUP BY model""")
def train_all_clf(spark, d):
    """Default settings and five folds of all models but boosting, whose hundred rounds clf_gbt fits."""
    flow = _class_flow(spark, d)
    out = flow.train_models(list(_CLASSIFIERS)).drop("train_time_s")
    flow.close()
    return rounded(out)


_ALPHAS = ("0.001", "0.01", "0.1", "1.0", "10.0", "100.0")


@query("tune_ridge", f"""WITH {_LINE_SQL},
cv AS ({" UNION ALL ".join(f"SELECT {x} AS alpha, avg(r2) AS score FROM ({_fold_errors('ridge:' + x)})" for x in _ALPHAS)}),
best AS (SELECT arg_max(alpha, score) AS alpha, max(score) AS score FROM cv),
v AS (SELECT avg(((c - c / (1 + alpha / trained)) * z) ** 2) AS mse, avg(abs((c - c / (1 + alpha / trained)) * z)) AS mae, var_pop(target) AS vy
      FROM z, best WHERE split = 'val')
SELECT 'Ridge' AS model, {r('score', 'best_cv_score', 5)}, {r('1 - mse / vy', 'val_score', 5)}, CAST({len(_ALPHAS)} AS BIGINT) AS iterations,
       {r('sqrt(mse)', 'val_rmse', 3)}, {r('mae', 'val_mae', 3)} FROM best, v""")
def tune_ridge(spark, d):
    """Twenty candidates are asked for; the grid has six."""
    flow = _amount_flow(spark, d)
    out = flow.tune_models(["Ridge"]).drop("tuning_time_s")
    flow.close()
    return rounded(out, {"best_cv_score": 5, "val_score": 5, "val_rmse": 3, "val_mae": 3})


@query("tune_tree", f"""WITH {_CLASS_SQL}
SELECT 'Decision Tree' AS model, 1.0::DOUBLE AS best_cv_score, avg(CASE WHEN target = target THEN 1.0 END)::DOUBLE AS val_score,
       CAST(20 AS BIGINT) AS iterations, 1.0::DOUBLE AS val_precision, 1.0::DOUBLE AS val_recall, 1.0::DOUBLE AS val_f1
FROM parts WHERE split = 'val'""")
def tune_tree(spark, d):
    flow = _class_flow(spark, d)
    out = flow.tune_models(["Decision Tree"]).drop("tuning_time_s")
    flow.close()
    return rounded(out)


@query("run_full_clf", f"""WITH {_CLASS_SQL}
SELECT 'Naive Bayes' AS model, 1.0::DOUBLE AS test_accuracy, 1.0::DOUBLE AS test_precision, 1.0::DOUBLE AS test_recall, 1.0::DOUBLE AS test_f1,
       CASE WHEN count(DISTINCT target) = 2 THEN 1.0::DOUBLE END AS test_roc_auc FROM parts WHERE split = 'test'
UNION ALL SELECT 'Decision Tree', 1.0, 1.0, 1.0, 1.0, CASE WHEN count(DISTINCT target) = 2 THEN 1.0::DOUBLE END FROM parts WHERE split = 'test'""")
def run_full_clf(spark, d):
    """Load to saved package, five folds and the whole search included."""
    flow = TabularWorkflow(spark)
    out = flow.run(derived(spark, d, "part", _CLASS_TABLE), "target", ["Naive Bayes", "Decision Tree"], key="p_partkey",
                   features=["wide", "p_retailprice"], task="classification", save_to=scratch_path(spark, "package"))
    flow.close()
    return rounded(out)


@query("run_full_reg", f"""WITH {_LINE_SQL}, e AS ({_all_errors('test', ['Linear Regression'])})
SELECT model, {r('mse', 'test_mse', 3)}, {r('rmse', 'test_rmse', 3)}, {r('mae', 'test_mae', 3)}, {r('r2', 'test_r2', 4)},
       {r('ev', 'test_explained_variance', 4)} FROM e
UNION ALL SELECT 'Decision Tree', 0.0, 0.0, 0.0, 1.0, 1.0""")
def run_full_reg(spark, d):
    """Load to saved package, five folds and the whole search included."""
    flow = TabularWorkflow(spark)
    out = flow.run(derived(spark, d, "part", _AMOUNT_TABLE), "target", ["Linear Regression", "Decision Tree"], key="p_partkey",
                   features=["side"], task="regression", save_to=scratch_path(spark, "package"))
    flow.close()
    return rounded(out, {"test_mse": 3, "test_rmse": 3, "test_mae": 3, "test_r2": 4, "test_explained_variance": 4})


# ---- names that the engine uses itself ------------------------------------------

_RESERVED = {"label": "l_quantity", "features": "l_discount", "prediction": "l_extendedprice", "split": "l_tax"}


@query("score_reserved_names", f"""
SELECT l_orderkey, {', '.join(f'{c} AS {n}' for n, c in _RESERVED.items())}, l_linenumber AS "Probability_Class_0",
       CASE WHEN l_quantity > 25 THEN '1' ELSE '0' END AS "Prediction_" FROM lineitem""")
def score_reserved_names(spark, d):
    """Features called like internal columns train and score, and come back unchanged."""
    rows = table(spark, d, "lineitem").select("l_orderkey", *[F.col(c).alias(n) for n, c in _RESERVED.items()],
                                              F.col("l_linenumber").cast("long").alias("Probability_Class_0"))
    df = rows.withColumn("target", (F.col("label") > 25).cast("int"))
    flow = TabularWorkflow(spark)
    flow.load(df)
    flow.select_target("target", features=[*_RESERVED, "Probability_Class_0"])
    flow.detect("classification")
    flow.prepare()
    flow.train_models(["Decision Tree"], run_cv=False)
    out = score(flow.package(), rows, probabilities=False)
    flow.close()
    return rounded(out)
