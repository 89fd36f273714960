"""Metrics over a table of labels and predictions, each a single aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabspark.functions.expr import col
from tabspark.functions.rank import running_before


def _safe(a: Column, b: Column) -> Column:
    """a / b, zero where the divisor is zero."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    hit = F.coalesce((col(label) == col(prediction)).cast("double"), F.lit(0.0))
    return df.agg(F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n): the pairs that occur."""
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """The full square matrix, zero cells included.

    Classes are few by nature of a confusion matrix; the grid is unfolded from
    the class list of each row, not joined.
    """
    cells = confusion(df, label, prediction)
    present = cells.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
    classes = present.agg(F.array_sort(F.collect_list("c")).alias("cs"))
    grid = classes.select(F.explode("cs").alias("label"), "cs").select(
        "label", F.explode("cs").alias("prediction"))
    return (grid.join(cells, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("n", F.lit(0).cast("long")).alias("n")))


def _per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, tp, support, predicted) from the confusion counts, without a second pass."""
    cells = confusion(df, label, prediction)
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )).alias("s")).select("s.*")
    return sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                      F.sum("predicted").alias("predicted"))


def class_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support) for every class seen or predicted."""
    p, r = _safe(F.col("tp"), F.col("predicted")), _safe(F.col("tp"), F.col("support"))
    f1 = _safe(F.col("tp") * 2.0, F.col("support") + F.col("predicted"))
    return _per_class(df, label, prediction).select(
        "class", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support", "tp")


def precision_recall_f1(df: DataFrame, label: str, prediction: str, average: str | None = None) -> DataFrame:
    """One row: accuracy, precision, recall, f1.

    Two label classes give the metrics of the positive class (1 if present,
    otherwise the greatest label); more classes give support-weighted means.
    ``average`` forces 'binary' or 'weighted'.
    """
    m = class_metrics(df, label, prediction)
    n = F.sum("support")
    seen = F.col("support") > 0
    one = F.col("class").cast("string").isin("1", "1.0")
    # Class 1 wins over any other, then the greatest class.
    rank = F.struct(one.cast("int"), F.col("class"))
    row = m.agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.count(F.when(seen, True)).alias("n_classes"),
        F.max_by(F.struct("precision", "recall", "f1"), F.when(seen, rank)).alias("positive"),
        *[(F.sum(F.col(c) * F.col("support")) / n).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
    )
    binary = {"binary": F.lit(True), "weighted": F.lit(False)}.get(average, F.col("n_classes") == 2)
    return row.select("accuracy", *[
        F.when(binary, F.col("positive")[c]).otherwise(F.col(f"w_{c}")).alias(c)
        for c in ("precision", "recall", "f1")])


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per-class rows followed by accuracy, macro and weighted averages."""
    m = class_metrics(df, label, prediction)
    rows = m.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    n = F.sum("support")
    acc = F.sum("tp") / n
    names = ("precision", "recall", "f1")
    summary = m.agg(F.array(
        F.struct(F.lit("accuracy").alias("class"), *[acc.alias(c) for c in names], n.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], n.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"),
                 *[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in names], n.alias("support")),
    ).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return rows.unionByName(summary)


def auc_by(df: DataFrame, groups: list[str], positive: str, score: str) -> DataFrame:
    """(groups, auc, n_positive, n) by the rank statistic, ties counted half.

    Equal scores are summed before anything is ordered. Negatives below each
    score come from quantile-binned running sums, so no global sort is needed.
    The area is null where a class is absent or a labelled row has no score.
    """
    is_pos = col(positive).cast("boolean")
    value = col(score).cast("double")
    none = value.isNull() | F.isnan(value)
    by_score = df.select(*groups, F.when(none, float("inf")).otherwise(value).alias("_score"), is_pos.alias("_p"),
                         (none & is_pos.isNotNull()).alias("_none")) \
        .groupBy(*groups, "_score").agg(F.bool_or("_none").alias("_none"),
            F.count(F.when(F.col("_p"), True)).alias("_pos"), F.count(F.when(~F.col("_p"), True)).alias("_neg"))
    below = running_before(by_score, groups, "_score", "_neg", "_below")
    u = F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2.0))
    p, n = F.sum("_pos"), F.sum("_neg")
    area = u / F.nullif(p * n, F.lit(0)).cast("double")
    return below.groupBy(*groups).agg(
        F.when(~F.bool_or("_none"), area).alias("auc"), p.alias("n_positive"), (p + n).alias("n"))


def auc(df: DataFrame, positive: str, score: str) -> DataFrame:
    return auc_by(df, [], positive, score).select("auc")


def auc_one_vs_rest(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """Prevalence-weighted mean of the one-vs-rest areas; ``scores`` maps class to score column."""
    rows = F.array(*[F.struct(F.lit(str(k)).alias("class"),
                              (col(label).cast("string") == F.lit(str(k))).alias("is_class"),
                              col(c).cast("double").alias("score")) for k, c in scores.items()])
    long = df.select(F.explode(rows).alias("r")).select("r.*")
    per = auc_by(long, ["class"], "is_class", "score")
    missing = F.count(F.when(F.col("auc").isNull(), True))
    value = F.sum(F.col("auc") * F.col("n_positive")) / F.sum("n_positive")
    return per.agg(F.when(missing == 0, value).alias("auc"))


def _error(label: str, prediction: str) -> tuple[Column, Column]:
    y, yhat = col(label).cast("double"), col(prediction).cast("double")
    return y, y - yhat


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: mse, rmse, mae, r2, explained_variance, mape.

    mape is null as soon as one label is zero. A constant label gives r2 of
    one for a perfect fit and zero otherwise.
    """
    y, e = _error(label, prediction)
    row = df.select(y.alias("y"), e.alias("e")).agg(
        F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg(F.abs("e")).alias("mae"),
        F.var_pop("y").alias("vy"), F.var_pop("e").alias("ve"),
        F.avg(F.abs("e") / F.nullif(F.abs("y"), F.lit(0.0))).alias("ape"),
        F.count(F.when(F.col("y") == 0, True)).alias("zeros"))

    def share(error: Column) -> Column:
        return F.when(F.col("vy") > 0, 1 - error / F.col("vy")).when(error == 0, F.lit(1.0)).otherwise(F.lit(0.0))

    return row.select("mse", F.sqrt("mse").alias("rmse"), "mae", share(F.col("mse")).alias("r2"),
                      share(F.col("ve")).alias("explained_variance"),
                      F.when(F.col("zeros") == 0, F.col("ape")).alias("mape"))


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.withColumn("residual", _error(label, prediction)[1])


def residual_summary(df: DataFrame, label: str, prediction: str, config=None) -> DataFrame:
    """Mean, population deviation, exact median, least and greatest residual."""
    from tabspark.config import EngineConfig
    from tabspark.functions.rank import exact_quantiles
    r = residuals(df, label, prediction)
    median = exact_quantiles(r.select("residual"), ["residual"], [0.5], config or EngineConfig())["residual"][0]
    return r.agg(F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("std"),
                 F.min("residual").alias("min"), F.max("residual").alias("max")).select(
        "mean", "std", F.lit(median).cast(T.DoubleType()).alias("median"), "min", "max")


def metrics_long(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Wide metric columns to (key, metric, value) rows."""
    return df.unpivot([key], metrics, "metric", "value")
