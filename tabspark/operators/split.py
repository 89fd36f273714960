"""Reproducible train / validation / test splits and cross-validation folds.

Rows are ordered by a hash of their key. Fitting finds the hash values at the
quota ranks by counting; applying a plan is then a row-local comparison with
literals: no shuffle, no window, and the same row always lands in the same part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabspark.config import EngineConfig
from tabspark.functions.expr import as_text, col, dtype_of, free_names, present, row_digest
from tabspark.functions.rank import hash_order, position_cuts
from tabspark.operators.quality import target_summary
from tabspark.session import scratch_path

MAX_STRATA = 50


def stage_rows(df: DataFrame) -> tuple[DataFrame, str, str]:
    """Writes a table once with a key per row: the digest of the row, and a tie-break between equal rows.

    Returns the table and the names of the two new columns.

    The tie-break is any unique number, fixed by writing it. Distinct rows are
    ordered by their content alone; only copies of one row are told apart by it,
    so that copies, however many, are shared out like any other rows.
    """
    path = scratch_path(df.sparkSession, "rows")
    key, tie = free_names(df.columns, "_row_key", "_row_tie")
    (df.withColumn(key, row_digest(df)).withColumn(tie, F.md5(F.monotonically_increasing_id().cast("string")))
     .write.parquet(path))
    return df.sparkSession.read.parquet(path), key, tie


def _must_be_new(df: DataFrame, *names: str) -> None:
    if list(names) != free_names(df.columns, *names):
        raise ValueError(f"the table has a column called {' or '.join(names)}; choose another name for the result")


@dataclass(frozen=True)
class CutPlan:
    """Per stratum the positions that separate the parts."""
    labels: tuple
    key: str
    target: str | None
    seed: int
    cuts: dict
    tie: str | None = None

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        _must_be_new(df, out)
        pos, cut = free_names([*df.columns, out], "_pos", "_cut")
        rows = df.withColumn(pos, _position(df, self.key, self.seed, self.tie)[0])
        group = _stratum(df, self.target)
        chosen = None
        for g, cuts in self.cuts.items():
            literal = F.array(*[F.lit(c or "") for c in cuts])
            test = group.isNull() if g is None else group == F.lit(g)
            chosen = F.when(test, literal) if chosen is None else chosen.when(test, literal)
        rows = rows.withColumn(cut, chosen)
        part = None
        for j, label in enumerate(self.labels[:-1]):
            hit = F.col(pos) <= F.col(cut)[j]
            part = F.when(hit, F.lit(label)) if part is None else part.when(hit, F.lit(label))
        return rows.withColumn(out, part.otherwise(F.lit(self.labels[-1]))).drop(pos, cut)


def _position(df: DataFrame, key: str, seed: int, tie: str | None) -> tuple[Column, int]:
    """Place of a row in hash order, and how many uniform hex digits it starts with."""
    if tie is not None:
        return F.concat(hash_order(col(key), seed), col(tie)), 64
    text = as_text(col(key), dtype_of(df, key))
    return F.concat(hash_order(text, seed), F.lit("|"), text), 32


def _stratum(df: DataFrame, target: str | None) -> Column:
    if target is None:
        return F.lit("all")
    return as_text(present(col(target), dtype_of(df, target)), dtype_of(df, target))


def _fit(df: DataFrame, key: str, target: str | None, labels: tuple, ranks, config: EngineConfig,
         tie: str | None = None) -> CutPlan:
    position, digits = _position(df, key, config.seed, tie)
    return CutPlan(labels, key, target, config.seed,
                   position_cuts(df, _stratum(df, target), position, digits, ranks, config), tie)


def stratify_decision(df: DataFrame, target: str, task: str = "classification") -> DataFrame:
    """(stratify, n_classes, min_class): two rows per class and 50 classes at most."""
    return target_summary(df, target).select(
        (F.lit(task == "classification") & (F.col("min_class") >= 2) & (F.col("n_unique") <= MAX_STRATA))
        .alias("stratify"), F.col("n_unique").alias("n_classes"), "min_class")


def fit_split(df: DataFrame, key: str, target: str | None = None,
              task: str = "classification", config: EngineConfig = EngineConfig(), tie: str | None = None) -> CutPlan:
    """Quotas: ceil of the test share, then ceil of the validation share of the rest.

    Rows with the same key stay together; ``split`` without a key keys every row.
    """
    strata = None
    if target is not None and stratify_decision(df, target, task).first()["stratify"]:
        strata = target

    def ranks(n: int) -> list[int]:
        n_test = math.ceil(config.test_size * n)
        return [n_test, n_test + math.ceil(config.val_size * (n - n_test))]

    return _fit(df, key, strata, ("test", "val", "train"), ranks, config, tie)


def split(df: DataFrame, key: str | None = None, target: str | None = None, task: str = "classification",
          config: EngineConfig = EngineConfig(), out: str = "split") -> DataFrame:
    _must_be_new(df, out)
    if key is not None:
        return fit_split(df, key, target, task, config).apply(df, out)
    df, key, tie = stage_rows(df)
    return fit_split(df, key, target, task, config, tie).apply(df, out).drop(key, tie)


def fit_folds(df: DataFrame, key: str, target: str | None = None,
              k: int | None = None, config: EngineConfig = EngineConfig(), tie: str | None = None) -> CutPlan:
    """k contiguous folds per stratum; the first ``n mod k`` folds hold one row more."""
    k = k or config.cv_folds
    strata = None
    if target is not None and target_summary(df, target).first()["n_unique"] <= MAX_STRATA:
        strata = target

    def ranks(n: int) -> list[int]:
        return [(n // k) * (j + 1) + min(j + 1, n % k) for j in range(k - 1)]

    return _fit(df, key, strata, tuple(range(k)), ranks, config, tie)


def assign_folds(df: DataFrame, key: str | None = None, target: str | None = None, k: int | None = None,
                 config: EngineConfig = EngineConfig(), out: str = "fold") -> DataFrame:
    _must_be_new(df, out)
    if key is not None:
        return fit_folds(df, key, target, k, config).apply(df, out)
    df, key, tie = stage_rows(df)
    return fit_folds(df, key, target, k, config, tie).apply(df, out).drop(key, tie)


def split_with_folds(df: DataFrame, key: str, target: str | None, config: EngineConfig = EngineConfig(),
                     out: str = "split", fold: str = "fold", tie: str | None = None) -> DataFrame:
    """Split and folds of the train rows from one fit.

    Folds are contiguous in hash order and the train rows come last in it, so
    both are cuts of the same order. ``fold`` is null outside the train rows.
    """
    k = config.cv_folds

    def ranks(n: int) -> list[int]:
        n_test = math.ceil(config.test_size * n)
        held = n_test + math.ceil(config.val_size * (n - n_test))
        rest = n - held
        return [n_test, held] + [held + (rest // k) * (j + 1) + min(j + 1, rest % k) for j in range(k - 1)]

    _must_be_new(df, out, fold)
    plan = _fit(df, key, target, (-2, -1, *range(k)), ranks, config, tie)
    name = free_names([*df.columns, out, fold], "_part")[0]
    part = F.col(name)
    return (plan.apply(df, name)
            .withColumn(out, F.when(part == -2, "test").when(part == -1, "val").otherwise("train"))
            .withColumn(fold, F.when(part >= 0, part)).drop(name))


def split_info_classes(df: DataFrame, target: str, part: str = "split") -> DataFrame:
    """(split, target, n, share of the split): class counts and class shares."""
    counts = df.groupBy(part, target).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(part).agg(F.sum("n").alias("split_n"))
    # ``totals`` has one row per part.
    return counts.join(F.broadcast(totals), part).withColumn("class_share", F.col("n") / F.col("split_n"))


def split_info(df: DataFrame, n_features: int, target: str | None = None, part: str = "split") -> DataFrame:
    """Rows and percentage per part; with a numeric target also its mean and sample deviation."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if target is not None:
        v = present(col(target), dtype_of(df, target))
        aggs += [F.avg(v).alias("target_mean"), F.stddev_samp(v).alias("target_std")]
    sizes = df.groupBy(part).agg(*aggs)
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.withColumn("pct", F.col("n") * 100.0 / total).withColumn(
        "n_features", F.lit(n_features).cast("long"))
