"""Sums of products of many columns, gathered in one pass and added up by Spark.

Every task keeps square matrices of the columns it has seen and hands on their
upper halves as rows, so neither the plan nor a task's memory grows with the
table; the matrices are added up with an ordinary grouped sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

#: Cells of a block of rows that are multiplied at a time.
_CELLS = 1 << 20


def _blocks(column: pa.ListArray, width: int) -> Iterator[np.ndarray]:
    """Rows of a list column as matrices; missing entries are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)
    step = max(1, _CELLS // max(width, 1))
    for at in range(0, len(flat), step):
        yield flat[at:at + step]


def pair_sums(df: DataFrame, columns: list[Column], diagonal: bool = False) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy) for i before j (and i = j with ``diagonal``): sums over the rows where both are present.

    ``x`` belongs to column i and ``y`` to column j. The columns should be centred,
    or the sums lose digits.
    """
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, x, xx, xy = (np.zeros((width, width)) for _ in range(4))
        for b in batches:
            for z in _blocks(b.column(0), width):
                there = ~np.isnan(z)
                z, p = np.where(there, z, 0.0), there.astype(np.float64)
                n += p.T @ p
                x += z.T @ p
                xx += (z * z).T @ p
                xy += z.T @ z
        i, j = np.triu_indices(width, 0 if diagonal else 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(n[i, j].astype(np.int64)),
             *[pa.array(m) for m in (x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j])]],
            names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    rows = df.select(F.array(*columns).alias("z")).mapInArrow(
        run, "i int, j int, n long, x double, y double, xx double, yy double, xy double")
    return rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def fold_products(df: DataFrame, features: str, label: str, fold: str, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of products of (1, features, label) per fold, and the shift that was taken off first.

    One pass over the rows; the answer is folds x (features + 2)² numbers, so the
    caller checks the number of features. The shift, the first row, keeps the sums
    near the data's spread.
    """
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("f"))
    first = rows.select("x", "y").first()
    if first is None:
        raise ValueError("no rows to fit on")
    shift = np.array([0.0, *first["x"], first["y"]])
    size = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size))
        for b in batches:
            y, f = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            at = 0
            for x in _blocks(b.column(0), size - 2):
                v = np.column_stack([np.ones(len(x)), x, y[at:at + len(x)]]) - shift
                own = f[at:at + len(x)]
                at += len(x)
                for k in range(folds):
                    part = v[own == k]
                    total[k] += part.T @ part
        i, j = np.triu_indices(size)
        for k in range(folds):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[k][i, j])],
                names=["f", "i", "j", "v"])

    sums = rows.mapInArrow(run, "f int, i int, j int, v double").groupBy("f", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((folds, size, size))
    f, i, j = (sums[c].to_numpy(np.int64) for c in ("f", "i", "j"))
    out[f, i, j] = out[f, j, i] = sums["v"].to_numpy(np.float64)
    return out, shift


class LinearFit:
    """A linear model in the shifted coordinates of its product matrices."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def scores(self, products: np.ndarray) -> dict[str, float]:
        """rmse and r2 on the rows behind ``products``, without reading them again."""
        n = products[0, 0]
        v = np.concatenate([[-self.intercept], -self.weights, [1.0]])
        mse = max(float(v @ products @ v), 0.0) / n
        spread = products[-1, -1] / n - (products[0, -1] / n) ** 2
        # sums of squares are exact to some 2^-50 of the label's own square
        if mse < 2.0 ** -46 * (products[-1, -1] / n):
            mse = 0.0
        r2 = 1.0 - mse / spread if spread > 0 else float(mse == 0)
        return {"rmse": float(mse) ** 0.5, "r2": float(r2)}


def _centred(products: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    n = products[0, 0]
    mean = products[0, 1:] / n
    return n, mean, products[1:, 1:] - n * np.outer(mean, mean)


def _finished(weights: np.ndarray, mean: np.ndarray) -> LinearFit:
    return LinearFit(weights, float(mean[-1] - weights @ mean[:-1]))


def solve_ridge(products: np.ndarray, penalty: float) -> LinearFit:
    """Least squares with ``penalty`` times the squared weights; the least-norm solution where several fit."""
    _, mean, c = _centred(products)
    inner = c[:-1, :-1] + penalty * np.eye(len(c) - 1)
    return _finished(np.linalg.lstsq(inner, c[:-1, -1], rcond=1e-12)[0], mean)


def solve_elastic(products: np.ndarray, alpha: float, ratio: float, sweeps: int = 10_000, tolerance: float = 1e-10) -> LinearFit:
    """Mean squared error / 2 + alpha * (ratio * |w| + (1 - ratio) / 2 * w²), by coordinate descent on the covariances."""
    n, mean, c = _centred(products)
    inner, outer = c[:-1, :-1] / n, c[:-1, -1] / n
    w, along = np.zeros(len(outer)), np.zeros(len(outer))  # along = inner @ w
    scale = max(float(np.abs(outer).max(initial=0.0)), 1e-300)
    for _ in range(sweeps):
        worst = 0.0
        for j in range(len(w)):
            rest = outer[j] - along[j] + inner[j, j] * w[j]
            below = inner[j, j] + alpha * (1 - ratio)
            new = np.sign(rest) * max(abs(rest) - alpha * ratio, 0.0) / below if below > 0 else 0.0
            if new != w[j]:
                worst = max(worst, abs(new - w[j]) * max(inner[j, j], 1e-300))
                along += inner[:, j] * (new - w[j])
                w[j] = new
        if worst <= tolerance * scale:
            break
    return _finished(w, mean)
