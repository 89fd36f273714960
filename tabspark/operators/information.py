"""Mutual information of numbers with a class by nearest neighbours in value.

The estimator needs, for each row, the distance to the k-th nearest value of its
own class, and how many values of all classes are nearer than that. Values are
dealt into ranges of a counted size; a range gets the few values of the
neighbouring ranges that its rows may need, and the counts add the rows of whole
ranges to those of a part of one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabspark.config import EngineConfig
from tabspark.functions.expr import col, dtype_of, present
from tabspark.functions.rank import exact_quantiles
from tabspark.session import cut_lineage

_KEY = ["i", "bin"]


def digamma(n: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, for numbers from 1."""
    x = np.asarray(n, np.float64).copy()
    out = np.zeros_like(x)
    for _ in range(10):  # up to where the series is exact
        low = x < 10
        out[low] -= 1.0 / x[low]
        x[low] += 1.0
    z = 1.0 / (x * x)
    return out + np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))


def _kth_distance(values: np.ndarray, k: int) -> np.ndarray:
    """Distance of each of the sorted values to its k-th nearest other one (fewer, if there are fewer)."""
    n, k = len(values), min(k, len(values) - 1)
    best = np.full(n, np.inf)
    at = np.arange(n)
    for back in range(k + 1):  # of k + 1 neighbours in order, so many lie before the value
        first, last = at - back, at - back + k
        fits = (first >= 0) & (last < n)
        best[fits] = np.minimum(best[fits], np.maximum(values[fits] - values[first[fits]], values[last[fits]] - values[fits]))
    return best


def _radii(k: int):
    """(i, c, x, w, r) of the values of a range; those marked as outer only help."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c, own in rows.groupby("c", sort=False):
            own = own.sort_values("x", kind="stable")
            copies = np.minimum(own["w"].to_numpy(), k + 1)
            values = np.repeat(own["x"].to_numpy(), copies)
            first = np.cumsum(copies) - copies
            found = own[["i", "c", "x", "w"]].assign(r=_kth_distance(values, k)[first])
            out.append(found[~own["outer"].to_numpy(bool)])
        return pd.concat(out, ignore_index=True).astype({"c": object})

    return run


def _nearer(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Per asked (c, x, r, side) of a range, the points of lower ranges and of this one that lie below the bound.

    Side 1 counts up to the last value nearer than r above x, side -1 those below
    x that are not nearer. The distances themselves are compared, as sums of x
    and r may be rounded to the wrong side of a value.
    """
    if not len(asked):
        return pd.DataFrame({"i": np.empty(0, np.int32), "c": np.empty(0, object), "x": np.empty(0), "w": np.empty(0, np.int64), "m": np.empty(0, np.int64)})
    points = points.sort_values("x", kind="stable")
    v, weight = points["x"].to_numpy(), points["w"].to_numpy()
    upto = int(points["before"].iloc[0] if len(points) else asked["start"].iloc[0]) + np.concatenate([[0], np.cumsum(weight)])
    x, r, side = (asked[c].to_numpy() for c in ("x", "r", "side"))

    def nearer(at, who):
        gap = np.abs(v[at] - x[who])
        return np.where(r[who] > 0, gap < r[who], gap <= 0)

    place = np.searchsorted(v, x + side * r, "left")
    who = np.arange(len(x))
    for _ in range(4):  # rounding moves a bound by a value or two at most
        up = who[(place < len(v))]
        below = v[place[up]] <= x[up]
        near = nearer(place[up], up)
        place[up] += np.where(side[up] > 0, below | near, below & ~near & (v[place[up]] != x[up]))
        down = who[place > 0]
        above = v[place[down] - 1] >= x[down]
        near = nearer(place[down] - 1, down)
        place[down] -= np.where(side[down] > 0, above & ~near & (v[place[down] - 1] != x[down]), above | near)
    return pd.DataFrame({"i": asked["i"], "c": asked["c"].astype(object), "x": x, "w": asked["w"], "m": side * upto[place]})


def _last_two(values: Column) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - 1), 2)


def mutual_information_knn(df: DataFrame, columns: list[str], target: str, k: int = 3, top: int = 10,
                           rows: int | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(column, mi): information between numbers and the class by k nearest values, most informative first.

    Missing numbers take the median; rows without a class, and classes of one row,
    are left out. ``rows`` is about the number of distinct values in a range.
    """
    rows = rows or config.rank_bucket_rows
    spark = df.sparkSession
    number = lambda c: present(col(c), dtype_of(df, c)).cast("double")
    medians = exact_quantiles(df, columns, [0.5], config)
    usable = [c for c in columns if medians[c][0] is not None]
    empty = spark.createDataFrame([], "column string, mi double")
    if not usable:
        return empty
    text = present(col(target), dtype_of(df, target)).cast("string")
    wide = df.select(text.alias("c"), *[F.coalesce(number(c), F.lit(medians[c][0])).alias(f"v{i}") for i, c in enumerate(usable)]).where("c IS NOT NULL")
    classes = wide.groupBy("c").agg(F.count(F.lit(1)).alias("nc")).where("nc > 1")
    n = classes.agg(F.sum("nc")).first()[0]
    if not n:
        return empty
    bins = max(1, -(-n // rows))
    probs = [j / bins for j in range(1, bins)]
    cuts = wide.approxQuantile([f"v{i}" for i in range(len(usable))], probs, 1 / (4 * bins)) if probs else [[] for _ in usable]
    edges = [sorted({x for x in cut if np.isfinite(x)}) for cut in cuts]
    inf = float("inf")
    for i, e in enumerate(edges):
        if e:
            wide = Bucketizer(splits=[-inf, *e, inf], inputCol=f"v{i}", outputCol=f"b{i}").transform(wide)
        else:
            wide = wide.withColumn(f"b{i}", F.lit(0.0))
    long = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("x"), F.col(f"b{i}").cast("int").alias("bin")) for i in range(len(usable))])
    cells = (wide.join(classes.select("c"), "c", "left_semi").select("c", F.explode(long).alias("p")).select("c", "p.*")
             .groupBy("i", "bin", "c", "x").agg(F.count(F.lit(1)).alias("w")))
    cells = cut_lineage(cells)

    # the k values of a class before and after a range: each range that has the class has one at least
    ends = cells.groupBy("i", "bin", "c").agg(F.sort_array(F.collect_list(F.struct("x", "w"))).alias("xw"))
    ends = cut_lineage(ends.select("i", "bin", "c", F.slice("xw", 1, k).alias("head"),
                                   F.slice("xw", F.greatest(F.lit(1), F.size("xw") - k + 1), k).alias("tail")))
    by_class = Window.partitionBy("i", "c").orderBy("bin")
    around = ends.select("i", "bin", "c", F.flatten(F.array(
        F.flatten(F.collect_list("tail").over(by_class.rowsBetween(-k, -1))),
        F.flatten(F.collect_list("head").over(by_class.rowsBetween(1, k))))).alias("near"))
    outer = around.select("i", "bin", "c", F.explode("near").alias("p")).select("i", "bin", "c", "p.x", "p.w", F.lit(True).alias("outer"))
    inner = cells.select("i", "bin", "c", "x", "w", F.lit(False).alias("outer"))
    radii = cut_lineage(inner.union(outer).groupBy(*_KEY).applyInPandas(_radii(k), "i int, c string, x double, w long, r double"))

    # points of all classes, and in each range two values of the neighbours on either side
    points = cells.groupBy("i", "bin", "x").agg(F.sum("w").alias("w"))
    totals = points.groupBy(*_KEY).agg(F.sum("w").alias("n"), F.sort_array(F.collect_list(F.struct("x", "w"))).alias("xw")).select(
        *_KEY, "n", F.slice("xw", 1, 2).alias("head"), _last_two(F.col("xw")).alias("tail"))
    every = spark.createDataFrame([(i, b) for i, e in enumerate(edges) for b in range(len(e) + 1)], "i int, bin int")
    by_column = Window.partitionBy("i").orderBy("bin")
    totals = every.join(totals, _KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    nothing = F.array().cast("array<struct<x:double,w:bigint>>")
    totals = cut_lineage(totals.select(
        *_KEY, F.coalesce(F.sum("n").over(by_column.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        _last_two(F.flatten(F.collect_list(F.coalesce("tail", nothing)).over(by_column.rowsBetween(-9, -1)))).alias("left"),
        F.slice(F.flatten(F.collect_list(F.coalesce("head", nothing)).over(by_column.rowsBetween(1, 9))), 1, 2).alias("right")))
    # the counting starts below the values taken from the left
    before = F.col("offset") - F.aggregate("left", F.lit(0).cast("bigint"), lambda a, p: a + p["w"])
    totals = totals.withColumn("before", before)
    here = points.join(totals.select(*_KEY, "before"), _KEY)
    beside = totals.select(*_KEY, "before", F.explode(F.concat("left", "right")).alias("p")).select("i", "bin", "p.x", "p.w", "before")
    starts = totals.toDF("i", "bin", "offset", "left", "right", "start")
    shared = spark.sparkContext.broadcast([np.array(e) for e in edges])

    def dealt(batches):
        for b in batches:
            for side in (1, -1):
                value = (b["x"] + side * b["r"]).to_numpy()
                place = np.zeros(len(b), np.int32)
                for i in b["i"].unique():
                    own = (b["i"] == i).to_numpy()
                    place[own] = np.searchsorted(shared.value[i], value[own], "right")
                yield b.assign(side=side, bin=place).astype({"c": object})[["i", "bin", "c", "x", "w", "r", "side"]]

    asked = (radii.mapInPandas(dealt, "i int, bin int, c string, x double, w long, r double, side int")
             .join(starts.select(*_KEY, "start"), _KEY))
    counted = (here.select("i", "bin", "x", "w", "before").union(beside).groupBy(*_KEY)
               .cogroup(asked.groupBy(*_KEY)).applyInPandas(_nearer, "i int, c string, x double, w long, m long"))
    m = counted.groupBy("i", "c", "x", "w").agg(F.sum("m").alias("m"))
    psi = F.pandas_udf(lambda s: pd.Series(digamma(s.to_numpy())), "double")
    near = F.least(F.lit(k), F.col("nc") - 1).cast("double")
    term = psi(near) - psi(F.col("nc").cast("double"))
    per = m.join(classes, "c").select("i", "w", (term - psi(F.col("m").cast("double"))).alias("t"))
    names = F.array(*[F.lit(c) for c in usable])
    whole = float(digamma(np.array([float(n)]))[0])
    mi = F.greatest(F.lit(0.0), F.lit(whole) + F.sum(F.col("w") * F.col("t")) / F.sum("w"))
    return (per.groupBy("i").agg(mi.alias("mi")).select(F.get(names, F.col("i")).alias("column"), "mi")
            .orderBy(F.round("mi", 10).desc(), "column").limit(top))
