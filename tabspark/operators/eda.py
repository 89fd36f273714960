"""Aggregates behind exploratory analysis; every result is small."""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabspark.config import EngineConfig
from tabspark.functions.expr import categorical_columns, col, dtype_of, numeric_columns, present
from tabspark.functions.rank import column_ranges, exact_quantiles
from tabspark.operators.encode import scaled
from tabspark.operators.gram import pair_sums
from tabspark.operators.quality import missing_severity, nulls_by_column
from tabspark.operators.valuecounts import value_counts

_QUARTILES = [0.25, 0.5, 0.75]
# Pairs of columns that one plain aggregate holds: keeps the generated plan small.
_PAIRS_PER_PASS = 120


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x) rows of the present numeric values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _number(df, c).alias("x")) for c in columns])
    return (df.select(F.explode(pairs).alias("p")).select("p.column", "p.x").filter(F.col("x").isNotNull()))


def _ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, lo, hi, n): one row per column; a constant column is widened by 0.5 each side."""
    lo, hi = F.min("x"), F.max("x")
    return _long(df, columns).groupBy("column").agg(
        F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"),
        F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """(column, bin, bin_start, bin_end, n, density): equal widths, last bin closed, empty bins kept."""
    ranges = _ranges(df, columns)
    width = (F.col("hi") - F.col("lo")) / bins
    binned = (_long(df, columns).join(F.broadcast(ranges), "column")
              .select("column", F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                                        F.lit(bins - 1).cast("long")).alias("bin"))
              .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("c")))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    n = F.coalesce("c", F.lit(0).cast("long"))
    # Both sides hold columns x bins rows.
    return grid.join(F.broadcast(binned), ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"), n.alias("n"),
        (n / (F.col("n") * width)).alias("density"))


def kde(df: DataFrame, column: str, points: int = 1000, resolution: int = 2048) -> DataFrame:
    """(point, x, density): Gaussian density with Scott's bandwidth, for more than ten values.

    Rows are first counted into a fixed fine grid spanning the data, so the
    kernel sum works on at most ``resolution`` weighted centres per point
    whatever the table size. Cell means, not mid-points, are the centres.
    """
    long = _long(df, [column]).select("x")
    s = long.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                 F.stddev_samp("x").alias("sd")).first()
    empty = df.sparkSession.createDataFrame([], "point long, x double, density double")
    if s["n"] <= 10 or not s["sd"]:
        return empty
    h = s["sd"] * s["n"] ** -0.2
    lo, hi, n = s["lo"], s["hi"], s["n"]
    span = hi - lo
    cell = F.least(F.floor((F.col("x") - lo) / F.lit(span) * resolution), F.lit(resolution - 1).cast("long"))
    centres = long.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("w"), F.avg("x").alias("m"))
    # At most ``resolution`` entries by construction.
    packed = centres.agg(F.sort_array(F.collect_list(F.struct("cell", "w", "m"))).alias("cs"))
    start, step = lo - span / 2, 2 * span / (points - 1)
    x = F.lit(start) + F.col("point") * F.lit(step)
    z = lambda c: (F.col("x") - c["m"]) / F.lit(h)
    total = F.aggregate("cs", F.lit(0.0), lambda acc, c: acc + c["w"] * F.exp(z(c) * z(c) * -0.5))
    return (packed.select("cs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("point"))
            .withColumn("x", x)
            .select("point", "x", (total / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density")))


def center_stats(df: DataFrame, columns: list[str], config: EngineConfig = EngineConfig(),
                 quartiles: dict[str, list[float | None]] | None = None) -> DataFrame:
    """(column, mean, median) with the exact median, which known ``quartiles`` of the columns hold already."""
    medians = {c: q[1:2] for c, q in quartiles.items()} if quartiles else exact_quantiles(df, columns, [0.5], config)
    rows = [F.struct(F.lit(c).alias("column"), F.avg(present(col(c), dtype_of(df, c)).cast("double")).alias("mean"),
                     F.lit(medians[c][0]).cast("double").alias("median")) for c in columns]
    return df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def top_categories(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(column, value, cnt, rank, n_shown, n_categories): the most frequent values per column.

    The rank filter lets Spark keep ``top`` rows per column in every task before
    the ranking shuffle, so columns with many values do not fill one task.
    """
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    w = Window.partitionBy("column").orderBy(F.col("cnt").desc(), "value")
    ranked = (counts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top))
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_categories"))
    return (ranked.join(F.broadcast(totals), "column")
            .withColumn("n_shown", F.least(F.lit(top).cast("long"), F.col("n_categories")))
            .select("column", "value", "cnt", "rank", "n_shown", "n_categories"))


def iqr_outliers(df: DataFrame, columns: list[str], config: EngineConfig = EngineConfig(),
                 quartiles: dict[str, list[float | None]] | None = None) -> DataFrame:
    """(column, outlier_pct, severity) for columns with values beyond 1.5 interquartile ranges."""
    q = {c: [x[0], x[2]] for c, x in quartiles.items()} if quartiles else exact_quantiles(df, columns, [0.25, 0.75], config)
    aggs = [F.count(F.lit(1)).alias("n")]
    usable = [c for c in columns if q[c][0] is not None]
    for i, c in enumerate(usable):
        lo, hi = q[c]
        v, reach = present(col(c), dtype_of(df, c)).cast("double"), 1.5 * (hi - lo)
        aggs.append(F.count(F.when((v < lo - reach) | (v > hi + reach), True)).alias(f"o{i}"))
    pct = F.col("outlier_pct")
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"o{i}") * 100.0 / F.col("n")).alias("outlier_pct"))
                     for i, c in enumerate(usable)])
    return (df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").filter(pct > 0)
            .withColumn("severity", F.when(pct > 10, "high").when(pct > 5, "medium").otherwise("low")))


def _number(df: DataFrame, c: str) -> Column:
    return present(col(c), dtype_of(df, c)).cast("double")


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_a, column_b, r) for every pair a before b, over rows where both are present.

    A first pass gives means and deviations; the columns enter the second
    standardised. Few pairs are plain sums: one per pair without missing values,
    six otherwise. Wide tables use one matrix of products over all columns.
    """
    columns = columns or numeric_columns(df)
    pairs = list(itertools.combinations(range(len(columns)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")
    stats = column_ranges(df, columns)
    whole = {i for i in range(len(columns)) if stats[f"c{i}"] == stats["n"]}
    if len(pairs) > _PAIRS_PER_PASS:
        dense = stats["n"] and len(whole) == len(columns)
        return _correlation_dense(df, columns) if dense else _correlation_holed(df, columns, stats)
    varies = {i for i in range(len(columns)) if stats[f"s{i}"]}
    values = df.select([scaled(_number(df, c), stats[f"m{i}"], stats[f"s{i}"]).alias(f"z{i}")
                        for i, c in enumerate(columns)])
    aggs, rows = [], []
    for i, j in pairs:
        a, b, k = F.col(f"z{i}"), F.col(f"z{j}"), f"{i}_{j}"
        if i not in varies or j not in varies:
            r = F.lit(None).cast("double")
        elif i in whole and j in whole:
            aggs.append(F.avg(a * b).alias(f"xy{k}"))
            r = F.col(f"xy{k}")
        else:
            both = a.isNotNull() & b.isNotNull()
            aggs += [F.count(F.when(both, True)).alias(f"n{k}"), F.sum(F.when(both, a)).alias(f"x{k}"),
                     F.sum(F.when(both, b)).alias(f"y{k}"), F.sum(F.when(both, a * a)).alias(f"xx{k}"),
                     F.sum(F.when(both, b * b)).alias(f"yy{k}"), F.sum(a * b).alias(f"xy{k}")]
            r = _pearson(*(F.col(f"{p}{k}") for p in ("n", "x", "y", "xx", "yy", "xy")))
        rows.append(F.struct(F.lit(columns[i]).alias("column_a"), F.lit(columns[j]).alias("column_b"), r.alias("r")))
    sums = values.agg(*aggs) if aggs else values.limit(0).agg(F.count(F.lit(1)))
    return sums.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def _pearson(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """r from sums of standardised values; null where a side hardly varies."""
    spread = (n * xx - x * x) * (n * yy - y * y)
    return F.when(spread > 1e-12 * n * n, (n * xy - x * y) / F.sqrt(spread))


def _correlation_holed(df: DataFrame, columns: list[str], stats: dict, diagonal: bool = False) -> DataFrame:
    """The pairs of a wide table with missing values: one scan, whatever the number of columns."""
    if not stats["n"]:
        pick = itertools.combinations_with_replacement if diagonal else itertools.combinations
        return df.sparkSession.createDataFrame([(a, b, None) for a, b in pick(columns, 2)], "column_a string, column_b string, r double")
    z = [scaled(_number(df, c), stats[f"m{i}"], stats[f"s{i}"]) for i, c in enumerate(columns)]
    names = F.array(*[F.lit(c) for c in columns])
    constant = F.array(*[F.lit(not stats[f"s{i}"]) for i in range(len(columns))])
    r = F.when(~F.get(constant, F.col("i")) & ~F.get(constant, F.col("j")), _pearson(*map(F.col, ("n", "x", "y", "xx", "yy", "xy"))))
    return pair_sums(df, z, diagonal).select(
        F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"), r.alias("r"))


def _correlation_dense(df: DataFrame, columns: list[str]) -> DataFrame:
    vectors = df.select(array_to_vector(F.array(*[_number(df, c) for c in columns])).alias("features"))
    matrix = Correlation.corr(vectors, "features").first()[0].toArray()
    rows = [(a, b, float(matrix[i, j])) for (i, a), (j, b) in itertools.combinations(enumerate(columns), 2)]
    out = df.sparkSession.createDataFrame(rows, "column_a string, column_b string, r double")
    return out.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Both triangles and the diagonal, as (column_a, column_b, r)."""
    columns = columns or numeric_columns(df)
    sides = F.array(F.struct("column_a", "column_b", "r"),
                    F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r"))
    if len(columns) * (len(columns) - 1) // 2 > _PAIRS_PER_PASS:
        stats = column_ranges(df, columns)
        if not stats["n"] or any(stats[f"c{i}"] < stats["n"] for i in range(len(columns))):
            found = _correlation_holed(df, columns, stats, diagonal=True)
            same = F.col("column_a") == F.col("column_b")
            own = F.array(F.struct("column_a", "column_b", F.when(F.col("r").isNotNull(), 1.0).alias("r")))
            return found.select(F.explode(F.when(same, own).otherwise(sides)).alias("p")).select("p.*")
    both = correlation_pairs(df, columns).select(F.explode(sides).alias("p")).select("p.*")
    diagonal = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column_a"), F.lit(c).alias("column_b"),
                 F.when(F.var_pop(_number(df, c)) > 0, F.lit(1.0)).alias("r")) for c in columns]).alias("d")
    ).select(F.explode("d").alias("p")).select("p.*")
    return both.unionByName(diagonal)


def top_correlated(df: DataFrame, columns: list[str] | None = None, top: int = 20) -> DataFrame:
    """Strongest pairs by |r| with their band (0.7 strong, 0.4 moderate)."""
    size = F.abs(F.col("r"))
    return (correlation_pairs(df, columns).filter(F.col("r").isNotNull())
            .orderBy(F.round(size, 10).desc(), "column_a", "column_b").limit(top)
            .withColumn("r", F.round("r", 4))
            .withColumn("band", F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").otherwise("weak")))


def multicollinear(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.85) -> DataFrame:
    """Pairs per band, and how many reach the multicollinearity threshold."""
    size = F.abs(F.round("r", 4))
    return correlation_pairs(df, columns).agg(
        F.count(F.when(size >= threshold, True)).alias("n_multicollinear"),
        F.count(F.when(size >= 0.7, True)).alias("n_strong"),
        F.count(F.when((size >= 0.4) & (size < 0.7), True)).alias("n_moderate"),
        F.count(F.when(size < 0.4, True)).alias("n_weak"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, n, pct) over the present targets."""
    counts = value_counts(df, [target]).filter(F.col("value").isNotNull())
    total = counts.agg(F.sum("cnt")).scalar()
    return counts.select(F.col("value").alias("class"), F.col("cnt").alias("n"),
                         (F.col("cnt") * 100.0 / total).alias("pct"))


def class_statistics(df: DataFrame, target: str) -> DataFrame:
    """Total (missing included), classes, majority and minority share, balance ratio."""
    cnt = F.when(F.col("value").isNotNull(), F.col("cnt"))
    # Ties for the majority go to the smallest class.
    order = F.when(F.col("value").isNotNull(), F.struct(-F.col("cnt"), F.col("value")))
    return value_counts(df, [target]).agg(
        F.sum("cnt").alias("n"), F.count("value").alias("n_classes"), F.min_by("value", order).alias("first"),
        F.max(cnt).alias("top"), F.min(cnt).alias("low")).select(
        F.col("n").alias("n_rows"), "n_classes", F.col("first").alias("majority_class"),
        (F.col("top") * 100.0 / F.col("n")).alias("majority_pct"),
        (F.col("low") * 100.0 / F.col("n")).alias("minority_pct"),
        (F.col("top") / F.col("low")).alias("balance_ratio"))


def mutual_information(df: DataFrame, columns: list[str], target: str, top: int = 10, bins: int = 10,
                       config: EngineConfig = EngineConfig(),
                       quartiles: dict[str, list[float | None]] | None = None) -> DataFrame:
    """(column, mi): information between decile-binned features and the class, most informative first.

    Missing features take the median and rows without a class are left out.
    Deciles are literals, so binning is row-local and the joint counts are the
    only shuffle: columns x bins x classes rows.
    """
    present_rows = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(_number(df, c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    holed = [c for i, c in enumerate(columns) if present_rows[f"c{i}"] < present_rows["n"]]
    medians = {c: None for c in columns}
    medians |= {c: quartiles[c][1] for c in holed} if quartiles else {c: q[0] for c, q in exact_quantiles(df, holed, [0.5], config).items()}
    target_text = present(col(target), dtype_of(df, target)).cast("string")
    filled = df.select(target_text.alias("_class"), *[
        F.coalesce(_number(df, c), F.lit(medians[c])).alias(c) for c in columns]).filter(F.col("_class").isNotNull())
    edges = exact_quantiles(filled, columns, [i / bins for i in range(1, bins)], config)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), reduce(
        lambda a, b: a + b, [(col(c) > F.lit(e)).cast("int") for e in edges[c]]).alias("bin")) for c in columns])
    joint = (filled.select(F.explode(cells).alias("p"), "_class")
             .groupBy("p.column", "p.bin", "_class").agg(F.count(F.lit(1)).alias("n")))
    # From here on: columns x bins x classes rows.
    by_bin = Window.partitionBy("column", "bin")
    by_class = Window.partitionBy("column", "_class")
    by_col = Window.partitionBy("column")
    n, total = F.col("n"), F.sum("n").over(by_col)
    term = (n / total) * F.log(n * total / (F.sum("n").over(by_bin) * F.sum("n").over(by_class)))
    return (joint.select("column", term.alias("t")).groupBy("column").agg(F.sum("t").alias("mi"))
            .orderBy(F.round("mi", 10).desc(), "column").limit(top))


def target_histogram(df: DataFrame, target: str, bins: int = 50) -> DataFrame:
    return histogram(df, [target], bins).drop("column")


def target_statistics(df: DataFrame, target: str, config: EngineConfig = EngineConfig(),
                      quartiles: dict[str, list[float | None]] | None = None) -> DataFrame:
    """Moments and quartiles; skewness and excess kurtosis are bias-corrected."""
    q = (quartiles or exact_quantiles(df, [target], _QUARTILES, config))[target]
    v = _number(df, target)
    n, g1, g2 = F.col("count").cast("double"), F.col("g1"), F.col("g2")
    row = df.select(v.alias("x")).agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"))
    return row.select(
        "count", "mean", F.lit(q[1]).cast("double").alias("median"), "std", "min",
        F.lit(q[0]).cast("double").alias("q25"), F.lit(q[2]).cast("double").alias("q75"), "max",
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"))


def target_correlation(df: DataFrame, columns: list[str], target: str, top: int = 10) -> DataFrame:
    """(column, abs_r): features most correlated with a numeric target."""
    values = df.select(_number(df, target).alias("y"), *[_number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    def size(x: str) -> Column:
        """Null where one side is constant (F.corr divides by zero there)."""
        both = [F.when(F.col(b).isNotNull(), F.col(a)) for a, b in ((x, "y"), ("y", x))]
        return F.abs(F.try_divide(F.covar_pop(x, "y"), F.stddev_pop(both[0]) * F.stddev_pop(both[1])))

    row = values.agg(*[size(f"v{i}").alias(f"r{i}") for i in range(len(columns))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("abs_r")) for i, c in enumerate(columns)])
    return (row.select(F.explode(rows).alias("p")).select("p.*").filter(F.col("abs_r").isNotNull())
            .orderBy(F.round("abs_r", 10).desc(), "column").limit(top))


def profile(df: DataFrame, target: str, task: str, config: EngineConfig = EngineConfig()) -> dict[str, DataFrame]:
    """All exploratory tables of one input. Persist ``df`` first if it is costly to read.

    The quartiles of all columns are searched once and serve every table that asks for one of them.
    """
    features = df.drop(target)
    numeric, text = numeric_columns(features), categorical_columns(features)
    quartiles = exact_quantiles(df, numeric if task == "classification" else [*numeric, target], _QUARTILES, config)
    out = {"missing": nulls_by_column(features), "missing_severity": missing_severity(features)}
    if numeric:
        out |= {"histograms": histogram(features, numeric), "centers": center_stats(features, numeric, config, quartiles),
                "outliers": iqr_outliers(features, numeric, config, quartiles), "correlation": correlation_matrix(features, numeric),
                "top_pairs": top_correlated(features, numeric)}
    if text:
        out["top_categories"] = top_categories(features, text)
    if task == "classification":
        out |= {"class_distribution": class_distribution(df, target), "class_statistics": class_statistics(df, target)}
        if numeric:
            out["mutual_information"] = mutual_information(df, numeric, target, config=config, quartiles=quartiles)
    else:
        out |= {"target_histogram": target_histogram(df, target), "target_statistics": target_statistics(df, target, config, quartiles),
                "target_density": kde(df, target)}
        if numeric:
            out["target_correlation"] = target_correlation(df, numeric, target)
    return out
