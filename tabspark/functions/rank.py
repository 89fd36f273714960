"""Exact order statistics without a global sort.

A window without partition keys runs in one task, and ``percentile`` keeps one
buffer entry per distinct value. Neither survives a large table, so the
functions here narrow the search with aggregates that are combined on the map
side until the remaining rows are few.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabspark.config import EngineConfig
from tabspark.functions.expr import col, dtype_of, present

# Brackets of so many rows or fewer are counted value by value.
_FEW = 20_000
# Equal cells of a bracket; before there is one, a cell spans this share of an octave of the values' size.
_ACCURACY, _NEAR = 4_096, 1 / 64
# Columns up to which each has aggregates of its own.
_WIDE = 20


def column_ranges(df: DataFrame, columns: list[str]) -> dict:
    """Rows, and per column its present rows, extremes, mean and population deviation: one aggregate.

    Many columns are aggregated in long form, so that the plan stays small.
    """
    def moments(v: Column) -> list[Column]:
        return [F.count(v), F.min(v), F.max(v), F.avg(v), F.stddev_pop(v)]

    kinds = ("c", "lo", "hi", "m", "s")
    values = [present(col(c), dtype_of(df, c)).cast("double") for c in columns]
    if len(columns) <= _WIDE:
        named = df.select([v.alias(f"v{i}") for i, v in enumerate(values)])
        aggs = [a.alias(f"{k}{i}") for i in range(len(columns)) for k, a in zip(kinds, moments(F.col(f"v{i}")))]
        return named.agg(F.count(F.lit(1)).alias("n"), *aggs).first().asDict()
    # the number -1 stands for the row itself
    long = df.select(F.posexplode(F.array(F.lit(0.0), *values)).alias("p", "v")).groupBy((F.col("p") - 1).alias("i"))
    rows = {r["i"]: r for r in long.agg(*[a.alias(k) for k, a in zip(kinds, moments(F.col("v")))]).collect()}  # one per column
    out = {"n": rows[-1]["c"] if rows else 0}
    for i in range(len(columns)):
        out |= {f"{k}{i}": rows[i][k] if rows else (0 if k == "c" else None) for k in kinds}
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                    config: EngineConfig = EngineConfig()) -> dict[str, list[float | None]]:
    """Interpolated quantiles of every column, exactly, as plain numbers.

    All columns and ranks are searched together in long form (column, value): each
    pass counts the values' cells, keeps the cell that holds a rank, and narrows
    the next pass to the values in it. The plan does not grow with the number of
    ranks, and every count is combined on the map side.
    """
    if not columns:
        return {}
    asked = sorted(set(probabilities))
    totals, found = _values_at_ranks(long_values(df, columns), asked)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = []
        for p in probabilities:
            if i not in totals:
                out[c].append(None)
                continue
            position = p * (totals[i] - 1)
            low, high = found[(i, math.floor(position))], found[(i, math.ceil(position))]
            # equal ends, infinite ones too, need no interpolation
            out[c].append(low if low == high else low + (high - low) * (position - math.floor(position)))
    return out


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, v): number of the column and each of its present values, as a double."""
    values = F.array(*[present(col(c), dtype_of(df, c)).cast("double") for c in columns])
    return df.select(F.posexplode(values).alias("i", "v")).where("v IS NOT NULL")


def _size_cell(v: Column) -> Column:
    """Small shares of an octave, in the order of the values; zero and the infinities have cells of their own."""
    octave = F.least(F.log2(F.abs(v)), F.lit(1_200.0)) + 1_100.0  # doubles reach from octave -1,074 to 1,023
    size = F.floor(octave / _NEAR).cast("int")
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def _equal_cell(v: Column, low: Column, high: Column) -> Column:
    """Equal cells between two values of one sign and nearly one size; the greatest value has its own."""
    return F.when(v >= high, F.lit(_ACCURACY)).otherwise(
        F.least(F.floor((v - low) / (high - low) * _ACCURACY), F.lit(_ACCURACY - 1))).cast("double")


def _values_at_ranks(values: DataFrame, probabilities: list[float]) -> tuple[dict, dict]:
    """{column: present rows} and {(column, zero-based rank): value} for the ranks next to each probability.

    A bracket is two values of a column with the rows below it and in it. Its
    ends are the least and greatest value of a cell, so a pass ends with one
    value, or with the cell cut in at least two.
    """
    spark = values.sparkSession
    order = Window.partitionBy("i", "b").orderBy("cell")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("i", "b")

    def counted(rows: DataFrame, cell: Column) -> DataFrame:
        cells = rows.groupBy("i", "b", cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        return cells.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))

    first = counted(values.withColumn("b", F.lit(0)), _size_cell(F.col("v")))
    position = lambda p: F.lit(p) * (F.col("total") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(position(p)), F.ceil(position(p))) for p in probabilities])))
    hits = (first.withColumn("rank", F.explode(F.filter(ranks, lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))))
            .select("i", "rank", "low", "high", (F.col("upto") - F.col("n")).alias("below"), "n", "total").collect())
    totals, found, open_ = {}, {}, {}
    for r in hits:
        totals[r["i"]] = r["total"]
        open_[(r["i"], r["rank"])] = (r["low"], r["high"], r["below"], r["n"])
    while True:
        for key, (low, high, _, _) in list(open_.items()):
            if low == high:
                found[key] = low
                del open_[key]
        if not open_:
            return totals, found
        brackets = sorted({(key[0], *s) for key, s in open_.items()})
        number = {x: b for b, x in enumerate(brackets)}
        # one row per open bracket: as many as ranks were asked for at most
        table = spark.createDataFrame([(x[0], b, x[1], x[2], x[3], x[4] <= _FEW) for b, x in enumerate(brackets)],
                                      "bi int, b int, lo double, hi double, below long, few boolean")
        asks = spark.createDataFrame([(number[(i, *s)], rank) for (i, rank), s in open_.items()], "ab int, rank long")
        inside = values.join(F.broadcast(table), (F.col("i") == F.col("bi")) & F.col("v").between(F.col("lo"), F.col("hi")))
        # where few values are left, each is a cell
        cells = counted(inside, F.when(F.col("few"), F.col("v")).otherwise(_equal_cell(F.col("v"), F.col("lo"), F.col("hi"))))
        below = F.col("below") + F.col("upto") - F.col("n")
        hits = (cells.join(F.broadcast(table.select("b", "below")), "b").join(F.broadcast(asks), F.col("b") == F.col("ab"))
                .where((F.col("rank") >= below) & (F.col("rank") < below + F.col("n")))
                .select("i", "rank", "low", "high", below.alias("below"), "n").collect())
        for r in hits:
            open_[(r["i"], r["rank"])] = (r["low"], r["high"], r["below"], r["n"])


def hash_order(key: Column, seed: int) -> Column:
    """Portable pseudo-random order: MD5 of seed and key, as hex text."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def position_cuts(df: DataFrame, group: Column, position: Column, hex_digits: int, cuts,
                  config: EngineConfig = EngineConfig()) -> dict:
    """Positions that cut every group at given ranks, found by counting.

    ``position`` is text that starts with ``hex_digits`` uniform hex digits;
    ``cuts(n)`` gives the ranks (1-based, inclusive) for a group of ``n`` rows.
    Returns ``{group: [position or None, ...]}``: a row lies at or before cut
    ``j`` when its position is not greater. Each pass counts rows by a longer
    prefix of the position, so no group is ever sorted in one task: only the
    few rows that share the last prefix are. The number of groups must be
    bounded.
    """
    spark = df.sparkSession
    rows = df.select(group.cast("string").alias("g"), position.alias("pos"))
    step = depth = 3  # 4096 prefixes per pass
    w = Window.partitionBy("g").orderBy("p")
    counted = (rows.groupBy("g", F.substring("pos", 1, depth).alias("p")).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("upto", F.sum("n").over(w)).collect())  # groups x 4096 at most
    buckets: dict[str | None, list] = {}
    for r in counted:
        buckets.setdefault(r["g"], []).append((r["upto"], r["n"], r["p"]))
    out, open_ = {}, []
    for g, found in buckets.items():
        found.sort()
        ranks = cuts(found[-1][0])
        out[g] = [None] * len(ranks)
        for j, rank in enumerate(ranks):
            if rank > 0:
                upto, size, prefix = next(x for x in found if x[0] >= rank)
                open_.append((g, j, prefix, rank - (upto - size), size))
    while open_:
        asks = spark.createDataFrame(sorted({(o[0], o[2]) for o in open_}, key=str), "ag string, ap string")
        inside = rows.join(F.broadcast(asks), F.col("g").eqNullSafe(F.col("ag"))
                           & (F.substring("pos", 1, depth) == F.col("ap")))
        last = max(o[4] for o in open_) <= config.rank_bucket_rows or depth >= hex_digits
        # Rows with one position count as one entry: they cannot be told apart.
        depth += step
        part = F.col("pos") if last else F.substring("pos", 1, depth)
        w = Window.partitionBy("g", "ap").orderBy("p")
        ranked = (inside.groupBy("g", "ap", part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("upto", F.sum("n").over(w)))
        ranks = F.broadcast(spark.createDataFrame([(o[0], o[2], o[3], o[1]) for o in open_],
                                                  "rg string, rp string, rank long, j int"))
        hits = ranked.join(ranks, F.col("g").eqNullSafe(F.col("rg")) & (F.col("ap") == F.col("rp"))
                           & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).collect()
        if last:
            for r in hits:
                out[r["g"]][r["j"]] = r["p"]
            break
        open_ = [(r["g"], r["j"], r["p"], r["rank"] - (r["upto"] - r["n"]), r["n"]) for r in hits]
    return out


def running_before(df: DataFrame, groups: list[str], order: str, value: str, out: str,
                   rows: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows of a group with a smaller ``order``.

    ``df`` holds one row per (groups, order). The order column is cut into
    quantile bins of about ``rows`` rows, as many as their counted number asks
    for; bin totals give the offset, and a window inside each bin gives the rest,
    so no task sees more than one bin.
    """
    rows = rows or EngineConfig().rank_bucket_rows
    bins = -(-df.count() // rows)
    found = df.stat.approxQuantile(order, [i / bins for i in range(1, bins)], 1.0 / (4 * bins)) if bins > 1 else []
    splits = sorted({x for x in found if math.isfinite(x)})
    edges = [float("-inf"), *splits, float("inf")]
    binned = Bucketizer(splits=edges, inputCol=order, outputCol="_bin").transform(df) \
        if len(edges) > 2 else df.withColumn("_bin", F.lit(0.0))
    totals = binned.groupBy(*groups, "_bin").agg(F.sum(value).alias("_t"))
    upto = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_bin", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*groups, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (binned.join(offsets, [*groups, "_bin"])
            .withColumn(out, F.col("_off") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .drop("_bin", "_off"))
