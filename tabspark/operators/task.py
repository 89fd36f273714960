"""Task detection: six rules vote classification or regression per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabspark.config import EngineConfig
from tabspark.functions.expr import (
    FLOAT_TYPES, INTEGER_TYPES, as_text, col, dtype_of, normalise, present,
)
from tabspark.operators.valuecounts import distinct_counts

CLF, REG = "classification", "regression"


# Size (as a power of two) and error of a sketch of distinct values; it settles a count that is so many errors away from
# every limit, and not a small one.
_SKETCH_SIZE, _SKETCH, _ERRORS, _SMALL = 14, 0.01, 6, 1_000


def _settled_counts(df: DataFrame, targets: list[str], config: EngineConfig) -> dict[str, int]:
    """About how many distinct values a target has, where every rule decides the same anywhere near that number.

    One pass with mergeable sketches. Targets near a limit of a rule, or with few
    values, are left out: they have to be counted, which is cheap for few values.
    """
    limits = (config.unique_ratio_threshold, 0.3, 0.5, 0.8)
    aggs = []
    for i, t in enumerate(targets):
        v = present(col(t), dtype_of(df, t))
        sketch = F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), F.lit(_SKETCH_SIZE))
        aggs += [F.count(v).alias(f"n{i}"), F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).alias(f"u{i}")]
    row, out = df.agg(*aggs).first(), {}
    for i, t in enumerate(targets):
        n, u = row[f"n{i}"], row[f"u{i}"]
        low, high = u / (1 + _ERRORS * _SKETCH), u / (1 - _ERRORS * _SKETCH)
        if low > max(_SMALL, config.max_unique_for_classification) and all(low > x * n or high < x * n for x in limits):
            out[t] = min(u, n)
    return out


def target_profile(df: DataFrame, targets: list[str], settled: dict[str, int] | None = None) -> DataFrame:
    """One row per target: n, n_present, n_unique, type family, zero-one flag.

    An integer column with missing values counts as floating point, and a
    boolean one as text, because that is how a single missing marker types them.
    n_unique is exact but for the targets in ``settled``.
    """
    settled = settled or {}
    rest = [t for t in targets if t not in settled]
    distinct = df.sparkSession.createDataFrame(list(settled.items()), "column string, n_unique long")
    if rest:
        exact = distinct_counts(normalise(df, rest), rest).select("column", "n_unique")
        distinct = distinct.union(exact) if settled else exact
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, t in enumerate(targets):
        dt = dtype_of(df, t)
        v = present(col(t), dt)
        aggs.append(F.count(v).alias(f"c{i}"))
        if isinstance(dt, INTEGER_TYPES + FLOAT_TYPES + (T.DecimalType,)):
            aggs.append(F.count(F.when(v.isin(0, 1), True)).alias(f"z{i}"))
        elif isinstance(dt, T.BooleanType):
            aggs.append(F.count(v).alias(f"z{i}"))
        else:
            aggs.append(F.lit(-1).cast("long").alias(f"z{i}"))  # text is never zero or one
    for i, t in enumerate(targets):
        dt = dtype_of(df, t)
        whole = F.col(f"c{i}") == F.col("n")
        if isinstance(dt, T.BooleanType):
            kind = F.when(whole, "bool").otherwise("text")
        elif isinstance(dt, T.StringType):
            kind = F.lit("text")
        elif isinstance(dt, (T.LongType, T.IntegerType)):
            kind = F.when(whole, "int").otherwise("float")
        elif isinstance(dt, (T.ByteType, T.ShortType)):
            kind = F.when(whole, "smallint").otherwise("float")
        elif isinstance(dt, FLOAT_TYPES + (T.DecimalType,)):
            kind = F.lit("float")
        else:
            kind = F.lit("other")
        rows.append(F.struct(F.lit(t).alias("column"), F.lit(dt.simpleString()).alias("dtype"),
                             kind.alias("kind"), F.col("n").alias("n"),
                             F.col(f"c{i}").alias("n_present"),
                             (F.col(f"z{i}") == F.col(f"c{i}")).alias("zero_one")))
    wide = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    # Both sides hold one row per target column.
    return wide.join(F.broadcast(distinct.select("column", "n_unique")), "column", "left").fillna({"n_unique": 0})


def _votes(config: EngineConfig) -> list[tuple[str, Column]]:
    kind, unique, total = F.col("kind"), F.col("n_unique"), F.col("n_present")
    ratio = unique / F.nullif(total, F.lit(0))

    def vote(task: str, confidence: float) -> Column:
        return F.struct(F.lit(task).alias("task"), F.lit(confidence).alias("confidence"))

    limit = config.max_unique_for_classification
    # The confidence of every rule.
    return [
        ("data_type", F.when(kind == "text", vote(CLF, 0.95)).when(kind == "bool", vote(CLF, 0.99))),
        ("binary", F.when(F.col("zero_one") | (total == 0), vote(CLF, 0.99)).when(unique == 2, vote(CLF, 0.90))),
        ("unique_count", F.when((unique <= 10) & (total > 20) & (ratio < 0.3), vote(CLF, 0.95))
         .when(unique <= limit, vote(CLF, 0.80)).otherwise(vote(REG, 0.75))),
        ("unique_ratio", F.when(ratio < config.unique_ratio_threshold, vote(CLF, 0.85))
         .when(ratio > 0.5, vote(REG, 0.80))),
        ("integer_pattern", F.when(kind.isin("int", "smallint") & (unique < 20), vote(CLF, 0.70))),
        ("continuous", F.when(kind.isin("int", "float") & (ratio > 0.8), vote(REG, 0.95))
         .when((kind == "int") & (ratio > 0.5), vote(REG, 0.90))),
    ]


def _votes_cast(config: EngineConfig) -> Column:
    """The list of (rule, vote) of the rules that vote."""
    cast = F.array(*[F.struct(F.lit(name).alias("rule"), v.alias("vote")) for name, v in _votes(config)])
    return F.filter(cast, lambda x: x["vote"].isNotNull())


def detect_rules(df: DataFrame, targets: list[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """(column, rule, task, confidence) for every rule that votes."""
    return (target_profile(df, targets, _settled_counts(df, targets, config)).select("column", F.explode(_votes_cast(config)).alias("v"))
            .select("column", "v.rule", "v.vote.task", "v.vote.confidence"))


def _with_verdict(df: DataFrame, targets: list[str], config: EngineConfig, settled: dict[str, int] | None = None) -> DataFrame:
    """Adds task and confidence: the greater sum decides, the winner's mean is the confidence."""
    def tally(task: str) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
        return F.aggregate("votes", start, lambda acc, x: F.when(
            x["vote"]["task"] == task,
            F.struct((acc["sum"] + x["vote"]["confidence"]).alias("sum"), (acc["n"] + 1).alias("n"))).otherwise(acc))

    clf, reg = F.col("_clf"), F.col("_reg")
    wins = clf["sum"] > reg["sum"]
    return (target_profile(df, targets, settled).select("*", _votes_cast(config).alias("votes"))
            .select("*", tally(CLF).alias("_clf"), tally(REG).alias("_reg"))
            .select("*", F.when(wins, CLF).otherwise(REG).alias("task"),
                    F.when(wins, clf["sum"] / clf["n"]).otherwise(reg["sum"] / reg["n"]).alias("confidence")))


def detect_task(df: DataFrame, targets: list[str], override: str | None = None,
                config: EngineConfig = EngineConfig()) -> DataFrame:
    """(column, task, confidence, needs_review): sums of confidences decide, ties go to regression."""
    if override is not None:
        if override not in (CLF, REG):
            raise ValueError("Override must be 'classification' or 'regression'")
        names = F.explode(F.array(*[F.lit(t) for t in targets])).alias("column")
        return (df.limit(0).agg(F.count(F.lit(1))).select(names)
                .select("column", F.lit(override).alias("task"), F.lit(1.0).alias("confidence"),
                        F.lit(False).alias("needs_review")))
    return (_with_verdict(df, targets, config, _settled_counts(df, targets, config)).select("column", "task", "confidence")
            .withColumn("needs_review", F.col("confidence") < 0.70))


def detect_details(df: DataFrame, targets: list[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    total = F.col("n_present")
    return _with_verdict(df, targets, config).select(
        "column", "task", "confidence",
        F.col("n").alias("n_samples"), "n_unique",
        F.coalesce(F.col("n_unique") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("unique_ratio"),
        "dtype", (F.col("n") - total).alias("null_count"),
        F.coalesce((F.col("n") - total) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("null_ratio"))


def sample_values(df: DataFrame, target: str, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first present values of a target, in key order when a key is given."""
    v = present(col(target), dtype_of(df, target))
    rows = df.filter(v.isNotNull())
    rows = rows.orderBy(*order_by) if order_by else rows
    return rows.select(as_text(v, dtype_of(df, target)).alias("sample_value")).limit(n)
