"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabspark.session import scratch_path, shared_folder

#: What the word-based operators call a word: bytes.split() with no argument
#: splits a byte string at exactly 0x20 and 0x09-0x0D, and bytes.lower()
#: changes A-Z only.
#: Multiplier of the polynomial hashes and of the final mixing (fixed values).
HASH_BASE = 1099511628211
HASH_MIX = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage in a way that survives lost executors. The shuffle files
    behind ``df`` become free once the driver has dropped its plan, so both
    garbage collectors are asked to run.
    """
    spark = df.sparkSession
    shared_folder(spark)
    path, schema = scratch_path(spark, name), df.schema
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_by_count(rows: DataFrame, counts: DataFrame, keys: list[str], total: int, hot: int) -> DataFrame:
    """Inner join of ``rows`` with ``counts`` (keys, n, more columns), one row per key, without a hot partition.

    Keys of which one row in ``hot`` has the same are at most ``hot`` many; their
    rows are joined by broadcast, the others by shuffle. ``n`` counts the key's
    rows, ``total`` all rows.
    """
    key = F.xxhash64(*keys)
    often = [r[0] for r in counts.where(F.col("n") * hot >= total).select(key).collect()] if total > hot else []
    counts = counts.drop("n")
    if not often:
        return rows.join(counts, keys).select(*rows.columns, *[c for c in counts.columns if c not in keys])
    quick = rows.where(key.isin(often)).join(F.broadcast(counts.where(key.isin(often))), keys)
    slow = rows.where(~key.isin(often)).join(counts.where(~key.isin(often)), keys)
    names = [*rows.columns, *[c for c in counts.columns if c not in keys]]
    return quick.select(*names).union(slow.select(*names))


def join_salted(rows: DataFrame, counts: DataFrame, keys: list[str], total: int, hot: int, salts: int = 64) -> DataFrame:
    """As ``join_by_count``, for rows that are costly to compute: they are computed once.

    The rows of a hot key are spread over ``salts`` partitions by a hash of the
    whole row, and its row of ``counts`` is repeated for each.
    """
    key = F.xxhash64(*keys)
    often = [r[0] for r in counts.where(F.col("n") * hot >= total).select(key).collect()] if total > hot else []
    counts = counts.drop("n")
    names = [*rows.columns, *[c for c in counts.columns if c not in keys]]
    if not often:
        return rows.join(counts, keys).select(*names)
    is_hot = key.isin(often)
    one = F.lit(0).cast("long")
    rows = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(one))
    every = F.when(is_hot, F.sequence(one, F.lit(salts - 1).cast("long"))).otherwise(F.array(one))
    return rows.join(counts.withColumn("_salt", F.explode(every)), [*keys, "_salt"]).select(*names)


def hashed_sample(df: DataFrame, keys: list[str], total: int, rows: int) -> DataFrame:
    """About ``rows`` (if there are so many of ``total``) rows of ``df``, by the hash of their keys."""
    share = min(1.0, 1.1 * (rows + 100) / max(total, 1))
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) <= int(share * (1 << 30)))


def one_of_hot_texts(texts: DataFrame, copies: DataFrame, total: int, hot: int) -> DataFrame:
    """``texts`` (k1, k2, key, ...) with only one row of each text that one row in ``hot`` has.

    ``copies`` has (k1, k2, n, keep), keep being the key of the row that stays;
    rows with equal keys stay together.
    """
    often = copies.where((F.col("n") > 1) & (F.col("n") * hot >= total)).select("k1", "k2", F.col("keep").alias("_keep"))
    return (texts.join(F.broadcast(often), ["k1", "k2"], "left")
            .where(F.col("_keep").isNull() | (F.col("key") == F.col("_keep"))).drop("_keep", "key"))


#: Edges from which nodes with many neighbours are joined apart.
HUBS = 100_000


def components(edges: DataFrame, a: str, b: str, name: str = "components", hubs: int = HUBS, hot: int = 1_000) -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges.

    Alternates large-star and small-star steps until the edges are stars. Only
    nodes with an edge appear. Each step is written to the shared folder. Of more
    than ``hubs`` edges those of nodes that hold one in ``hot`` are joined by
    broadcast, so that no task gets a hub.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = stored(now, name), None

    def with_least(rows: DataFrame, total: int) -> DataFrame:
        low = rows.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
        return join_by_count(rows, low, ["u"], total, hot) if total > hubs else rows.join(low.drop("n"), "u")

    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the least of node and neighbours
        large = (with_least(both, 2 * mark[0]).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
                 .where("u > v").distinct())
        if mark[0] > hubs:
            large = stored(large, name)
        # small star: smaller neighbours and the node go to the least of them
        small = (with_least(large, mark[0]).select(F.explode(F.array("u", "v")).alias("x"), "m")
                 .where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct())
        now = stored(small, name)


def empty_if_missing(value):
    return b"" if value is None else value
