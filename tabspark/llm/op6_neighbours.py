"""Approximate nearest neighbours by largest inner product: inverted lists and adaptive dimension scans."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabspark.llm.common import hashed_sample, stored, table
from tabspark.llm.registry import query

#: Rows (and bytes) the lists and the number of probes are learned from; every row is indexed.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
#: Rows of a list, and queries, that one task compares at a time.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 8_192
MOST_LISTS = 1_024


@dataclass
class Index:
    """Rotation and list centres in the space where the largest inner product is the nearest point.

    A vector x becomes (x, sqrt(bound - |x|^2)), a query q becomes (q, 0).
    """
    bound: float
    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def points(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.bound - (x * x).sum(1), 0.0))
        return np.column_stack([x, last]) @ self.rotation

    def query_points(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation

    def distances(self, p: np.ndarray) -> np.ndarray:
        return (self.centres * self.centres).sum(1) - 2.0 * (p @ self.centres.T)

    def nearest(self, p: np.ndarray) -> np.ndarray:
        return np.concatenate([self.distances(p[a:a + 8192]).argmin(1) for a in range(0, len(p), 8192)] or [np.zeros(0, int)])


def learn_index(sample: np.ndarray, rows: int, bound: float, k: int, recall: float = 0.97, seed: int = 42) -> Index:
    """Lists by Lloyd's steps on the sample; as many probes as find ``recall`` of its own neighbours."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    index = Index(bound, rotation, np.zeros((1, d)), 1)
    points = index.points(sample)
    lists = 1 if rows <= 2_000 else int(min(MOST_LISTS, max(1, len(sample) // 8), round(rows**0.5)))
    index.centres = points[rng.choice(len(points), lists, replace=False)]
    for _ in range(8 if lists > 1 else 1):
        own = index.nearest(points)
        size = np.bincount(own, minlength=lists)
        total = np.zeros((lists, d))
        np.add.at(total, own, points)
        index.centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], index.centres)
    own = index.nearest(points)
    asked = sample[rng.choice(len(sample), min(200, len(sample)), replace=False)]
    near = np.argsort(-(asked @ sample.T), 1, kind="stable")[:, :k + 1]
    order = np.argsort(index.distances(index.query_points(asked)), 1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], 1)
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    index.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return index


def scan(index: Index, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
         columns: int = 16, slack: float = 2.1) -> pd.DataFrame:
    """The k best rows for each query.

    Partial distances over blocks of rotated columns estimate the whole one; a
    row is given up as soon as the estimate passes the k-th distance found so
    far by more than the test allows (``slack`` standard deviations).
    """
    points = index.points(vectors)
    asked = index.query_points(queries)
    d = points.shape[1]
    out = []
    for q, (qid, vector, point) in enumerate(zip(query_ids, queries, asked)):
        best_score, best_id = np.zeros(0), np.zeros(0, np.int64)
        limit, norm = np.inf, float(vector @ vector)
        for first in range(0, len(ids), 512):
            rows = np.flatnonzero(ids[first:first + 512] != qid) + first
            partial = np.zeros(len(rows))
            if limit < np.inf:
                for c in range(0, d, columns):
                    e = min(c + columns, d)
                    diff = points[rows, c:e] - point[c:e]
                    partial += np.einsum("ij,ij->i", diff, diff)
                    if e < d:
                        keep = partial * (d / e) <= limit * (1.0 + slack / e**0.5) ** 2
                        rows, partial = rows[keep], partial[keep]
            if not len(rows):
                continue
            score = (vectors[rows] * vector).sum(1)
            best_score, best_id = np.concatenate([best_score, score]), np.concatenate([best_id, ids[rows]])
            order = np.lexsort((best_id, -best_score))[:k]
            best_score, best_id = best_score[order], best_id[order]
            if len(order) == k:
                limit = max(norm + index.bound - 2.0 * best_score[-1], 0.0) * (1 + 1e-12) + 1e-12
        out.append(pd.DataFrame({"query_id": qid, "vec_id": best_id, "score": best_score}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(rows: DataFrame, is_query: Column, k: int = 20, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query row.

    ``rows`` has vec_id and embedding (array of numbers). Rows without id, and
    vectors that are null, zero, of another length than most, or hold a null or
    non-finite number take no part; rows that share the query's id are not its
    candidates; other repeated rows count one by one; other columns are ignored.
    Ties go to the smaller vec_id. Empty input gives no rows. Lists larger than
    a block are cut into blocks, and their queries into groups, so no task
    holds more than one block and one group.
    """
    spark = rows.sparkSession
    numbers = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("v"), is_query.alias("asks")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    sizes = (usable.groupBy(F.size("v").alias("d"))
             .agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("bound"))
             .orderBy(F.desc("n"), "d").first())
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    dims = sizes["d"]
    usable = usable.where(F.size("v") == dims)
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    sample = hashed_sample(usable, ["vec_id"], sizes["n"], most).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)
    index = learn_index(np.array([r["v"] for r in sample.select("v").toLocalIterator()], np.float64), sizes["n"], sizes["bound"], k, recall)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            if len(b):
                points = shared.value.points(np.stack(b["v"].to_numpy()))
                yield b.assign(list=shared.value.nearest(points))

    indexed = stored(usable.mapInPandas(assign, "vec_id long, v array<double>, asks boolean, list long"), "vectors")
    # one count for each list, of which there are at most MOST_LISTS
    held = np.zeros(len(index.centres), np.int64)
    for r in indexed.groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-held // BLOCK_ROWS))
    share = spark.sparkContext.broadcast((held, blocks))

    def probe(batches):
        own, (sizes_of, blocks_of) = shared.value, share.value
        for b in batches:
            for a in range(0, len(b), 2_000):
                part = b.iloc[a:a + 2_000]
                order = np.argsort(own.distances(own.query_points(np.stack(part["v"].to_numpy()))), 1)
                reach = np.cumsum(sizes_of[order], 1) - sizes_of[order]
                wanted = (np.arange(order.shape[1])[None, :] < own.probes) | (reach < 4 * k)
                row, place = np.nonzero(wanted & (sizes_of[order] > 0))
                lists = order[row, place]
                times = blocks_of[lists]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, lists = np.repeat(row, times), np.repeat(lists, times)
                for c in range(0, len(row), 20_000):
                    r = row[c:c + 20_000]
                    yield pd.DataFrame({"list": lists[c:c + 20_000], "block": block[c:c + 20_000],
                                        "vec_id": part["vec_id"].to_numpy()[r], "v": part["v"].to_numpy()[r]})

    asked = (indexed.where("asks").select("vec_id", "v")
             .mapInPandas(probe, "list long, block long, vec_id long, v array<double>"))
    queries = indexed.where("asks").count()
    groups = max(1, -(-queries // BLOCK_QUERIES))
    of_list = F.element_at(F.array(*[F.lit(int(x)) for x in blocks]), (F.col("list") + 1).cast("int"))
    spread = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), of_list)).select(
        "list", "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "vec_id", "v")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))

    def compare(queries_in: pd.DataFrame, held_in: pd.DataFrame) -> pd.DataFrame:
        if not len(queries_in) or not len(held_in):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        held_in = held_in.sort_values("vec_id", kind="stable")
        return scan(shared.value, held_in["vec_id"].to_numpy(), np.stack(held_in["v"].to_numpy()),
                    queries_in["vec_id"].to_numpy(), np.stack(queries_in["v"].to_numpy()), k)

    keys = ["list", "block", "part"]
    asked = asked.withColumn("block", F.col("block").cast("long"))
    spread = spread.withColumn("block", F.col("block").cast("long"))
    found = asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(compare, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op6_neighbours")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
