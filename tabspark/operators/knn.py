"""Exact k-nearest-neighbour join without a cross join.

Equal training vectors are one row with the ids that share it, of which k are
enough. A training side of checked size is broadcast; a larger one is cut into
cells around pivot rows, a row is searched in its own cell first, and its k-th
distance tells in which other cells nearer rows can lie. Both sides of a search
are blocks of bounded size, cut into runs of near rows, so that a run is compared
only with those that its k-th distance reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabspark.config import EngineConfig
from tabspark.functions.expr import col
from tabspark.session import scratch_path

_BLOCK_CELLS = 4_000_000  # distances held in memory at once
_BLOCK_BYTES = 1 << 25  # vectors on either side of one search
_FEW = 16  # columns up to which distances are summed up column by column, and cells have bounds by column


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances between paired rows, summed in a fixed order."""
    if metric == "manhattan":
        return np.abs(a - b).sum(axis=1)
    return np.square(a - b).sum(axis=1)


def _runs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and where its runs of near rows begin: halves of the widest column, again and again."""
    most = 256 if matrix.shape[1] <= _FEW else 2048
    order, starts, todo = np.arange(len(matrix)), [], [(0, len(matrix))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            starts.append(a)
            continue
        part = matrix[order[a:b]]
        widest, half = int(np.argmax(part.max(axis=0) - part.min(axis=0))), (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, widest], half)]
        todo += [(a + half, b), (a, a + half)]
    return order, np.append(np.sort(np.array(starts, np.int64)), len(matrix))


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1 ... of each entry, n numbers each."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _places(i: np.ndarray) -> np.ndarray:
    """Position of each entry among those of equal i; i is sorted."""
    first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.empty(0, bool)
    return np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))


class TrainRows:
    """Different training vectors, the ids that share each (ascending), and something known of every id."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray, times: np.ndarray, metric: str, known: np.ndarray | None = None):
        order, self.cut = _runs(matrix)
        first = np.cumsum(times) - times
        self.matrix, self.times, self.metric = matrix[order], times[order], metric
        at = _spread(first[order], self.times)
        self.ids, self.known = ids[at], None if known is None else known[at]
        self.first = np.cumsum(self.times) - self.times
        starts = self.cut[:-1] if len(matrix) else np.empty(0, np.int64)
        self.low, self.high = (f.reduceat(self.matrix, starts) if len(starts) else self.matrix for f in (np.minimum, np.maximum))
        self.square = np.square(self.matrix).sum(axis=1)

    def _rough(self, probe: np.ndarray, square: np.ndarray, a: int, b: int) -> np.ndarray:
        if self.metric != "manhattan" and probe.shape[1] > _FEW:
            return square[:, None] + self.square[None, a:b] - 2.0 * (probe @ self.matrix[a:b].T)
        out = np.zeros((len(probe), b - a))
        for f in range(probe.shape[1]):
            gap = probe[:, f, None] - self.matrix[None, a:b, f]
            out += np.abs(gap) if self.metric == "manhattan" else np.square(gap)
        return out

    def _near(self, probe: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, vector) that hold the k nearest vectors of every row and all that rounding can't tell from them."""
        low, high = probe.min(axis=0), probe.max(axis=0)
        apart = np.maximum(0.0, np.maximum(self.low - high, low - self.high))
        gap = apart.sum(axis=1) if self.metric == "manhattan" else np.square(apart).sum(axis=1)
        square = np.square(probe).sum(axis=1)
        product = self.metric != "manhattan" and probe.shape[1] > _FEW
        slack = 1e-9 * (1.0 + square + self.square.max()) if product else np.zeros(len(probe))
        top, limit = np.full((len(probe), k), np.inf), np.full(len(probe), np.inf)
        found = []
        for leaf in np.argsort(gap, kind="stable"):
            if gap[leaf] * (1 - 1e-9) > limit.max():
                break
            a, b = int(self.cut[leaf]), int(self.cut[leaf + 1])
            rough = self._rough(probe, square, a, b)
            hit = np.flatnonzero((rough <= limit[:, None]).any(axis=1))
            if not len(hit):
                continue
            rough = rough[hit]
            both = np.concatenate([top[hit], rough], axis=1)
            both.partition(k - 1, axis=1)
            top[hit] = both[:, :k]
            limit[hit] = both[:, k - 1] * (1 + 1e-9) + slack[hit]
            i, j = np.nonzero(rough <= limit[hit][:, None])
            found.append((hit[i], a + j, rough[i, j]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        i, j, rough = (np.concatenate(x) for x in zip(*found))
        keep = rough <= limit[i]
        return i[keep], j[keep]

    def search(self, probe: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in ids, distance) of the k nearest, sorted by (row, distance, id).

        Distances are screened roughly; every vector within rounding error of the
        k-th best is then measured exactly, so ties are decided by the id and not
        by the screening. Squared distances, if Euclidean.
        """
        out = []
        if len(probe) and len(self.matrix):
            order, cut = _runs(probe)
            for rows in (order[a:b] for a, b in zip(cut, cut[1:])):
                i, j = self._near(probe[rows], min(k, len(self.matrix)))
                d = _distances(probe[rows][i], self.matrix[j], self.metric)
                for again in (False, True):
                    at = self.first[j] if not again else _spread(self.first[j], self.times[j])
                    if again:
                        i, d = np.repeat(i, self.times[j]), np.repeat(d, self.times[j])
                        j = at
                    by = np.lexsort((self.ids[at], d, i))
                    by = by[_places(i[by]) < k]
                    i, j, d = i[by], j[by], d[by]
                out.append((rows[i], j, d))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        i, at, d = (np.concatenate(x) for x in zip(*out))
        by = np.argsort(i, kind="stable")
        return i[by], at[by], d[by]


def matrix_of(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column, one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _vectors(matrix: np.ndarray) -> pa.Array:
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(matrix).ravel()))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of an Arrow column of lists, and how many each has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def equal_rows(matrix: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal ones."""
    if matrix.shape[1] == 1:
        return np.unique(matrix[:, 0], return_inverse=True)[1].ravel()
    rows = np.ascontiguousarray(matrix + 0.0)  # no negative zeros
    return np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()


def _distinct(train: DataFrame, k: int) -> DataFrame:
    """(vec, ids): every different vector with the k smallest of its ids, cut to k in each batch already."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m, ids = matrix_of(b.column(1)) + 0.0, b.column(0).to_numpy()
            same = equal_rows(m)
            by = np.lexsort((ids, same))
            place = _places(same[by])
            by, place = by[place < k], place[place < k]
            starts = np.append(np.flatnonzero(place == 0), len(by)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [_vectors(m[by[place == 0]]), pa.ListArray.from_arrays(pa.array(starts), pa.array(ids[by]))], names=["vec", "ids"])

    parts = train.select("id", "vec").mapInArrow(fold, "vec array<double>, ids array<bigint>")
    return parts.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"))


@dataclass
class NeighbourIndex:
    """Training rows (id, vector, optional label), prepared for searching."""
    train: DataFrame  # columns: id long, vec array<double>
    k: int = 5
    metric: str = "euclidean"
    config: EngineConfig = EngineConfig()

    @cached_property
    def distinct(self) -> DataFrame:
        """The different vectors with their ids, written once."""
        spark = self.train.sparkSession
        path = scratch_path(spark, "vectors")
        found = _distinct(self.train, self.k)
        found.write.parquet(path)
        return spark.read.schema(found.schema).parquet(path)

    @cached_property
    def size(self) -> tuple[int, int]:
        row = self.distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
        return row["n"], row["d"] or 0

    def fits_broadcast(self) -> bool:
        n, d = self.size
        return n <= self.config.broadcast_rows and n * d * 8 <= self.config.broadcast_bytes

    def join(self, probe: DataFrame) -> DataFrame:
        """``probe`` (id, vec) -> (id, neighbour, distance, rank); Euclidean distances come squared."""
        if self.size[0] == 0:
            raise ValueError("no training rows")
        found = self._broadcast_join(probe) if self.fits_broadcast() else self._pivot_join(probe)
        return found

    def collect(self, known: DataFrame | None = None, name: str = "y") -> TrainRows:
        """All training vectors in this process, if they fit; ``known`` has (id, ``name``) and more columns."""
        rows = self.distinct.toArrow()  # size checked by the caller
        ids, times = _lists(rows["ids"])
        values = None
        if known is not None:
            kept = self.distinct.select(F.explode("ids").alias("id"))
            pairs = known.select("id", name).join(kept, "id").toArrow()  # k for each vector at most
            own, value = pairs["id"].to_numpy(), pairs[name].to_numpy()
            by = np.argsort(own)
            values = value[by][np.searchsorted(own[by], ids)]
        return TrainRows(matrix_of(rows["vec"]), ids, times, self.metric, values)

    def _broadcast_join(self, probe: DataFrame) -> DataFrame:
        shared = probe.sparkSession.sparkContext.broadcast(self.collect())
        k, id_type = self.k, probe.schema["id"].dataType.simpleString()

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    i, at, d = shared.value.search(matrix_of(b.column(1)), k)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(i)), pa.array(shared.value.ids[at]), pa.array(d), pa.array(_places(i) + 1)],
                        names=["id", "neighbour", "distance", "rank"])

        return probe.select("id", "vec").mapInArrow(search, f"id {id_type}, neighbour long, distance double, rank long")

    def _pivot_join(self, probe: DataFrame) -> DataFrame:
        spark, k, metric = probe.sparkSession, self.k, self.metric
        n, d = self.size
        by_column = d <= _FEW
        limit = max(k, min(self.config.broadcast_rows, min(self.config.broadcast_bytes, _BLOCK_BYTES) // (8 * max(d, 1))))
        # a quarter of a block per cell; where cells can't be told apart by column, rows ask nearly all, so there are few
        n_pivots = int(min(2048, n, max(2, (4 if by_column else 1) * -(-n // limit))))
        id_type = probe.schema["id"].dataType.simpleString()
        # Any rows serve as pivots; the smallest hashes give a reproducible spread.
        pivots = np.array([r["vec"] for r in self.distinct.select("vec", F.md5(F.col("vec").cast("string")).alias("h"))
                           .orderBy("h", "vec").limit(n_pivots).collect()], dtype=np.float64)
        squared = metric != "manhattan"

        def to_pivots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if squared:
                return np.sqrt(np.maximum(
                    np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0))
            out = np.zeros((len(a), len(b)))
            for f in range(a.shape[1]):
                out += np.abs(a[:, f, None] - b[None, :, f])
            return out

        def error_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Largest rounding error of ``to_pivots`` on these rows."""
            return np.sqrt(1e-12 * (1.0 + np.square(a).sum(1) + np.square(b).sum(1).max()))

        def home(m: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            cell, reach = np.empty(len(m), np.int64), np.empty(len(m))
            step = max(1, _BLOCK_CELLS // len(b))
            for s in range(0, len(m), step):
                part = m[s:s + step]
                dist = to_pivots(part, b)
                cell[s:s + step] = own = dist.argmin(axis=1)
                reach[s:s + step] = dist[np.arange(len(part)), own] + error_bound(part, b)
            return cell, reach

        def housed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell, reach = home(matrix_of(b.column(0)), pivots)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(reach)], names=["vec", "ids", "cell", "reach"])

        path = scratch_path(spark, "cells")
        self.distinct.select("vec", "ids").mapInArrow(
            housed, "vec array<double>, ids array<bigint>, cell long, reach double").write.parquet(path)
        cells = spark.read.parquet(path)
        bounds = [f(F.col("vec")[i]) for f in (F.min, F.max) for i in range(d)] if by_column else []
        stats = cells.groupBy("cell").agg(F.count(F.lit(1)), F.max("reach"), *bounds).orderBy("cell").collect()
        cell_id = np.array([r[0] for r in stats], np.int64)
        cell_n = np.array([r[1] for r in stats], np.int64)
        cell_reach = np.array([r[2] for r in stats], np.float64)
        cell_low, cell_high = np.array([r[3:] for r in stats], np.float64).reshape(len(stats), 2, -1).transpose(1, 0, 2)
        pv = pivots[cell_id]

        def within(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Least and greatest distance that a row of a cell can have from each row; squared, if Euclidean."""
            if by_column:
                near, far = np.zeros((len(m), len(pv))), np.zeros((len(m), len(pv)))
                for f in range(m.shape[1]):
                    below, above = cell_low[:, f] - m[:, f, None], m[:, f, None] - cell_high[:, f]
                    gap, most = np.maximum(0.0, np.maximum(below, above)), np.maximum(-below, -above)
                    near += np.square(gap) if squared else gap
                    far += np.square(np.maximum(most, gap)) if squared else np.maximum(most, gap)
                return near, far
            dist, err = to_pivots(m, pv), error_bound(m, pv)[:, None]
            near, far = np.maximum(0.0, dist - err - cell_reach), dist + err + cell_reach
            return (np.square(near), np.square(far)) if squared else (near, far)

        def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell = cell_id[home(matrix_of(b.column(1)), pv)[0]]
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["id", "vec", "cell"])

        def elsewhere(with_vectors: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                step = max(1, _BLOCK_CELLS // len(pv))
                for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
                    m, own = matrix_of(b.column(1)), b.column(2).to_numpy()
                    bound = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                    near, far = within(m)
                    open_ = np.flatnonzero(np.isnan(bound))  # fewer than k rows at home
                    if len(open_):
                        by_far = np.argsort(far[open_], axis=1)
                        held = np.cumsum(cell_n[by_far], axis=1)
                        at = np.minimum((held < k).sum(axis=1), held.shape[1] - 1)
                        reach = np.take_along_axis(far[open_], np.take_along_axis(by_far, at[:, None], 1), 1)[:, 0]
                        bound[open_] = np.where(held[:, -1] < k, np.inf, reach)
                    asked = (near * (1 - 1e-9) <= bound[:, None] * (1 + 1e-9)) & (cell_id[None, :] != own[:, None])
                    i, j = np.nonzero(asked)
                    some = max(1, _BLOCK_BYTES // (8 * m.shape[1]))
                    for s in range(0, len(i), some) if with_vectors else [0]:
                        cut = slice(s, s + some) if with_vectors else slice(None)
                        columns = [b.column(0).take(pa.array(i[cut])), _vectors(m[i[cut]])] if with_vectors else []
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(cell_id[j[cut]])], names=[*["id", "vec"][:len(columns)], "cell"])
            return run

        def block(a: pa.Table, b: pa.Table) -> pa.Table:
            names = ["id", "neighbour", "distance"]
            if not a.num_rows or not b.num_rows:
                return pa.table([a["id"].slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
            rows = TrainRows(matrix_of(b["vec"]), *_lists(b["ids"]), metric)
            i, at, dist = rows.search(matrix_of(a["vec"]), k)
            return pa.table([a["id"].take(pa.array(i)), pa.array(rows.ids[at]), pa.array(dist)], names=names)

        def searched(asked: DataFrame, asked_n: dict[int, int]) -> DataFrame:
            """(id, neighbour, distance) of the k nearest in each block that a row asks."""
            plan = spark.createDataFrame(
                [(int(c), int(-(-int(n_) // limit)), int(-(-asked_n[int(c)] // limit)))
                 for c, n_ in zip(cell_id, cell_n) if int(c) in asked_n], "cell long, t_parts int, p_parts int")
            plan = F.broadcast(plan)  # at most 2048 rows
            part_of = lambda key, parts: F.pmod(F.xxhash64(key), parts).cast("int")
            # A block pairs one part of a cell with one part of the rows that ask for it:
            # both sides stay below the limit however full a cell is.
            left = (asked.join(plan, "cell").withColumn("p", part_of("id", F.col("p_parts")))
                    .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("t_parts") - 1)))
                    .select("cell", "t", "p", "id", "vec"))
            right = (cells.join(plan, "cell").withColumn("t", part_of("vec", F.col("t_parts")))
                     .withColumn("p", F.explode(F.sequence(F.lit(0), F.col("p_parts") - 1)))
                     .select("cell", "t", "p", "ids", "vec"))
            keys = ["cell", "t", "p"]
            return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
                block, f"id {id_type}, neighbour long, distance double")

        def counted(asked: DataFrame) -> dict[int, int]:
            return {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}

        own_path, found_path = scratch_path(spark, "probes"), scratch_path(spark, "found")
        probe.select("id", "vec").mapInArrow(at_home, f"id {id_type}, vec array<double>, cell long").write.parquet(own_path)
        own = spark.read.parquet(own_path)
        searched(own, counted(own)).write.parquet(found_path)
        found = spark.read.parquet(found_path)
        kth = found.groupBy("id").agg(F.get(F.sort_array(F.collect_list("distance")), F.lit(k - 1)).alias("kth"))
        bounded = own.join(kth, "id", "left").select("id", "vec", "cell", "kth")
        asked_n = counted(bounded.mapInArrow(elsewhere(False), "cell long"))
        if asked_n:
            asked = bounded.mapInArrow(elsewhere(True), f"id {id_type}, vec array<double>, cell long")
            found = found.union(searched(asked, asked_n))
        w = Window.partitionBy("id").orderBy("distance", "neighbour")
        return (found.withColumn("rank", F.row_number().over(w).cast("long"))
                .filter(F.col("rank") <= k).select("id", "neighbour", "distance", "rank"))


def knn_join(probe: DataFrame, train: DataFrame, probe_id: str, train_id: str, vector: str, k: int = 5,
             metric: str = "euclidean", config: EngineConfig = EngineConfig()) -> DataFrame:
    """(probe_id, neighbor_id, rank, distance): exact neighbours, ties to the smaller id."""
    side = lambda df, i: df.select(col(i).cast("long").alias("id"), col(vector).cast("array<double>").alias("vec"))
    found = NeighbourIndex(side(train, train_id), k, metric, config).join(side(probe, probe_id))
    d = F.sqrt("distance") if metric != "manhattan" else F.col("distance")
    return found.select(F.col("id").alias("probe_id"), F.col("neighbour").alias("neighbor_id"), "rank",
                        d.alias("distance"))


def _with_target(found: DataFrame, train: DataFrame, train_id: str, target: str) -> DataFrame:
    labels = train.select(col(train_id).alias("neighbor_id"), col(target).alias("_y"))
    return found.join(labels, "neighbor_id")


def knn_classify(probe: DataFrame, train: DataFrame, probe_id: str, train_id: str, vector: str, target: str,
                 k: int = 5, metric: str = "euclidean", weights: str = "uniform",
                 config: EngineConfig = EngineConfig()) -> DataFrame:
    """(probe_id, prediction, votes): majority of the neighbours, ties to the smallest label."""
    found = _with_target(knn_join(probe, train, probe_id, train_id, vector, k, metric, config), train, train_id, target)
    votes = weighted(found, weights).groupBy("probe_id", "_y").agg(F.sum("_w").alias("v"))
    return votes.groupBy("probe_id").agg(
        F.min_by("_y", F.struct(-F.round("v", 12), F.col("_y"))).alias("prediction"), F.max("v").alias("votes"))


def knn_regress(probe: DataFrame, train: DataFrame, probe_id: str, train_id: str, vector: str, target: str,
                k: int = 5, metric: str = "euclidean", weights: str = "uniform",
                config: EngineConfig = EngineConfig()) -> DataFrame:
    """(probe_id, prediction): weighted mean of the neighbours' targets."""
    found = _with_target(knn_join(probe, train, probe_id, train_id, vector, k, metric, config), train, train_id, target)
    w = weighted(found, weights)
    return w.groupBy("probe_id").agg((F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).alias("prediction"))


def weighted(found: DataFrame, weights: str, key: str = "probe_id") -> DataFrame:
    """Uniform weights, or inverse distances where an exact hit outweighs all others."""
    if weights == "uniform":
        return found.withColumn("_w", F.lit(1.0))
    exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(key))
    return found.withColumn("_w", F.when(exact == 1, (F.col("distance") == 0).cast("double"))
                            .otherwise(1.0 / F.col("distance")))
