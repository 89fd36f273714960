"""Fitted Spark trees held to a least number of rows per split."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession

from tabspark.session import scratch_path


def leaf_predictions(nodes: list[dict], least: int, depth: int) -> list[float]:
    """What each leaf's rows are told, from left to right, if splits of fewer than ``least`` rows or below ``depth`` are undone.

    A node is split or not whatever happens beside or below it, so these are the
    predictions of the tree that growing under both limits would have given.
    """
    by_id, out = {n["id"]: n for n in nodes}, []
    todo = [(0, 0, None)]  # node, its level, and the prediction of the leaf it lies in
    while todo:
        i, level, told = todo.pop()
        node = by_id[i]
        split = node["leftChild"] >= 0
        if told is None and not (split and level < depth and node["rawCount"] >= least):
            told = node["prediction"]
        if split:
            todo += [(node["rightChild"], level + 1, told), (node["leftChild"], level + 1, told)]
        else:
            out.append(told)
    return out


def tree_nodes(spark: SparkSession, model: Model) -> list[dict]:
    """The node table of one fitted tree, through its saved form."""
    path = scratch_path(spark, "tree")
    model.write().save(path)
    rows = [r.asDict(recursive=True) for r in spark.read.parquet(f"{path}/data").collect()]
    return [r.get("nodeData", r) for r in rows]


def collapsed(nodes: list[dict], least: int) -> list[dict]:
    """One tree's nodes, numbered from the root, with splits of fewer than ``least`` rows turned into leaves.

    A node is split or not whatever happens beside it, so this is the tree that
    growing under the limit would have given. Numbers are dealt anew in the old
    order, without gaps.
    """
    by_id = {n["id"]: n for n in nodes}
    kept, todo = [], [0]
    while todo:
        node = dict(by_id[todo.pop()])
        if node["leftChild"] >= 0 and node["rawCount"] < least:
            # Spark's marks of a leaf
            node |= {"leftChild": -1, "rightChild": -1, "gain": -1.0,
                     "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        kept.append(node)
        if node["leftChild"] >= 0:
            todo += [node["rightChild"], node["leftChild"]]
    kept.sort(key=lambda n: n["id"])
    number = {n["id"]: i for i, n in enumerate(kept)} | {-1: -1}
    return [n | {k: number[n[k]] for k in ("id", "leftChild", "rightChild")} for n in kept]


def limit_splits(spark: SparkSession, model: Model, least: int) -> Model:
    """The tree or forest without splits of fewer than ``least`` rows, through its saved node table.

    The table has one row per node, so it is as small as the model itself.
    """
    path, out = scratch_path(spark, "tree"), scratch_path(spark, "tree")
    model.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    trees: dict = {}
    for row in table.collect():
        r = row.asDict(recursive=True)
        tree, node = (r["treeID"], r["nodeData"]) if "treeID" in r else (None, r)
        trees.setdefault(tree, []).append(node)
    rows = []
    for tree, nodes in trees.items():
        if tree is None:
            rows += collapsed(nodes, least)
        else:
            rows += [{"treeID": tree, "nodeData": n} for n in collapsed(nodes, least)]
    spark.createDataFrame(rows, table.schema).coalesce(1).write.parquet(f"{out}/data")
    spark.read.text(f"{path}/metadata").coalesce(1).write.text(f"{out}/metadata")
    if None not in trees:
        spark.read.parquet(f"{path}/treesMetadata").write.parquet(f"{out}/treesMetadata")
    return type(model).load(out)


class SplitLimit(Estimator):
    """Fits a Spark tree or forest and undoes its splits of few rows; gives the same kind of model."""

    def __init__(self, inner: Estimator, least: int):
        super().__init__()
        self.inner, self.least = inner, least

    def _fit(self, dataset: DataFrame) -> Model:
        return limit_splits(dataset.sparkSession, self.inner.fit(dataset), self.least)
