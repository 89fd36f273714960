"""N-gram Jaccard join: documents linked by shared shingles, and their components.

Equal sets are one class. Linked classes share several of their rarest shingles
(of as many as may be missing and that several more) and are about equally
large; classes that share too few with all others have no link, and the shared
ones join the rest to candidate clusters, inside which T-occurrence search
(DivideSkip) finds the exact links. No list of pairs is ever made: clusters hand
on components. What two classes share by chance or in a passage is less than
links need, and such ties are left out as far as no link can hang on them. Large
clusters are clustered once more by all of their shingles, and what stays large
is searched in blocks, in rounds that bound the copies on disk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabspark.llm.common import components, hashed_sample, join_by_count, join_salted, one_of_hot_texts, stored, table, text_bytes
from tabspark.llm.registry import query
from tabspark.llm.shingles import least_overlap, linked_sets, set_digest, shingle_sets

#: Texts by which frequent shingles are told from rare ones, and how many are; this sets the order of
#: shingles only, and any order gives the same links.
SAMPLE_TEXTS, FREQUENT = 20_000, 1 << 18
#: Classes and shingles of a cluster that one task searches at a time (a block of a larger one has half of either), and
#: sets of a band of lengths that are shown to every block they may be linked with.
CLUSTER_SETS, CLUSTER_SHINGLES, PIVOTS = 4_000, 4_000_000, 32
HOT = 1_000
#: Rare shingles that linked classes share at least, and as a part of the set's size (small sets: as many as their overlap
#: allows). The more, the less clusters hang on chance; large clusters are clustered again by whole sets.
SHARED, PART, WHOLE = 32, 8, 1
#: Texts whose shingles a task holds and hands on at a time.
TEXTS = 1_000
#: A round deals out as many bytes of copies of sets at a time: so many times those of the sets, or this at least.
ROUND_TIMES, ROUND_BYTES = 3, 1 << 28


def _some(batches):
    """The rows of each batch, TEXTS at a time."""
    for b in batches:
        for a in range(0, len(b), TEXTS):
            yield b.iloc[a:a + TEXTS]


def _frequent(texts: DataFrame, size: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least three sampled texts have, and a level by how many."""
    rows = hashed_sample(texts.select("k1", "k2", "data"), ["k1", "k2"], total, SAMPLE_TEXTS)

    def run(batches):
        for b in _some(batches):
            sets = shingle_sets(list(b["data"]), size)
            if sets:
                yield pd.DataFrame({"token": np.concatenate(sets).view(np.int64)})

    found = (rows.dropDuplicates(["k1", "k2"]).mapInPandas(run, "token long").groupBy("token").count()
             .where("count > 2").orderBy(F.desc("count"), "token").limit(FREQUENT).toPandas())
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.log2(found["count"].to_numpy(np.float64)[order]).astype(np.int64)


def _rarest(s: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray], part: int) -> np.ndarray:
    least = least_overlap(len(s), percent)
    kept = len(s) - least + min(max(SHARED, len(s) // part), least)
    if kept == len(s):
        return s
    token, level = frequent
    rank = np.zeros(len(s), np.int64)
    if len(token):
        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
        rank = np.where(token[at] == s, level[at], 0)
    return s[np.lexsort((s, rank))[:kept]]


def _candidate_edges(postings: DataFrame, percent: int, hot: int, part: int) -> DataFrame:
    """(node, low) edges that connect all classes that may be linked. ``postings``: token, node, n (set size).

    A class has as many tokens as its set may lack, and m = min(max(SHARED, n /
    ``part``), overlap) more; two linked ones share at least m - 1 of these, m
    being that of the larger (the one off is for rounding). So a class that
    shares fewer with the others is dropped, round by round. Sets are linked
    only if the smaller has ``percent`` of the larger's size: a token ties the
    sets of a band of sizes and the next to the least class among them. Of its
    ties each class leaves out the weakest, by the tokens behind them, up to
    less than half of what a link needs. Two linked classes thus keep a token
    in common, and their ties to its least class.
    """
    lists = postings.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    lists = stored(lists.where("low < high").select("token", F.col("n").alias("n"), F.lit(True).alias("live")), "lists")
    total = lists.agg(F.sum("n")).first()[0] or 0
    live = stored(join_salted(postings, lists, ["token"], total, hot).select("token", "node", F.col("n").alias("size")).distinct(), "live")
    overlap = F.ceil(F.col("size") * percent / 100)
    need = F.greatest(F.lit(1), F.least(F.greatest(F.lit(SHARED), F.floor(F.col("size") / part)), overlap) - 1)
    for _ in range(3):
        strong = live.groupBy("node").agg(F.count("*").alias("shared"), F.first("size").alias("size")).where(F.col("shared") >= need)
        live = live.join(strong.select("node"), "node", "left_semi")
        more = stored(live.groupBy("token").agg(F.count("*").alias("n"), F.lit(True).alias("live")).where("n > 1"), "lists")
        live = stored(join_by_count(live, more, ["token"], live.count(), hot).select("token", "node", "size"), "live")
    band = F.floor(F.log(F.col("size")) / float(np.log(100 / percent) * (1 + 1e-9))).cast("int")
    live = live.withColumn("band", band).withColumn("level", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    groups = live.groupBy("token", "level").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.min("band").alias("least"))
    # sets of the upper band alone meet on their own level
    groups = stored(groups.where("n > 1 AND least = level").drop("least"), "groups")
    ties = (join_by_count(live, groups, ["token", "level"], 2 * live.count(), hot).where("node <> low")
            .groupBy("node", "level", "low").agg(F.count("*").alias("weight"), F.first("size").alias("size")))
    weakest = Window.partitionBy("node", "level").orderBy("weight", "low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ties.withColumn("up_to", F.sum("weight").over(weakest)).where(F.col("up_to") * 2 >= need).select("node", "low").distinct()


def _candidate_clusters(texts: DataFrame, size: int, percent: int, total: int, hot: int, part: int = PART) -> DataFrame:
    """(node, root): clusters of classes outside which nothing is linked, from ``texts`` (k1, k2, data); others have no link."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64)  # whole sets need no order
    frequent = texts.sparkSession.sparkContext.broadcast(none if part == WHOLE else _frequent(texts, size, total))

    def rare(batches):
        for b in _some(batches):
            found = [s for s in shingle_sets(list(b["data"]), size) if len(s)]
            cut = [_rarest(s, percent, frequent.value, part) for s in found]
            if cut:
                times = [len(c) for c in cut]
                yield pd.DataFrame({"token": np.concatenate(cut).view(np.int64), "node": np.repeat([set_digest(s) for s in found], times),
                                    "n": np.repeat([len(s) for s in found], times)})

    edges = _candidate_edges(texts.mapInPandas(rare, "token long, node long, n long"), percent, hot, part)
    clusters = stored(components(edges, "node", "low"), "clusters")
    return clusters.union(clusters.select(F.col("root").alias("node"), "root").distinct())


def _weighed(classes: DataFrame, cluster_sets: int, cluster_shingles: int, hot: int) -> DataFrame:
    """Adds to classes (root, n, ...) whether their cluster is too large for one task."""
    weight = classes.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("all"))
    weight = stored(weight.select("root", ((F.col("sets") > cluster_sets) | (F.col("all") > cluster_shingles)).alias("large"),
                                  F.col("sets").alias("n")), "weight")
    return join_by_count(classes, weight, ["root"], classes.count(), hot)


class _Group:
    """The rows of one search: sets take the place of texts as soon as there are a few."""

    def __init__(self, size: int, percent: int):
        self.size, self.percent = size, percent
        self.sets, self.texts, self.held = [], [], 0
        self.node, self.group, self.must = [], [], []

    def add(self, node, data, group, must) -> None:
        self.node.append(node), self.group.append(group), self.must.append(must)
        self.texts.append(data)
        self.held += len(data)
        if self.held >= 1_000_000:
            self._cut()

    def _cut(self) -> None:
        self.sets += shingle_sets(self.texts, self.size)
        self.texts, self.held = [], 0

    def links(self) -> pd.DataFrame:
        self._cut()
        must = np.array(self.must, bool)
        roots = linked_sets(self.sets, self.percent, np.array(self.group), must if not must.all() else None)
        node = np.array(self.node, np.int64)
        return pd.DataFrame({"u": node, "v": node[roots]})


def _cluster_links(size: int, percent: int):
    """Components inside each run of rows with equal (a, b, c); rows are ordered so."""
    def run(batches):
        now, rows = None, None
        for b in batches:
            for key, *row in zip(zip(b["a"], b["b"], b["c"]), *(b[c] for c in ("node", "data", "group", "must"))):
                if key != now:
                    if rows is not None and len(rows.node) > 1:
                        yield rows.links()
                    now, rows = key, _Group(size, percent)
                rows.add(*row)
        if rows is not None and len(rows.node) > 1:
            yield rows.links()

    return run


def _searched(rows: DataFrame, size: int, percent: int) -> DataFrame:
    dealt = rows.repartition("a", "b", "c").sortWithinPartitions("a", "b", "c", "node")
    return dealt.mapInPandas(_cluster_links(size, percent), "u long, v long").where("u <> v")


def _large_clusters(members: DataFrame, size: int, percent: int, block: int, shingles: int, hot: int) -> DataFrame:
    """Links of clusters that are too large for one task. ``members``: root, node, n, data.

    Sets lie in bands of length, of which only neighbours can be linked, and
    bands in blocks of about ``block`` sets and ``shingles`` shingles at most.
    First each block is searched together with some pivots of its own and the
    neighbouring bands, which usually leaves one large component and a few others.
    Then those others are searched against all blocks of their own and the
    neighbouring bands; links inside the large component add nothing. Every
    block is copied to all that ask it, so these searches go in rounds, whose
    copies have ROUND_TIMES the bytes of the sets.
    """
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent) * (1 + 1e-9))).cast("long")
    members = members.select("root", "node", "data", F.col("n").alias("size"), band.alias("band"))
    total, zero = members.count(), F.lit(0).cast("long")
    needed = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / shingles)).cast("long")
    blocks = stored(members.groupBy("root", "band").agg(
        F.count("*").alias("n"), F.count("*").alias("sets"), F.sum("size").alias("all"), needed.alias("blocks")), "blocks")
    members = join_by_count(members, blocks, ["root", "band"], total, hot)
    # pivots are PIVOTS sets of a band, and an eighth of a block's shingles, at most as a rule
    share = F.least(F.lit(PIVOTS) / F.col("sets"), F.lit(shingles / 8) / F.col("all"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn(
        "pivot", F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)) < share * (1 << 30))
    members = stored(members.drop("blocks", "sets", "all"), "members")
    near = (blocks.withColumn("near", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
            .groupBy("root", F.col("near").alias("band"))
            .agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col("band").alias("to"), "blocks")).alias("grid")))
    pivots = join_by_count(members.where("pivot"), stored(near, "near"), ["root", "band"], total, hot)
    spread = (pivots.withColumn("p", F.explode("grid"))
              .withColumn("c", F.explode(F.sequence(zero, F.col("p.blocks") - 1)))
              .where((F.col("p.to") != F.col("band")) | (F.col("c") != F.col("block"))))
    own = members.select(F.col("root").alias("a"), F.col("band").alias("b"), F.col("block").alias("c"), "node", "data",
                         F.col("node").alias("group"), F.lit(True).alias("must"))
    shown = spread.select(F.col("root").alias("a"), F.col("p.to").alias("b"), "c", "node", "data",
                          F.col("node").alias("group"), F.lit(True).alias("must"))
    first = stored(_searched(own.union(shown), size, percent), "links")
    part = components(first, "u", "v").select(F.col("node").alias("_node"), F.col("root").alias("_group"))
    labelled = stored(members.join(part, F.col("node") == F.col("_node"), "left")
                      .withColumn("group", F.coalesce("_group", "node")).drop("_node", "_group"), "members")
    main = (labelled.groupBy("root", "group").count().groupBy("root")
            .agg(F.sum("count").alias("n"), F.max_by("group", F.struct("count", "group")).alias("main")))
    labelled = join_by_count(labelled, stored(main, "main"), ["root"], total, hot)
    labelled = labelled.withColumn("must", F.col("group") != F.col("main")).drop("main")
    rest = labelled.where("must")
    asking_blocks = rest.groupBy("root", "band").agg(needed.alias("asking"))
    # for each band the blocks to ask in the neighbouring bands, and the residual blocks that ask it
    to_ask = (asking_blocks.withColumn("near", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
              .join(blocks.select("root", F.col("band").alias("near"), "blocks", "n"), ["root", "near"]))
    asks = to_ask.groupBy("root", "band").agg(F.max("asking").alias("asking"), F.sum("n").alias("n"),
                                              F.collect_list(F.struct("near", "blocks")).alias("grid"))
    asked_by = to_ask.groupBy("root", F.col("near").alias("band")).agg(
        F.max("n").alias("n"), F.collect_list(F.struct(F.col("band").alias("far"), "asking")).alias("grid"))
    asking = (join_by_count(rest, stored(asks, "asks"), ["root", "band"], total, hot)
              .withColumn("r", F.pmod(F.xxhash64(F.lit(5), "node"), "asking")).withColumn("g", F.explode("grid"))
              .withColumn("k", F.explode(F.sequence(zero, F.col("g.blocks") - 1))))
    asked = (join_by_count(labelled, stored(asked_by, "asked"), ["root", "band"], total, hot)
             .withColumn("g", F.explode("grid")).withColumn("r", F.explode(F.sequence(zero, F.col("g.asking") - 1))))
    asking = asking.select(F.col("root").alias("a"), F.xxhash64("band", "r").alias("b"), F.xxhash64("g.near", "k").alias("c"),
                           "node", "data", "group", "must")
    asked = asked.select(F.col("root").alias("a"), F.xxhash64("g.far", "r").alias("b"), F.xxhash64("band", "block").alias("c"),
                         "node", "data", "group", "must")
    held = labelled.groupBy("root", "band").agg(F.sum(F.length("data")).alias("all"),
                                                F.sum(F.when(F.col("must"), F.length("data")).otherwise(0)).alias("rest"))
    copied = (to_ask.groupBy("root", "band").agg(F.sum("blocks").alias("times")).join(held, ["root", "band"])
              .select((F.col("times") * F.col("rest")).alias("copies"), zero.alias("held"))
              .union(to_ask.groupBy("root", F.col("near").alias("band")).agg(F.sum("asking").alias("times")).join(held, ["root", "band"])
                     .select(F.col("times") * F.col("all"), "all")))
    copies, each = copied.agg(F.coalesce(F.sum("copies"), zero), F.greatest(F.sum("held") * ROUND_TIMES, F.lit(ROUND_BYTES))).first()
    rounds = -(-copies // each)
    for r in range(rounds):
        now = F.pmod(F.xxhash64("b", F.lit(11), "c"), F.lit(rounds)) == r
        first = first.union(stored(_searched(asking.where(now).union(asked.where(now)), size, percent), "links"))
    return first


def link_documents(docs: DataFrame, size: int = 4, percent: int = 85, hot: int = HOT, cluster_sets: int = CLUSTER_SETS,
                   cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """Adds n_shingles, component_id and component to the rows of ``docs`` (doc_id, text; other columns stay).

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their
    sets of ``size``-word shingles. component_id is the smallest doc_id that
    links reach, itself included; a null doc_id is never the smallest. component
    is a key of the group, null for texts without words. Null
    texts and texts without words have no shingles and are linked with nothing.
    Repeated rows, and rows with equal doc_id, are linked like any others.
    """
    named = [f"c{i}" for i in range(len(docs.columns))]
    doc_id = named[docs.columns.index("doc_id")]
    base = (docs.toDF(*named).withColumn("data", text_bytes(named[docs.columns.index("text")]))
            .withColumn("k1", F.xxhash64("data")).withColumn("k2", F.xxhash64(F.lit(7), "data")))
    rows = base.drop("data")
    total = docs.count()
    copies = stored(base.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.xxhash64(doc_id)).alias("keep"),
                                                 F.min(doc_id).alias("low")), "texts")
    texts = one_of_hot_texts(base.select("k1", "k2", "data", F.xxhash64(doc_id).alias("key")), copies, total, hot)
    def sets(batches):
        for b in _some(batches):
            found = shingle_sets(list(b["data"]), size)
            yield pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "n_shingles": [len(s) for s in found],
                                "node": [set_digest(s) for s in found]})

    keys = stored(texts.mapInPandas(sets, "k1 long, k2 long, n_shingles long, node long").dropDuplicates(["k1", "k2"]), "sets")
    clusters = _candidate_clusters(texts, size, percent, total, hot)

    # one text of each class in a cluster, with its cluster
    chosen = (keys.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("k1", "k2", "n_shingles")).alias("r"))
              .join(clusters, "node").select("r.k1", "r.k2", F.col("r.n_shingles").alias("n"), "node", "root"))
    chosen = _weighed(chosen, cluster_sets, cluster_shingles, hot)
    members = stored(texts.join(chosen, ["k1", "k2"]).groupBy("k1", "k2").agg(
        *[F.first(c).alias(c) for c in ("root", "node", "n", "large", "data")]).drop("k1", "k2"), "members")
    small, large = members.where("NOT large").drop("large"), members.where("large").drop("large")
    n_large = large.count()
    if n_large:
        # by their whole sets, most large clusters fall apart
        again = _candidate_clusters(large.select(F.col("node").alias("k1"), F.col("n").alias("k2"), "data"), size, percent, n_large, hot, WHOLE)
        regrouped = _weighed(large.select("node", "n").join(again, "node"), cluster_sets, cluster_shingles, hot)
        large = stored(large.drop("root", "n").join(regrouped, "node"), "members")
        small = small.unionByName(large.where("NOT large").drop("large"))
        large = large.where("large").drop("large")
        n_large = large.count()
    alone = small.select(
        F.col("root").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), "node", "data",
        F.col("node").alias("group"), F.lit(True).alias("must"))
    links = stored(_searched(alone, size, percent), "links")
    if n_large:
        links = links.union(_large_clusters(large, size, percent, max(2, cluster_sets // 2), max(2, cluster_shingles // 2), hot))
    joined = components(links, "u", "v")

    # smallest doc_id of each class, then of each component
    texts_low = keys.join(copies.select("k1", "k2", "n", "low"), ["k1", "k2"])
    classes = stored(texts_low.where("n_shingles > 0").groupBy("node").agg(F.min("low").alias("low"), F.count("*").alias("m"))
                     .join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    roots = stored(classes.groupBy("root").agg(F.count("*").alias("n"), F.min("low").alias("component_id")), "roots")
    of_class = join_by_count(classes.select("node", "root", "m"), roots, ["root"], classes.count(), hot)
    of_class = of_class.select("node", F.col("m").alias("n"), "component_id", F.col("root").alias("component"))
    of_text = join_by_count(keys.where("n_shingles > 0"), stored(of_class, "classes"), ["node"], keys.count(), hot)
    none = F.lit(None).cast("long")
    of_text = of_text.select("k1", "k2", "n_shingles", "component_id", "component").union(
        keys.where("n_shingles = 0").select("k1", "k2", "n_shingles", none, none))
    of_text = stored(of_text.join(copies.select("k1", "k2", "n"), ["k1", "k2"]), "texts")
    out = join_by_count(rows, of_text, ["k1", "k2"], total, hot)
    alone = F.col("n_shingles") == 0
    return out.select(*[F.col(n).alias(o) for n, o in zip(named, docs.columns)], "n_shingles",
                      F.when(alone, F.col(doc_id)).otherwise(F.col("component_id")).alias("component_id"), "component")


@query("op3_ngram_join")
def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
