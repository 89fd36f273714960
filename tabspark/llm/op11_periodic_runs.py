"""Periodic run detection over scale-tiled texts.

A text is exploded into overlapping tiles per octave of the period; tiles are
solved independently, by Z-values at boundaries inside them, and yield fragments
of runs. Fragments are shuffled by (text, period) and touching ones stitched. Of
stitched runs over the same words only the smallest period stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, ArrayType, BinaryType

from tabspark.llm.common import empty_if_missing, join_by_count, stored, table, text_bytes
from tabspark.llm.periods import CORE, SHORTEST, collapsed, solve, tiles, word_hashes
from tabspark.llm.registry import query

#: Bytes of text that a task solves together, and of a text whose tiles are dealt to other tasks.
BLOCK, SPREAD = 1_000_000, 8_000_000
HOT = 200

_TILE = "k1 long, k2 long, first int, last int, start long, n long, words binary"
_FRAGMENT = "k1 long, k2 long, period long, start long, stop long"
_RUNS = "array<struct<start:long,length:long,period:long>>"


def _own_tiles(block: list[bytes], shortest: int, core: int) -> list[np.ndarray]:
    """Fragments of each text of the block, all its tiles solved here."""
    groups: dict[tuple[int, int], list] = {}
    for i, word in enumerate(word_hashes(block)):
        for first, last, a, b in tiles(len(word), shortest, core) if len(word) >= shortest else ():
            groups.setdefault((first, last), []).append((i, (word[a:b], a, len(word))))
    found: list[list] = [[] for _ in block]
    for (first, last), parts in groups.items():
        for k, rows in solve([p for _, p in parts], first, last, shortest):
            found[parts[k][0]].append(rows)
    return [np.concatenate(f) if f else np.empty((0, 3), np.int64) for f in found]


def _blocks(texts: list[bytes], size: int):
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size or i == len(texts) - 1:
            yield at, i + 1
            at, held = i + 1, 0


def _solver(names: list[str], texts_too: bool, shortest: int, core: int, spread: int):
    """Rows without runs get their collapsed text at once; the others keep their text and their fragments."""
    def run(batches):
        for b in batches:
            texts = [empty_if_missing(t) for t in b["data"]]
            for x, y in _blocks(texts, BLOCK):
                block = texts[x:y]
                near = [t if len(t) <= spread else b"" for t in block]
                found = _own_tiles(near, shortest, core)
                hit = [len(f) > 0 or len(t) > spread for f, t in zip(found, block)]
                kept = [None if h else b" ".join(t.split()) for h, t in zip(hit, block)]
                out = b[names].iloc[x:y].copy()
                out["data"] = [t if h else None for h, t in zip(hit, block)]
                for c, name in enumerate(("period", "start", "stop")):
                    out[name] = [f[:, c] for f in found]
                out["kept"] = kept if texts_too else None
                out["kept_sha256"] = [None if k is None else hashlib.sha256(k).hexdigest() for k in kept]
                yield out

    return run


def _far_tiles(shortest: int, core: int):
    def run(batches):
        for b in batches:
            for k1, k2, t in zip(b["k1"], b["k2"], b["data"]):
                word = word_hashes([t])[0]
                for first, last, x, y in tiles(len(word), shortest, core):
                    yield pd.DataFrame({"k1": [k1], "k2": [k2], "first": [first], "last": [last], "start": [x], "n": [len(word)],
                                        "words": [word[x:y].tobytes()]})

    return run


def _solve_far(shortest: int):
    def run(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                for _, f in solve([(np.frombuffer(row.words, np.uint64), row.start, row.n)], row.first, row.last, shortest):
                    yield pd.DataFrame({"k1": row.k1, "k2": row.k2, "period": f[:, 0], "start": f[:, 1], "stop": f[:, 2]})

    return run


def stitched(fragments: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(k1, k2, start, length, period) of the runs whose fragments (k1, k2, period, start, stop) these are.

    Equal fragments, as copies of a text have them, are counted as one before the
    shuffle by text and period. A text has at most two per word and octave.
    """
    text = ["k1", "k2"]
    before = Window.partitionBy(*text, "period").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(*text, "period").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    seen = fragments.distinct().withColumn("new", F.coalesce((F.col("start") > F.max("stop").over(before)).cast("int"), F.lit(1)))
    joined = (seen.withColumn("piece", F.sum("new").over(until)).groupBy(*text, "period", "piece")
              .agg(F.min("start").alias("start"), F.max("stop").alias("stop")))
    runs = joined.where(F.col("stop") - F.col("start") >= F.greatest(F.col("period"), F.lit(shortest) - F.col("period")))
    # a run has every multiple of its period too, over the same words: the smallest counts
    return (runs.groupBy(*text, "start", (F.col("stop") + F.col("period")).alias("end")).agg(F.min("period").alias("period"))
            .select(*text, "start", (F.col("end") - F.col("start")).alias("length"), "period"))


def _collapser(texts_too: bool):
    def run(batches):
        for b in batches:
            out = b[["k1", "k2", "runs"]].copy()
            kept = [collapsed(t, [(r["start"], r["length"], r["period"]) for r in runs]) for t, runs in zip(b["data"], b["runs"])]
            out["kept"] = kept if texts_too else None
            out["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in kept]
            yield out

    return run


def periodic_runs(docs: DataFrame, texts_too: bool = True, shortest: int = SHORTEST, core: int = CORE, spread: int = SPREAD,
                  hot: int = HOT) -> DataFrame:
    """``docs`` without its text, with runs, kept (null unless ``texts_too``) and kept_sha256.

    ``runs`` has (start, length, period) in words, by start and then period: every
    longest stretch of at least ``shortest`` words and two periods. ``kept`` are the
    words that no run holds after its first period, joined by spaces, in UTF-8. Null
    and empty texts, and texts without words, have no runs and keep nothing. Other
    columns stay, also with clashing names; repeated rows each get their result;
    an empty table gives no row.
    """
    named = [f"c{i}" for i in range(len(docs.columns))]
    text = named[docs.columns.index("text")]
    others = [c for c in named if c != text]
    base = (docs.toDF(*named).withColumn("data", text_bytes(text)).withColumn("k1", F.xxhash64("data"))
            .withColumn("k2", F.xxhash64(F.lit(7), "data")))
    names = [*others, "k1", "k2"]
    rows = base.select(*names, "data")
    longs = ArrayType(LongType())
    schema = StructType([rows.schema[c] for c in names] + [
        StructField("data", BinaryType()), *[StructField(c, longs) for c in ("period", "start", "stop")],
        StructField("kept", BinaryType()), StructField("kept_sha256", StringType())])
    solved = stored(rows.mapInPandas(_solver(names, texts_too, shortest, core, spread), schema), "solved")
    hits = solved.where(F.col("data").isNotNull())
    near = hits.select("k1", "k2", F.explode(F.arrays_zip("period", "start", "stop")).alias("f")).select("k1", "k2", "f.*")
    texts = hits.select("k1", "k2", "data").dropDuplicates(["k1", "k2"])
    far = (texts.where(F.octet_length("data") > spread).mapInPandas(_far_tiles(shortest, core), _TILE)
           .repartition("k1", "k2", "start", "first").mapInPandas(_solve_far(shortest), _FRAGMENT))
    runs = (stitched(near.union(far), shortest).groupBy("k1", "k2")
            .agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs")))
    no_runs = F.array().cast(_RUNS)
    whole = (texts.join(runs, ["k1", "k2"], "left").withColumn("runs", F.coalesce("runs", no_runs))
             .mapInPandas(_collapser(texts_too), f"k1 long, k2 long, runs {_RUNS}, kept binary, kept_sha256 string"))
    often = hits.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    results = stored(whole.join(often, ["k1", "k2"]).select("k1", "k2", "n", "runs", "kept", "kept_sha256"), "runs")
    clean = solved.where(F.col("data").isNull()).select(*others, no_runs.alias("runs"), "kept", "kept_sha256")
    found = join_by_count(hits.select(*names), results, ["k1", "k2"], hits.count(), hot)
    out = clean.union(found.select(*others, "runs", "kept", "kept_sha256"))
    back = [F.col(n).alias(o) for n, o in zip(named, docs.columns) if n != text]
    return out.select(*back, "runs", "kept", "kept_sha256")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): for a tenth of the ids, by crc32, the text repeats a part of itself from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " ")

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # bound once: a lambda's argument isn't computed again for each word
    text = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 1)
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")), texts_too=False)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.col("kept_sha256").alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                       (-F.col("best.period")).alias("period"),
                       F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
